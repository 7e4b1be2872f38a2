import collections
import random
import re

import pytest

from parchmine.llm import fertility as Q
from parchmine.llm.pieces import codec, default_model


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


TEXTS = ["", " ", "\n\n", "a", "a a a", "a a a a", "a b c a b c", "x\ny\nx\n x\n\n\n", "é b c #*$ |<>", "\v\f\r a\tb", "a b c d e " * 40]


def test_counts_match_brute_force():
    rng = random.Random(2)
    more = [" ".join(rng.choice("abcd\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    for t in TEXTS + more:
        assert Q.base_counts(t) == brute(t), t


def test_verdicts(spark):
    rng = random.Random(1)
    vocabulary = "the of and to in is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so said what up its about than into them can only other new some could time these two may".split()
    good = " ".join(rng.choice(vocabulary) for _ in range(200))
    rows = [(1, good, "en"), (2, None, "en"), (3, "", None), (4, "spam " * 200, "en"), (5, good, None), (6, "\U00013000\U00013001\U00013002 " * 3 + " ".join("".join(chr(0x13000 + rng.randrange(900)) for _ in range(8)) for _ in range(90)), "en"), (1, good, "en"), (7, " ".join(rng.choice("абвгд") * 3 + rng.choice("ежзик") * 2 + str(i) for i in range(80)), "xx")]
    got = [tuple(r) for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).select("doc_id", "quality_kept", "quality_rules.base_failed", "quality_rules.script").collect()]
    assert sorted(got, key=str) == sorted([(1, True, False, "Latin"), (2, False, True, None), (3, False, True, None), (4, False, True, "Latin"), (5, True, False, "Latin"), (6, True, False, None), (1, True, False, "Latin"), (7, True, False, "Cyrillic")], key=str)


def test_entropy_and_bytes():
    c = codec(default_model())
    n, per, share, entropy = Q.fertility("a a a a", c)
    assert (n, per, share) == (4, 7 / 4, 0) and entropy == pytest.approx(0)
    assert Q.fertility("\U00013000", c)[2] == pytest.approx(4 / 5)
    assert Q.fertility("", c) == (0, None, None, None)


def test_language_band(spark, monkeypatch):
    monkeypatch.setattr(Q, "LEAST_DOCS", 50)
    rng = random.Random(3)
    words = "people water little number sound place years live back give most very after thing name good sentence great think help through much before line right mean same tell follow came want show also around form three small".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(300)), "en") for i in range(120)]
    rows += [(900, " ".join(w + "###$$$&&&" for w in rows[0][1].split()), "en"), (901, " ".join("".join(rng.choice("qxzjkvw") for _ in range(6)) for _ in range(200)), "en")]
    got = {r.doc_id: r.quality_kept for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, kept in got.items() if not kept] == [900, 901]
    assert Q.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


WORDS = "people water little number sound place years live back give most very after thing name good sentence great think help through much before line right mean same tell follow came want show also around form three small".split()


@pytest.mark.parametrize("distinct", [False, True])
def test_copies_do_not_shrink_the_band(spark, distinct):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(300)), "en") for i in range(100)]
    per_token = lambda t: Q.fertility(t, codec(default_model()))[1]
    middle = sorted((t for _, t, _ in rows), key=per_token)[50]
    for i in range(150):
        words = middle.split(" ")
        if distinct:
            rng.shuffle(words)
        rows.append((1000 + i, " ".join(words), "en"))
    got = Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("quality_kept").count()
    assert got == len(rows)


def test_band_narrows_with_the_count(spark):
    rng = random.Random(6)
    rows = [(" ".join(rng.choice(WORDS) for _ in range(100)), f"l{n}") for n in (1, 20, 199, 200, 800) for _ in range(n)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    got = {r.lang: r.reach / r.middle for r in Q.language_bands(Q.measured(docs)).collect()}
    reach = [got[f"l{n}"] for n in (1, 20, 199, 200, 800)]
    assert reach[0] > reach[1] > reach[3] > reach[4] >= Q.LEAST_REACH
    assert reach[0] > 5 and reach[2] == pytest.approx(reach[3], rel=0.3)
