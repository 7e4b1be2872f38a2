import itertools
import random

import pytest
import xxhash

from parchmine.llm import simhash as S
from parchmine.llm.common import Workspace
from parchmine.llm.components import connected_components


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [b" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    comp = {d: d for d in prints}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(prints, 2):
            if bin(prints[a] ^ prints[b]).count("1") <= 2 and comp[a] != comp[b]:
                m = min(comp[a], comp[b])
                comp[a] = comp[b] = m
                changed = True
    return comp


def rows(spark, texts, hot):
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, fp string")
    return {r.doc_id: (r.fp, r.component_id) for r in S.simhash_components(docs, hot).collect()}


def test_fingerprint_matches_brute_force_and_spark(spark):
    texts = [None, "", " \t\n", "One", "one TWO", "a b c", "É À a\x0bb c d", "x " * 5000, "Straße É " * 9]
    for t in texts:
        assert S.fingerprint(t) % (1 << 64) == brute_fingerprint(t)
    assert spark.sql("select xxhash64('a b c')").first()[0] == S.fingerprint("A b\nc")


@pytest.mark.parametrize("hot", [1, 3, 48])
def test_components(spark, monkeypatch, hot):
    rng = random.Random(hot)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(400)]
    texts = [(0, None), (1, ""), (2, " ")]
    for i in range(3, 60):
        t = list(base) if i % 3 else [rng.choice(words) for _ in range(60)]
        for _ in range(i % 5):
            t[rng.randrange(len(t))] = rng.choice(words)
        texts.append((i, " ".join(t)))
    texts += [(90, texts[10][1]), (91, texts[10][1])]
    want = {d: brute_fingerprint(t) for d, t in texts}
    comp = brute_components(want)
    got = rows(spark, texts, hot)
    assert {d: (f % (1 << 64), c) for d, (f, c) in got.items()} == {d: (want[d], comp[d]) for d in want}
    assert len(set(comp.values())) < len(texts)


def test_empty_table(spark):
    assert S.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (7, None)], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id) for r in S.simhash_components(docs).collect())
    assert got == [(-1, 5), (5, 5), (5, 5), (7, 7)]


@pytest.mark.parametrize("hot", [1, 48])
def test_rows_without_ids_link_others(spark, monkeypatch, hot):
    """1 and 3 are within 2 bits of the nameless row only."""
    monkeypatch.setattr(S, "fingerprint", lambda t: int(t))
    prints = S.pandas_udf(S.LongType())(lambda texts: texts.astype("int64"))
    monkeypatch.setattr(S, "fingerprints", prints)
    docs = spark.createDataFrame([(3, "15"), (None, "3"), (1, "0"), (None, "4096"), (None, "1048575"), (9, "-1")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.fp, r.component_id) for r in S.simhash_components(docs, hot).collect()), key=lambda r: r[1])
    assert got == [(9, -1, 9), (1, 0, 1), (None, 3, 1), (3, 15, 1), (None, 4096, 1), (None, 1048575, None)]


def test_links_and_star_steps_broadcast_nothing(spark, monkeypatch):
    """Whatever size Spark guesses: neither fingerprints nor nodes are gathered by the driver."""
    write, plans, name = Workspace.write, [], "spark.sql.autoBroadcastJoinThreshold"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(Workspace, "write", lambda self, df: plans.append(plan(df)) or write(self, df))
    prints, before = spark.createDataFrame([(x,) for x in (0, 1, 3, 7, 15, 31, 1 << 40, 5 << 40)], "fp long"), spark.conf.get(name)
    spark.conf.set(name, "1g")
    try:
        work = Workspace(spark, "plans")
        links = work.write(S._links(work, work.write(prints), 2))
        parts = connected_components(work, links, 3)
        assert "Broadcast" not in "".join([*plans, plan(parts)])
        assert sum("SortMergeJoin" in p for p in plans) >= 4
        assert {r.node: r.component for r in parts.collect()} == dict.fromkeys([0, 1, 3, 7, 15, 31, 1 << 40, 5 << 40], 0)
    finally:
        spark.conf.set(name, before)
