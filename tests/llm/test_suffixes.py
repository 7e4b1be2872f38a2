import collections
import hashlib
import random

import numpy as np
import pytest

from parchmine.llm import suffixes as S


def brute(texts):
    data = [(t or "").encode() for t in texts]
    n = collections.Counter(d[i : i + S.LENGTH] for d in data for i in range(len(d) - S.LENGTH + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - S.LENGTH + 1):
            if n[d[i : i + S.LENGTH]] > 1:
                gone[i : i + S.LENGTH] = True
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), len(kept), kept.decode(errors="replace")))
    return out


def texts(seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [say(n) for n in (330, 350, 380, 420, 500, 900, 2500)]
    out = [None, "", "short", say(399), "x" * 399, "x" * 401, "y" * 1500, "ab" * 700, "\0" * 500 + "q", "\0" * 450]
    for i in range(40):
        parts = [say(rng.randrange(10, 300))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            if rng.random() < 0.3:
                j = rng.randrange(len(s))
                s = s[:j] + "#" + s[j + 1 :]
            parts += [s, say(rng.randrange(0, 200))]
        out.append("".join(parts))
    return out + [out[15], out[15], out[16] + "!", say(5000) + shared[6] * 2]


@pytest.mark.parametrize("hot,chunk", [(1, 20_000), (3, 7), (500, 20_000)])
def test_repeats_match_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(S, "CHUNK", chunk)
    rows = texts(hot + chunk)
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, k string")
    got = {r.doc_id: tuple(r)[1:] for r in S.remove_repeats(df, hot).collect()}
    want = dict(enumerate(brute(rows)))
    assert {i: (got[i], want[i]) for i in want if got[i] != want[i]} == {}
    assert sum(w[1] > 0 for w in want.values()) > 10


def test_stretches(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.randrange(97, 100) for _ in range(3000))
    owned = lambda: sorted((s, p - s, h) for p, a, b, h in S.anchors(data) for s in range(a, b + 1))
    whole = owned()
    assert [s for s, *_ in whole] == list(range(len(data) - S.LENGTH + 1))
    monkeypatch.setattr(S, "STRETCH", 500)
    assert owned() == whole


def test_null_ids_repeated_rows_and_empty_table(spark):
    rng = random.Random(1)
    t = "".join(rng.choice("abc") for _ in range(450))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t[:399])], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed, r.n_spans) for r in S.remove_repeats(df).collect()) == [(0, 450, 1), (1, 450, 1), (1, 450, 1), (2, 0, 0)]
    assert S.remove_repeats(df.limit(0)).count() == 0


def test_cells_hold_each_window_once():
    rng = random.Random(2)
    for _ in range(50):
        size, place = rng.randrange(400, 673), None
        place = rng.randrange(size - 400, min(273, size))
        context = bytes(rng.randrange(256) for _ in range(size))
        for width in S.WIDTHS:
            starts = []
            for cell, start, end, there, core in S.cells(place, context, width):
                assert len(core) == 401 - width and core in context[start:end] and start + there == place
                for s in range(start, end - 399):
                    starts.append(s)
                    assert (place - s) // width == cell and core in context[s : s + 400]
            assert sorted(starts) == list(range(size - 399))


def test_repeated_rows_clashing_columns_and_very_long_texts(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long, "x"), (2, long[1000:2000] + "é", "y"), (3, "z" * 450, "z")] + [(4, "w" * 100, "w")] * 3
    got = S.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, k string"), 2).collect()
    assert sorted((r.doc_id, r.n_removed, r.n_kept) for r in got) == [(1, 1000, 299_000), (2, 1000, 2), (3, 450, 0), (4, 0, 100), (4, 0, 100), (4, 0, 100)]
