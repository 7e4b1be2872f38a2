import numpy as np
import pytest

from parchmine.llm import projections as P


def brute(rows):
    ok = {}
    for i, (vid, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            u = np.array(v, float) / max(map(abs, v))
            ok[i] = u / np.linalg.norm(u)
    links = {i: {j for j in ok if j != i and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.98} for i in ok}
    out = []
    for i, (vid, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        component = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vid, len(links.get(i, ())), component, vid is not None and vid == component))
    return sorted(out, key=str)


@pytest.mark.parametrize("block,few", [(3, 48), (1500, 48), (1500, 2)])
def test_links_match_brute_force(spark, monkeypatch, block, few):
    monkeypatch.setattr(P, "FEW", few)
    monkeypatch.setattr(P, "CHUNK", 5 * few)
    rng = np.random.default_rng(block)
    base = rng.normal(size=(12, 16))
    rows = []
    for i in range(150):
        v = base[i % 12] + rng.normal(size=16) * rng.choice([0, 0.05, 0.15, 0.3])
        rows.append((i, [float(np.float32(x)) for x in v], int(i % 3)))
    rows += [(5, rows[7][1], 1), (5, rows[8][1], 2), (None, (base[3] + 0.1).tolist(), 0), (None, [5.0] * 16, 9)]  # repeated and null ids
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, [1.0, None], 1), (204, [], 1), (205, rows[0][1], None)]
    rows += [(206, rows[0][1], 0), (207, rows[0][1], 0), (None, rows[0][1], 0), (208, [1.0, 0.0], 0), (209, [1.0, -0.0], 0), (210, [1e300, 0.0], 0), (211, [float("inf"), 1.0], 0)]
    df = spark.createDataFrame([(a, b, c, "x") for a, b, c in rows], "vec_id long, embedding array<double>, label int, cls string")
    got = sorted(map(tuple, P.embedding_links(df, block=block).collect()), key=str)
    assert got == brute(rows)


def test_window_counts_match_brute_force():
    rng = np.random.default_rng(5)
    pa, pb = rng.normal(size=(40, 6)), rng.normal(size=(30, 6))
    want = {(i, j) for i in range(40) for j in range(30) if (np.abs(pa[i] - pb[j]) <= 0.7).sum() >= 3}
    assert set(zip(*map(list, P.colliding(pa, pb, 0.7, 3)))) == want


def test_empty_table(spark):
    assert P.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("dim", [16, 64, 128, 768])
def test_recall_at_the_threshold_and_share_of_pairs_that_meet(dim):
    rng = np.random.default_rng(dim)
    u = P.unit(rng.normal(size=(4000, dim)))
    w = rng.normal(size=u.shape)
    w = P.unit(w - (w * u).sum(1, keepdims=True) * u)
    v = 0.98 * u + np.sqrt(1 - 0.98**2) * w
    axes, window, least = P.plan(dim)[:3]
    met = (P.cell_keys(u) == P.cell_keys(v)).any(1)
    counted = (np.abs((u - v) @ axes) <= window).sum(1) >= least
    assert (met & counted).mean() >= 0.997
    keys = P.cell_keys(u[:2000])
    meet = np.zeros((2000, 2000), bool)
    for j in range(keys.shape[1]):
        meet |= keys[:, j][:, None] == keys[:, j][None]
    assert (meet.sum() - 2000) / (2000 * 1999) < 0.03


def test_many_lengths_and_repeated_ids(spark):
    rows = [(i, [1.0] * (i + 1), 1) for i in range(40)] + [(5, [1.0, 0.0], 2), (5, [0.0, 1.0], 2), (6, [1.0, 0.0], 2), (7, [0.0, 2.0], 2), (8, [0.0, 1.0], 2)]
    got = P.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert len(got) == len(rows) and sorted((r.vec_id, r.n_links, r.component_id) for r in got if r.n_links) == [(5, 1, 5), (5, 2, 5), (6, 1, 5), (7, 2, 5), (8, 2, 5)]
