import collections
import math

import pytest

from parchmine.llm import mixing as M
from parchmine.llm.common import Workspace


def table(spark):
    rows, i = [], 0
    for source, n in (("big", 3000), ("mid", 700), ("small", 150), (None, 300)):
        for _ in range(n):
            rows.append((i, "w " * (1 + i % 13), source, 1.5))
            i += 1
    rows += [(i, None, "void", 1.0), (i + 1, "", "void", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, weight double"), rows


def passes(share, r):
    return (1 - r) * (math.log(max(share)) - math.log(min(share)))


def test_repetition_limit_and_weights(spark):
    docs, rows = table(spark)
    out = M.mix(docs, max_repetition=2.0)
    assert out.columns == docs.columns
    tokens, mixed, n = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    for r in out.collect():
        mixed[r.source] += len((r.text or "").split())
        n[r.doc_id] += 1
    assert set(n) == {r[0] for r in rows}
    epochs = {s: mixed[s] / tokens[s] for s in tokens if tokens[s]}
    assert min(epochs.values()) == pytest.approx(1, abs=0.01) and max(epochs.values()) == pytest.approx(2, abs=0.02)
    alpha = 1 - math.log(2) / math.log(tokens["big"] / tokens["small"])
    for s in epochs:
        assert epochs[s] == pytest.approx((tokens["big"] / tokens[s]) ** (1 - alpha), rel=0.02)


def test_entropy_target_is_met(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("d", 0)], "key string, tokens long")
    alpha = M.exponent(sources, target_entropy=0.8)
    p = [(x / 1110) ** alpha for x in (1000, 100, 10)]
    p = [x / sum(p) for x in p]
    assert -sum(x * math.log(x) for x in p) == pytest.approx(0.8 * math.log(3), abs=1e-6)
    assert M.exponent(sources, max_repetition=1000.0) == 0.0
    assert M.exponent(sources, target_entropy=0.1) == 1.0


def test_budget_and_positions(spark):
    docs, rows = table(spark)
    work = Workspace(spark, "m")
    plan = M.block_plan(work, docs, budget=4000).collect()
    assert sum(r.tokens * len(r.passes) for r in plan) == pytest.approx(4000, rel=0.03)
    for r in plan:
        assert len({p.epoch for p in r.passes}) == len(r.passes)


def test_empty_table(spark):
    docs, _ = table(spark)
    assert M.mix(docs.limit(0)).count() == 0
