import random

import pytest

from parchmine.llm.common import Workspace
from parchmine.llm.components import connected_components


@pytest.mark.parametrize("run", [40, 1000])
def test_components_match_brute_force(spark, run):
    rng = random.Random(run)
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, x) for x in range(200, 260)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(25)]
    comp = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(100):
        for a, b in edges:
            if a != b:
                comp[a] = comp[b] = min(comp[a], comp[b])
    df = spark.createDataFrame([*edges, (None, 3), (5, None), (9, 9)], "a long, b long")
    got = {r.node: r.component for r in connected_components(Workspace(spark, "cc"), df, run).collect()}
    assert got == comp


def test_no_edges(spark):
    assert connected_components(Workspace(spark, "cc"), spark.createDataFrame([], "a long, b long")).count() == 0
