"""Connected components: union-find over bounded runs of edges, then large-star and small-star steps between the runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Edges that one task's union-find takes.
RUN = 1_000_000


def connected_components(work: Workspace, edges: DataFrame, run: int = RUN, max_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of edges (a, b); component is the smallest node reachable.

    Null ends and loops are left out. A task's union-find holds at most about `run` edges and leaves a forest; if one
    task took all of them, that is the answer. Else star steps join the forests. Rows of one star are never gathered
    in one task: minima are partial aggregates, and the joins that follow merge written tables, so that skewed keys
    can be split and no table is broadcast.
    """
    now = work.write(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    runs = -(-now.count() // run)
    if runs <= 1:
        return now.coalesce(1).mapInPandas(_forest(True), "node long, component long")
    now = work.write(now.coalesce(runs).mapInPandas(_forest(False), "hi long, lo long"))
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = work.write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = work.write(both.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        work.drop(least)
        least = work.write(large.groupBy("hi").agg(F.min("lo").alias("m")))
        after = work.write(
            large.join(least.hint("merge"), "hi").where("lo != m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).union(least).distinct()
        )
        for used in (least, large, now):
            work.drop(used)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).union(now.select("lo", "lo").distinct())


def _forest(roots: bool):
    """A union-find over a task's edges (hi, lo): each node with its smallest node, roots themselves if asked for."""

    def union_find(batches):
        parent: dict[int, int] = {}

        def find(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(up, up)
            return x

        for batch in batches:
            for a, b in zip(batch["hi"].tolist(), batch["lo"].tolist()):
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in parent if (r := find(x)) != x or roots]
        for at in range(0, len(pairs), 100_000):
            part = pairs[at : at + 100_000]
            yield pd.DataFrame(part, columns=["node", "component"] if roots else ["hi", "lo"])

    return union_find


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free checksum of the edges: equal marks before and after a round mean that it changed nothing."""
    h = F.xxhash64("hi", "lo")
    row = edges.agg(F.count("*"), F.sum(h.bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned(h, 32))).first()
    return tuple(row)
