"""Embedding near-duplicates by collision-counting projections."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, LongType

from .common import Workspace, skew_join, table
from .components import connected_components

THRESHOLD = 0.98
#: Projections whose window collisions are counted, and half the width of a window in standard deviations of a projected difference at the threshold.
COUNTED, WINDOW = 24, 2.0
#: Projections of a cell, the cell's width in the same measure, and the most tables of cells.
JOINED, CELL, MOST_TABLES = 6, 6.0, 32
#: Share of pairs at the threshold that the tables may miss, and that the count may; pairs above it are missed less.
MISS = 5e-4
#: Classes of a cell that are compared at once with as many others, rows that a task takes at once, and classes up to which pairs are compared one by one.
BLOCK, CHUNK, FEW = 1500, 4000, 48
SEED = 20


@lru_cache(32)
def plan(dim: int, threshold: float = THRESHOLD) -> tuple:
    """Axes of the counted projections, the window w, the least count, axes of the tables, a cell's width, offsets.

    For unit vectors at the threshold the distance is d = sqrt(2 - 2 threshold), in a direction that is uniform on the
    sphere. Such differences are drawn; the least count is the largest that misses at most MISS of them, and the
    tables are the fewest of which some table has both ends in one cell but for MISS of them. Cells have random
    offsets, so two ends that differ by x on a projection lie in one interval with probability 1 - x / width.
    """
    rng = np.random.default_rng(SEED)
    k = COUNTED + JOINED * MOST_TABLES
    axes = np.concatenate([np.linalg.qr(rng.normal(size=(dim, min(dim, k))))[0] for _ in range(-(-k // dim))], axis=1)[:, :k]
    d = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    w, width = WINDOW * d / np.sqrt(dim), CELL * d / np.sqrt(dim)
    if dim <= 256:
        draws = rng.normal(size=(20_000, dim))
        apart = np.abs(draws / np.linalg.norm(draws, axis=1, keepdims=True) @ axes) * d
    else:  # then coordinates of a direction are all but independent normal numbers
        apart = np.abs(rng.normal(size=(20_000, k))) * d / np.sqrt(dim)
    least = max(0, int(np.quantile((apart[:, :COUNTED] <= w).sum(1), MISS, method="lower")) - 1)
    meets = np.maximum(0, 1 - apart[:, COUNTED:] / width).reshape(len(apart), MOST_TABLES, JOINED).prod(2)
    missed = np.cumprod(1 - meets, axis=1).mean(0)
    tables = int(np.argmax(missed <= MISS)) + 1 if (missed <= MISS).any() else MOST_TABLES
    used = JOINED * tables
    return axes[:, :COUNTED], w, least, axes[:, COUNTED : COUNTED + used], width, rng.random(k - COUNTED)[:used]


def cell_keys(u: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """For each unit vector the key of its cell in each table."""
    _, _, _, axes, width, offsets = plan(u.shape[1], threshold)
    cells = np.floor(u @ axes / width + offsets).astype(np.int64).view(np.uint64).reshape(len(u), -1, JOINED)
    key = np.zeros(cells.shape[:2], np.uint64)
    for i in range(JOINED):
        key = (key ^ cells[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def unit(v) -> np.ndarray:
    v = np.asarray(v, np.float64)
    v = v / np.abs(v).max(axis=-1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def embedding_links(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label, ...).

    Only vectors of one label are compared. Null labels, and vectors that are null, empty, zero or hold a null or a
    number that isn't finite, link with nothing: 0 links, a component of their own. Rows with a null vec_id link like
    any other; a component without a vec_id is null, and its rows aren't kept. Rows that repeat a vec_id are vectors
    of their own. Equal vectors are one class and are compared once. Vectors of different lengths are never compared.

    A cell is an interval on each of six random projections, and a class has a cell in each of some tables (see
    plan()). Classes that share a cell with another meet there; in a cell, projections are sorted, collisions in
    windows around each query are counted, and pairs with enough of them are verified in double precision, in the
    first table that has both. Cells of more than `block` classes are cut into blocks, and each pair of blocks is a
    group of its own. A group returns sums and a spanning forest, never pairs.
    """
    work = Workspace(vectors.sparkSession, "projections")
    number = F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0))  # which makes -0.0 equal to 0.0
    good = F.coalesce(
        (F.size("embedding") > 0)
        & F.col("label").isNotNull()
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
        & F.exists("embedding", lambda x: x != 0),
        F.lit(False),
    )
    rows = work.write(vectors.select("vec_id", "label", F.when(good, number).alias("v")))
    classes = rows.where("v is not null").groupBy("label", "v").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = work.write(classes.withColumn("cls", F.monotonically_increasing_id()))

    @pandas_udf(ArrayType(LongType()))
    def keys(vs: pd.Series) -> pd.Series:
        out, size = np.empty(len(vs), object), vs.map(len).to_numpy()
        for dim in np.unique(size):
            at = np.flatnonzero(size == dim)
            for i, k in zip(at, cell_keys(unit(np.stack(vs.iloc[at].to_numpy())), threshold)):
                out[i] = k
        return pd.Series(out)

    located = work.write(classes.select("cls", "n", "v", F.xxhash64("label", F.size("v")).alias("home"), keys("v").alias("keys")))
    probes = work.write(located.select("cls", "home", F.posexplode("keys").alias("tbl", "cell")))
    place = ["home", "tbl", "cell"]
    shared = work.write(probes.groupBy(*place).agg(F.count("*").alias("m")).where("m > 1").withColumn("blocks", F.ceil(F.col("m") / block)))
    met = skew_join(probes, shared, place, "m").withColumn("part", F.pmod(F.xxhash64("cls"), F.col("blocks")))
    pairs_of_blocks = F.expr("transform(sequence(0L, blocks - 1), p -> struct(least(p, part) as x, greatest(p, part) as y))")
    groups = work.write(met.select("cls", *place, "part", F.inline(pairs_of_blocks)))
    spark = vectors.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    by = [*place, "x", "y"]
    dealt = groups.join(located.select("cls", "n", "v", "keys").hint("merge"), "cls").repartition(tasks, *by).sortWithinPartitions(*by)
    dealt = dealt.select(*by, "part", "cls", "n", "v", "keys")

    found = work.write(dealt.mapInArrow(lambda batches: _linked(batches, threshold), "cls long, linked long, root long"))
    sums = found.groupBy("cls").agg(F.sum("linked").alias("linked"))
    parts = work.write(connected_components(work, found.where("root is not null").select(F.col("cls").alias("a"), F.col("root").alias("b"))))
    told = work.write(
        classes.join(sums.hint("merge"), "cls", "left")
        .join(parts.hint("merge"), F.col("cls") == F.col("node"), "left")
        .select("label", "v", "least", "n", (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"), F.coalesce("component", "cls").alias("part"))
    )
    least = work.write(told.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("m")))
    told = work.write(skew_join(told, least, ["part"], "m").select("label", "v", "n", "n_links", "component_id"))
    linked = skew_join(rows.where("v is not null"), told, ["label", "v"], "n").select("vec_id", "n_links", "component_id")
    alone = rows.where("v is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(batches, threshold: float):
    """Sums and forests of the groups of a task, which come sorted, a bounded number of rows at a time."""

    def same(t: pa.Table) -> np.ndarray:
        fields = [t.column(i).to_numpy() for i in range(5)]
        return np.logical_and.reduce([f == f[-1] for f in fields])

    held = None
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = pa.Table.from_batches([batch.slice(at, CHUNK)])
            held = part if held is None else pa.concat_tables([held, part])
            whole = int(np.argmax(same(held)))  # the last group may go on
            if whole and held.num_rows >= CHUNK:
                yield _links_of(held.slice(0, whole), threshold)
                held = held.slice(whole).combine_chunks()
    if held is not None and held.num_rows:
        yield _links_of(held, threshold)


def _matrix(column: pa.ChunkedArray, rows: np.ndarray, dim: int) -> np.ndarray:
    return column.take(pa.array(rows)).combine_chunks().flatten().to_numpy().reshape(len(rows), dim)


def _links_of(t: pa.Table, threshold: float) -> pa.RecordBatch:
    home, tbl, cell, x, y, part, cls, n = (t.column(i).to_numpy() for i in range(8))
    size = pa.compute.list_value_length(t.column(8).combine_chunks()).to_numpy()
    new = np.flatnonzero(np.logical_or.reduce([f[1:] != f[:-1] for f in (home, tbl, cell, x, y)])) + 1
    first, last = np.append(0, new), np.append(new, len(cls))
    ends_a, ends_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for dim in np.unique(size[first]):
        mine = np.flatnonzero(size[first] == dim)
        rows = np.concatenate([np.arange(first[g], last[g]) for g in mine])
        u, keys = unit(_matrix(t.column(8), rows, dim)), None
        axes, w, least = plan(int(dim), threshold)[:3]
        p, at, i, j = u @ axes, 0, [], []
        few: dict[int, list[int]] = {}
        for g in mine:
            k = last[g] - first[g]
            if x[first[g]] == y[first[g]] and k <= FEW:
                few.setdefault(int(k), []).append(at)
            elif x[first[g]] == y[first[g]]:
                a, b = colliding(p[at : at + k], p[at : at + k], w, least)
                i.append(at + a[a < b])
                j.append(at + b[a < b])
            else:
                side = part[first[g] : last[g]] == x[first[g]]
                a, b = np.flatnonzero(side), np.flatnonzero(~side)
                if len(a) and len(b):
                    q, r = colliding(p[at + a], p[at + b], w, least)
                    i.append(at + a[q])
                    j.append(at + b[r])
            at += k
        for k, starts in few.items():
            a, b = np.triu_indices(k, 1)
            a, b = ((np.array(starts)[:, None] + side).ravel() for side in (a, b))
            for s in range(0, len(a), 1 << 16):
                hit = (np.abs(p[a[s : s + (1 << 16)]] - p[b[s : s + (1 << 16)]]) <= w).sum(1) >= least
                i.append(a[s : s + (1 << 16)][hit])
                j.append(b[s : s + (1 << 16)][hit])
        i, j = np.concatenate([np.empty(0, np.int64), *i]), np.concatenate([np.empty(0, np.int64), *j])
        exact = np.concatenate([np.empty(0)] + [np.einsum("ij,ij->i", u[i[s : s + 65536]], u[j[s : s + 65536]]) for s in range(0, len(i), 65536)])
        i, j = i[exact >= threshold], j[exact >= threshold]
        if len(i):  # a pair counts in the first table that has both
            keys = _matrix(t.column(9), rows, int(pa.compute.list_value_length(t.column(9).combine_chunks())[int(rows[0])].as_py()))
            earlier = np.concatenate([((keys[i[s : s + 65536]] == keys[j[s : s + 65536]]) & (np.arange(keys.shape[1]) < tbl[rows[i[s : s + 65536]]][:, None])).any(1) for s in range(0, len(i), 65536)])
            i, j = i[~earlier], j[~earlier]
        ends_a.append(rows[i])
        ends_b.append(rows[j])
    a, b = np.concatenate(ends_a), np.concatenate(ends_b)
    names, at = np.unique(cls, return_inverse=True)
    copies = np.zeros(len(names), np.int64)
    copies[at] = n
    a, b = at[a], at[b]
    linked = np.bincount(a, copies[b], len(names)) + np.bincount(b, copies[a], len(names))
    root = np.arange(len(names))
    while True:
        low, was = np.minimum(root[a], root[b]), root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        if (root == was).all():
            break
    some = linked > 0
    return pa.RecordBatch.from_arrays([pa.array(c) for c in (names[some], linked[some].astype(np.int64), names[root[some]])], ["cls", "linked", "root"])


def colliding(pa: np.ndarray, pb: np.ndarray, w: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of pa, row of pb) that collide on at least `least` projections: each is sorted, and the window of
    width 2 w around each query's value is a run of the sorted values, found by bisection."""
    rows, cols, step = [], [], max(1, 4_000_000 // len(pb))
    order = [np.argsort(pb[:, k], kind="stable") for k in range(pb.shape[1])]
    ranked = [pb[o, k] for k, o in enumerate(order)]
    for at in range(0, len(pa), step):
        queries = pa[at : at + step]
        count = np.zeros((len(queries), len(pb)), np.int8)
        for k, (o, values) in enumerate(zip(order, ranked)):
            low = np.searchsorted(values, queries[:, k] - w, "left")
            high = np.searchsorted(values, queries[:, k] + w, "right")
            for q, (lo, hi) in enumerate(zip(low.tolist(), high.tolist())):
                count[q, o[lo:hi]] += 1
        q, r = np.nonzero(count >= least)
        rows.append(q + at)
        cols.append(r)
    return np.concatenate(rows), np.concatenate(cols)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embedding_links() over all embeddings."""
    return embedding_links(table(spark, sf_dir, "embeddings"))


OP10_SQL = """
WITH RECURSIVE e AS (SELECT row_number() OVER () AS r, * FROM embeddings), good AS (
  SELECT r, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM e
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.r AS a, b.r AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.r <> b.r
  WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT r AS a, r AS b FROM e
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), comp AS (SELECT reach.a, min(e.vec_id) AS c FROM reach JOIN e ON e.r = reach.b GROUP BY 1), cnt AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT e.vec_id, coalesce(cnt.n, 0)::BIGINT AS n_links, comp.c AS component_id, coalesce(e.vec_id = comp.c, false) AS kept
FROM e LEFT JOIN comp ON e.r = comp.a LEFT JOIN cnt ON e.r = cnt.a
"""
