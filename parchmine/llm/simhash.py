"""SimHash near-duplicates by multi-index hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from .common import Workspace, skew_join, table
from .components import connected_components

SHINGLE = 3
SEED = 42
#: A bucket with more different fingerprints than this is linked by midpoints instead of pairs.
HOT_BUCKET = 48


def fingerprint(text: str | None) -> int:
    """SimHash of the text's 3-word shingles, as a signed 64-bit integer."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return _signed(xxhash.xxh64_intdigest(joined, SEED))
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - SHINGLE + 1].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        hashes = np.array(
            [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)])], np.uint64
        )
        total += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return _signed(int(np.packbits(2 * total > len(starts), bitorder="little").view(np.uint64)[0]))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def simhash_components(docs: DataFrame, hot_bucket: int = HOT_BUCKET) -> DataFrame:
    """doc_id, fp (long), component_id for every row of docs (doc_id, text, ...).

    Documents whose fingerprints differ in 2 bits or fewer are linked. A fingerprint is cut into two segments of
    32 bits; of two fingerprints that differ in at most 2 bits, one segment differs in at most 1. So each segment's
    ball of radius 1 is looked up in the table of segments, and full distances of what is found are verified. Only
    flips from 0 to 1 are looked up: the other direction finds the same pairs. Equal fingerprints are one entry.

    Buckets of more than hot_bucket fingerprints yield no pairs. Every fingerprint that probes one of them is linked
    exactly by midpoints: two fingerprints differ in at most 2 bits if and only if the balls of radius 1 around them
    meet, and one point has at most 65 fingerprints around it. No link is lost, and rows stay in proportion.

    Null or empty texts and texts without words have fingerprint zero and are linked like any other. Rows with a null
    doc_id link like any other, so two rows may be linked through one; a component without a doc_id is null. Rows that
    repeat a doc_id have a fingerprint each. Columns of docs by other names, fp included, aren't read.
    """
    found = components(Workspace(docs.sparkSession, "simhash"), docs, hot_bucket)
    return found.select("doc_id", "fp", "component_id")


def components(work: Workspace, docs: DataFrame, hot_bucket: int = HOT_BUCKET, *more: Column) -> DataFrame:
    """doc_id, fp, more columns of docs, part (a fingerprint that tells the component) and component_id of every row."""
    prints = work.write(docs.select("doc_id", fingerprints("text").alias("fp"), *more))
    different = work.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    found = connected_components(work, work.write(_links(work, different.select("fp"), hot_bucket)))
    parts = work.write(different.join(found.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "least", "n", F.coalesce("component", "fp").alias("part")))
    least = work.write(parts.groupBy("part").agg(F.min("least").alias("component_id"), F.count("*").alias("m")))
    told = work.write(skew_join(parts, least, ["part"], "m").select("fp", "n", "part", "component_id"))
    return skew_join(prints, told, ["fp"], "n").drop("n")


def _links(work: Workspace, different: DataFrame, hot_bucket: int) -> DataFrame:
    """Links (a, b) between fingerprints; enough of them for the components.

    All joins are merges: Spark takes a ball for as small as the one row that it is made of, and would broadcast it.
    """
    high = F.shiftrightunsigned("fp", 32)
    low = F.col("fp").bitwiseAND(0xFFFFFFFF)
    segments = F.array(F.struct(F.lit(0).alias("seg"), high.alias("val")), F.struct(F.lit(1).alias("seg"), low.alias("val")))
    entries = different.select("fp", F.inline(segments))
    sizes = work.write(entries.groupBy("seg", "val").agg(F.count("*").alias("n")).where(F.col("n") > hot_bucket))
    cold = entries.join(sizes.hint("merge"), ["seg", "val"], "left_anti").select("seg", "val", F.col("fp").alias("fp_b"))
    index = work.write(cold.union(sizes.select("seg", "val", F.lit(None).cast("long"))))
    ball = F.expr("concat(array(val), transform(filter(sequence(0, 31), i -> getbit(val, i) = 0), i -> val | shiftleft(1L, i)))")
    probes = entries.select("seg", F.explode(ball).alias("val"), "fp")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp_b"))) <= 2
    met = work.write(
        probes.join(index.hint("merge"), ["seg", "val"])
        .where(F.col("fp_b").isNull() | (near & (F.col("fp") != F.col("fp_b"))))
        .select("fp", "fp_b")
    )
    hot = met.where("fp_b is null").select("fp").distinct()
    points = F.expr("concat(array(fp), transform(sequence(0, 63), i -> fp ^ shiftleft(1L, i)))")
    around = work.write(hot.select("fp", F.explode(points).alias("point")))
    centre = work.write(around.groupBy("point").agg(F.min("fp").alias("m"), F.count("*").alias("n")).where("n > 1").select("point", "m"))
    by_midpoint = around.join(centre.hint("merge"), "point").where("fp != m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return met.where("fp_b is not null").select(F.col("fp").alias("a"), F.col("fp_b").alias("b")).union(by_midpoint).distinct()


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """simhash_components() of all documents, with fingerprints in hexadecimal digits."""
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
