"""The corpus pipeline: five stages, each over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmine.llm.common import Workspace, row_key, table
from parchmine.llm.fertility import judged, measured
from parchmine.llm.lines import dedup_lines
from parchmine.llm.mixing import mix
from parchmine.llm.pieces import encode_digests
from parchmine.llm.simhash import HOT_BUCKET, components


def columns(docs: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality rules keep, with all their columns, whatever their names."""
    packed = docs.select(F.struct(*columns(docs)).alias("document"), "text", "lang")
    rows = judged(Workspace(spark, "quality").write(measured(packed).drop("text")))
    return rows.where("quality_kept").select("document.*")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat others."""
    return dedup_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: the one with the smallest doc_id, or one without where none has any.

    Rows that share a doc_id but not a text are documents of their own; of those in one component, the one with the
    smallest row_key() stays. Of rows that repeat both, one stays.
    """
    work, place = Workspace(spark, "near"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    found = components(work, docs, HOT_BUCKET, row_key().alias("k"))
    rows = found.groupBy("part", "k").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    first = rows.groupBy("part").agg(F.min(F.struct("place", "n")).alias("first"))
    kept = work.write(first.select(F.col("first.place.k").alias("_parchmine_k"), F.col("first.n").alias("_parchmine_n")))
    known = docs.withColumn("_parchmine_k", row_key()).join(kept.hint("merge"), "_parchmine_k")
    out = known.where("_parchmine_n = 1")
    if kept.where("_parchmine_n > 1").limit(1).count():
        out = out.unionByName(known.where("_parchmine_n > 1").dropDuplicates(["_parchmine_k"]))
    return out.select(columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's weight asks for, at least once."""
    return mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each mixed row."""
    return encode_digests(docs)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("mixing sources", mixing),
    ("SentencePiece encoding", encoding),
]

#: Tokenisers, MinHash and SimHash are beyond SQL; tests hold the pipeline against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each result is written and read again."""
    work, docs = Workspace(spark, "pipeline"), table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
