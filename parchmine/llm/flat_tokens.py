"""Token counts of flat, unindexed token files by a separator scan."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import Workspace, table

#: Bytes of a block, bytes of a token (little endian, unsigned), the separator's id, and blocks of one run of the prefix scan.
BLOCK_BYTES, WIDTH, SEPARATOR, RUN = 1 << 18, 2, 50256, 1024


@lru_cache(2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def flat_file_blocks(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """file, block, data of the flat token files at path; a file is a row of Spark's reader, so 2 GB at most."""
    assert block_bytes % WIDTH == 0

    def cut(batches):
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                for at in range(0, max(1, len(content)), block_bytes):
                    yield pd.DataFrame({"file": [name], "block": [at // block_bytes], "data": [content[at : at + block_bytes]]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(cut, "file string, block long, data binary")


def write_flat(docs: DataFrame, work: Workspace, ranks: str | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Tokens of docs (doc_id, text, ...) as flat files of a separator after each text, in blocks: file, block, data.

    A task's texts are one file. Rows with a null `data` say which documents a file has, in order (base, ids); the
    scan doesn't read them. The separator's text is ordinary text in a document. A null text is empty, and is a
    document like any other; ids of any type and null ids are kept as they are, and repeated rows are a document each.
    Other columns aren't read.
    """
    rows = docs.select("doc_id", "text")
    schema = f"file string, block long, data binary, base long, ids array<{rows.schema['doc_id'].dataType.simpleString()}>"

    def flatten(batches):
        enc, file = encoding(ranks or default_ranks()), str(TaskContext.get().partitionId())
        buffer, block, base, id_type = bytearray(), 0, 0, pa.null()
        end = np.array([SEPARATOR], f"<u{WIDTH}").tobytes()

        def row(**values):
            types = {"file": pa.string(), "block": pa.int64(), "data": pa.binary(), "base": pa.int64(), "ids": pa.list_(id_type)}
            return pa.RecordBatch.from_arrays([pa.array([file if c == "file" else values.get(c)], t) for c, t in types.items()], list(types))

        for batch in batches:
            id_type, ids = batch.column(0).type, batch.column(0).to_pylist()
            for text in batch.column(1):
                buffer += np.array(enc.encode_ordinary(text.as_py() or ""), f"<u{WIDTH}").tobytes() + end
                while len(buffer) >= block_bytes:
                    yield row(block=block, data=bytes(buffer[:block_bytes]))
                    del buffer[:block_bytes]
                    block += 1
            yield row(base=base, ids=ids)
            base += len(ids)
        if buffer:
            yield row(block=block, data=bytes(buffer))

    return work.write(rows.mapInArrow(flatten, schema))


@pandas_udf(StructType([StructField("tokens", IntegerType()), StructField("ends", ArrayType(IntegerType()))]))
def _ends(data: pd.Series) -> pd.DataFrame:
    """Tokens of each block, and where its separators are."""
    rows = [np.frombuffer(d, f"<u{WIDTH}") for d in data]
    return pd.DataFrame({"tokens": [len(r) for r in rows], "ends": [np.flatnonzero(r == SEPARATOR).astype(np.int32) for r in rows]})


def separator_scan(blocks: DataFrame, work: Workspace) -> DataFrame:
    """file, ordinal, start, n_tokens, ended of every document in blocks (file, block, data).

    Each block is searched by itself. A prefix scan over a file's blocks, in runs and over their totals, then tells
    how many tokens and separators come before a block and where the last of them is, so that a document may span
    any number of blocks. Tokens after a file's last separator are a document that isn't ended. Blocks hold whole
    tokens, and are numbered from 0 without gaps in each file; empty and null blocks are skipped.
    """
    found = work.write(blocks.where("data is not null and length(data) > 0").select("file", "block", _ends("data").alias("e")).select("file", "block", "e.tokens", "e.ends"))
    by_block = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_run = Window.partitionBy("file").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    facts = found.withColumn("run", F.floor(F.col("block") / RUN)).withColumn("n", F.size("ends").cast("long"))
    runs = facts.groupBy("file", "run").agg(F.sum("tokens").alias("run_tokens"), F.sum("n").alias("run_n"))
    runs = runs.select("file", "run", F.coalesce(F.sum("run_tokens").over(by_run), F.lit(0)).alias("tokens_before_run"), F.coalesce(F.sum("run_n").over(by_run), F.lit(0)).alias("n_before_run"))
    placed = facts.join(runs, ["file", "run"]).select(
        "file", "block", "run", "tokens", "ends",
        (F.col("tokens_before_run") + F.coalesce(F.sum("tokens").over(by_block), F.lit(0))).alias("offset"),
        (F.col("n_before_run") + F.coalesce(F.sum("n").over(by_block), F.lit(0))).alias("ordinal"),
    )
    placed = work.write(placed.withColumn("last", F.col("offset") + F.try_element_at("ends", F.lit(-1))))
    lasts = placed.groupBy("file", "run").agg(F.max("last").alias("last"), F.max(F.col("offset") + F.col("tokens")).alias("end"), F.max(F.col("ordinal") + F.size("ends")).alias("n"))
    before = lasts.select("file", "run", F.coalesce(F.max("last").over(by_run), F.lit(-1)).alias("last_before_run"))
    linked = placed.join(before, ["file", "run"]).withColumn("previous", F.greatest("last_before_run", F.coalesce(F.max("last").over(by_block), F.lit(-1))))
    starts = F.expr("transform(ends, (e, i) -> struct(ordinal + i as ordinal, if(i = 0, previous, offset + ends[i - 1]) + 1 as start, offset + e as end))")
    ended = linked.select("file", F.inline(starts)).select("file", "ordinal", "start", (F.col("end") - F.col("start")).alias("n_tokens"), F.lit(True).alias("ended"))
    tails = lasts.groupBy("file").agg(F.coalesce(F.max("last"), F.lit(-1)).alias("last"), F.max("end").alias("end"), F.max("n").alias("ordinal")).where("end > last + 1")
    rest = tails.select("file", "ordinal", (F.col("last") + 1).alias("start"), (F.col("end") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return ended.union(rest)


def op8_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, file, ordinal and start of every document, counted from flat files of its table; see write_flat()."""
    work = Workspace(spark, "flat")
    flat = write_flat(table(spark, sf_dir, "documents"), work)
    counts = work.write(separator_scan(flat.select("file", "block", "data"), work))
    names = flat.where("data is null").select("file", "base", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("base") + F.col("i")).alias("ordinal"), "doc_id")
    return names.join(counts, ["file", "ordinal"], "left").select("doc_id", "n_tokens", "file", "ordinal", "start")
