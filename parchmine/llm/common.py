"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression for a word: what stands between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes of an Arrow batch at most, so that a Python worker's memory doesn't grow with the lengths of the texts.
BATCH = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(name)) > BATCH:
        spark.conf.set(name, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset (tests), a temporary one, set for the session."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = f"file://{tempfile.mkdtemp(prefix='parchmine-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


class Workspace:
    """A folder below the shared one for the tables that cut an operator's lineage."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Writes df as Parquet and reads it back; executors that are lost later don't take it with them."""
        self._n += 1
        path = f"{self.path}/t{self._n}"
        schema = df.schema
        df.write.parquet(path)
        out = self.spark.read.schema(schema).parquet(path)
        out._parchmine_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table that write() made and that no later plan reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df._parchmine_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def text_of(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def row_key() -> Column:
    """128 bits that tell a row by its doc_id and text; rows that repeat both share it, and a null text counts as empty."""
    parts = [F.col("doc_id").isNull(), F.col("doc_id"), text_of()]
    return F.unhex(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed), *parts)), 16, "0") for seed in (1, 2)]))


#: A key is heavy if it has more than this share of all rows, so that at most HEAVY keys are.
HEAVY = 1_000


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """The inner join of left with right, whose keys are unique and whose `weight` is the number of left's rows by key.

    Keys with more than a thousandth of all rows are a thousand at most, whatever the size of the data: they are
    broadcast, and left's rows of them stay where they are. All others are merged after a shuffle, in which no key
    has more than that share. Both sides should be written tables, as each is read twice.
    """
    total = right.agg(F.sum(weight)).first()[0] or 0
    hot = F.broadcast(right.where(F.col(weight) > F.lit(total / HEAVY)))
    light = left.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return light.join(right.where(F.col(weight) <= F.lit(total / HEAVY)).hint("merge"), keys).unionByName(left.join(hot, keys))


def bounded_broadcast(small: DataFrame, rows: int, max_rows: int = 200_000) -> DataFrame:
    """Marks small for broadcast if its counted rows are below the bound; otherwise Spark chooses, and shuffles."""
    return F.broadcast(small) if rows <= max_rows else small
