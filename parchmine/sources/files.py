"""Files as frames, and frames as files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmine.functions.text import strict_json_error_of

#: Folders of results, which discovery doesn't enter.
RESULT_FOLDERS = r"\.(pdfout|mdout)/"


def find_pdfs(spark: SparkSession, *paths: str, recursive: bool = True, content: bool = False) -> DataFrame:
    """path, size, modified, sha256 (and content) of the PDF files below paths, each once, without results; see `output_folder`."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.[pP][dD][fF]").load(list(paths))
    found = found.where(~F.col("path").rlike(RESULT_FOLDERS)).dropDuplicates(["path"])
    out = found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"), "content")
    return out if content else out.drop("content")


def output_folder(path: Column, root: str | None = None) -> Column:
    """<stem>.pdfout beside the file, or <stem>-<8 hex digits of the path's hash>.pdfout below root."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    if root is None:
        return F.concat(F.regexp_extract(path, r"^(.*/)?", 1), stem, F.lit(".pdfout"))
    return F.concat(F.lit(root + "/"), stem, F.lit("-"), F.substring(F.sha2(path, 256), 1, 8), F.lit(".pdfout"))


def find_markdown(spark: SparkSession, path: str) -> DataFrame:
    """path, text of the Markdown files whose folder is a result."""
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return found.where(F.col("path").rlike(r"\.(pdfout|mdout)/[^/]+$"))


def reuse_hashes(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path, size, modified, content) with sha256: that of known (path, size, modified, sha256) where all three agree."""
    old = known.select("path", "size", "modified", F.col("sha256").alias("_old"))
    out = files.join(old, ["path", "size", "modified"], "left")
    return out.withColumn("sha256", F.coalesce("_old", F.sha2("content", 256))).withColumn("reused", F.col("_old").isNotNull()).drop("_old", "content")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """line (from 1 in its file), error and the fields of schema, for each line that isn't blank; error tells why a line isn't strict JSON."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("i", "value"))
    raw = raw.where(F.trim("value") != "")
    parsed = F.from_json("value", schema)
    return raw.select("file", (F.col("i") + 1).alias("line"), strict_json_error_of("value").alias("error"), parsed.alias("r")).select("file", "line", "error", "r.*")


def read_content_lists(documents: DataFrame) -> DataFrame:
    """doc, page (from 1), pos, type, text, bbox of documents (doc, json); what isn't a block is left out.

    The root is a list of pages or an object with pages, content_list_v2 or content_list; a page is a list of blocks
    or an object with content_list, blocks or items.
    """
    v = F.try_parse_json("json")
    root = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in ("pages", "content_list_v2", "content_list")], F.try_variant_get(v, "$", "array<variant>"))
    pages = documents.select("doc", F.posexplode(root).alias("i", "p"))
    inner = F.coalesce(F.try_variant_get("p", "$", "array<variant>"), *[F.try_variant_get("p", f"$.{k}", "array<variant>") for k in ("content_list", "blocks", "items")])
    blocks = pages.select("doc", (F.col("i") + 1).cast("long").alias("page"), F.posexplode(inner).alias("pos", "b"))
    get = lambda k, t="string": F.try_variant_get("b", f"$.{k}", t)
    kind = F.lower(F.substring(get("type"), 1, 80))
    box = get("bbox", "array<double>")
    good = (F.size(box) == 4) & F.forall(box, lambda x: x.isNotNull() & (F.abs(x) <= 1e7)) & (box[0] <= box[2]) & (box[1] <= box[3])
    text = F.coalesce(get("text"), F.to_json(F.try_variant_get("b", "$.content", "variant")))
    return blocks.where(kind.isNotNull()).select("doc", "page", "pos", kind.alias("type"), text.alias("text"), F.when(good, box).alias("bbox"))


def write_markdown(docs: DataFrame, path: str) -> None:
    """One folder of text for each doc of docs (doc, text); Spark's commit makes a document appear whole or not at all."""
    docs.select("doc", F.col("text").alias("value")).write.mode("overwrite").partitionBy("doc").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
