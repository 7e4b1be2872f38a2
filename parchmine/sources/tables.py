"""Frames over the input tables, and the DuckDB SQL of the same frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages: doc, page, doc_id, text, lang. A doc has at most 1,000 pages, so that windows over it stay small."""
    group = F.floor(F.col("doc_id") / 1000).cast("long")
    w = Window.partitionBy("source", group).orderBy("doc_id")
    docs = table(spark, d, "documents")
    return docs.select(
        F.concat_ws("-", "source", group.cast("string")).alias("doc"), F.row_number().over(w).cast("long").alias("page"), "doc_id", "text", "lang", "n_chars"
    )


def lines(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, line of every line of the documents."""
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("pos", F.col("pos").cast("long"))


def words(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, pos, word of the documents, lower-cased and cut at blanks and line feeds."""
    parts = F.split(F.translate(F.lower("text"), "\n", " "), " ")
    return table(spark, d, "documents").select("doc_id", F.posexplode(parts).alias("pos", "word")).where("word != ''").withColumn("pos", F.col("pos").cast("long"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """page_id, pos, href of the links of the pages, in order."""
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return table(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "href")).withColumn("pos", F.col("pos").cast("long"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """page_id, pos, type, body of the h1, p, li and div blocks of the pages, with a box from their order and length."""
    found = F.regexp_extract_all("html", F.lit("<(?:h1|p|li|div)[^>]*>[^<]*"), F.lit(0))
    out = table(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "raw"))
    body = F.regexp_replace("raw", "^<[^>]*>", "")
    return out.select("page_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("raw", "^<([a-z0-9]+)", 1).alias("type"), body.alias("body"))


def judged(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, doc, gold, pred, prob, accepted of labelled documents: gold from labels, the prediction from the id's hash."""
    labels = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("long").alias("gold"), F.col("quality").cast("long").alias("quality"))
    unit = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 6), 16, 10).cast("double") / 16777216.0
    prob = F.round(0.15 + 0.5 * F.col("gold") + 0.35 * unit, 6)
    return labels.select(
        "doc_id", F.concat(F.lit("d"), (F.col("doc_id") % 25).cast("string")).alias("doc"), "gold", "quality", prob.alias("prob"),
        F.when(prob >= 0.5, 1).otherwise(0).cast("long").alias("pred"), ((prob < 0.4) | (prob > 0.6)).alias("accepted"),
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")


def components(spark: SparkSession, d: str) -> DataFrame:
    """vec_id, label, feature, x: the embeddings in long form."""
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"), F.posexplode("embedding").alias("feature", "x")).select(
        "vec_id", "label", F.col("feature").cast("long").alias("feature"), F.col("x").cast("double").alias("x")
    )


FRAMES = {"pages": pages, "lines": lines, "words": words, "links": links, "blocks": blocks, "judged": judged, "turns": turns, "components": components}

DUCKDB = {
    "pages": "SELECT source || '-' || (doc_id // 1000) AS doc, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) AS page, doc_id, text, lang, n_chars FROM documents",
    "lines": "SELECT doc_id, pos - 1 AS pos, line FROM (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS pos, unnest(string_split(text, chr(10))) AS line FROM documents)",
    "words": "SELECT doc_id, pos - 1 AS pos, word FROM (SELECT doc_id, generate_subscripts(p, 1) AS pos, unnest(p) AS word FROM (SELECT doc_id, string_split(translate(lower(text), chr(10), ' '), ' ') AS p FROM documents)) WHERE word <> ''",
    "links": "SELECT page_id, pos - 1 AS pos, href FROM (SELECT page_id, generate_subscripts(p, 1) AS pos, unnest(p) AS href FROM (SELECT page_id, regexp_extract_all(html, 'href=\"([^\"]*)\"', 1) AS p FROM pages))",
    "blocks": "SELECT page_id, pos - 1 AS pos, regexp_extract(raw, '^<([a-z0-9]+)', 1) AS type, regexp_replace(raw, '^<[^>]*>', '') AS body FROM (SELECT page_id, generate_subscripts(p, 1) AS pos, unnest(p) AS raw FROM (SELECT page_id, regexp_extract_all(html, '<(?:h1|p|li|div)[^>]*>[^<]*') AS p FROM pages))",
    "judged": "SELECT doc_id, 'd' || (doc_id % 25) AS doc, gold, quality, prob, CASE WHEN prob >= 0.5 THEN 1 ELSE 0 END::BIGINT AS pred, prob < 0.4 OR prob > 0.6 AS accepted FROM (SELECT doc_id, toxic::BIGINT AS gold, quality::BIGINT AS quality, round(0.15::DOUBLE + 0.5::DOUBLE * toxic + 0.35::DOUBLE * (('0x' || left(md5(doc_id::VARCHAR), 6))::UBIGINT::DOUBLE / 16777216.0::DOUBLE), 6) AS prob FROM labels)",
    "turns": "SELECT conv_id, turn::BIGINT AS turn, role, text FROM conversations",
    "components": "SELECT vec_id, label::BIGINT AS label, feature - 1 AS feature, x::DOUBLE AS x FROM (SELECT vec_id, label, generate_subscripts(embedding, 1) AS feature, unnest(embedding) AS x FROM embeddings)",
}
