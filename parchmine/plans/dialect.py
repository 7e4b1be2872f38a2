"""Plans written once in SQL that Spark and the correctness oracle both read, with tokens for what they spell differently."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: token: (Spark, DuckDB)
TOKENS = {
    "@G": ("", ", 'g'"),
    "@EVEN": ("bround", "round_even"),
    "@RLIKE": ("regexp_like", "regexp_matches"),
    "@STR": ("string", "varchar"),
    "@ANTI": ("LEFT ANTI JOIN", "ANTI JOIN"),
    "@SEMI": ("LEFT SEMI JOIN", "SEMI JOIN"),
    "@QUANTILE": ("percentile", "quantile_cont"),
    "@WORDS": ("explode(split(lower(text), ' '))", "unnest(string_split(lower(text), ' '))"),
    "@SPLITHASH": ("cast(cast(conv(substring(sha2('7|' || doc, 256), 1, 8), 16, 10) as bigint) % 100 as bigint)", "(('0x' || left(sha256('7|' || doc), 8))::UBIGINT % 100)::BIGINT"),
}
#: A function that takes one more argument in Spark.
SHA256 = "@SHA256("


def _called(sql: str, name: str, spell) -> str:
    """sql with each call name...) replaced by spell(its arguments)."""
    while (at := sql.find(name)) >= 0:
        end, depth = at + len(name), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = sql[:at] + spell(sql[at + len(name) : end - 1]) + sql[end:]
    return sql


def _sha(sql: str, which: int) -> str:
    return _called(sql, SHA256, lambda x: f"sha2({x}, 256)" if which == 0 else f"sha256({x})")


def _counted(sql: str) -> str:
    """count_if as a count, which is a 64-bit integer in both."""
    return _called(sql, "count_if(", lambda x: f"count(CASE WHEN {x} THEN 1 END)")


def for_spark(sql: str) -> str:
    return _spell(sql, 0)


def for_duckdb(sql: str) -> str:
    return _spell(sql, 1)


def _spell(sql: str, which: int) -> str:
    sql = _counted(_sha(sql, which))
    for token, words in TOKENS.items():
        sql = sql.replace(token, words[which])
    return sql


def plan(spark: SparkSession, sql: str, **frames: DataFrame) -> DataFrame:
    """The plan over frames, which the SQL names in braces; Catalyst sees one tree."""
    return spark.sql(for_spark(sql), **frames)
