"""What grows with the tables stays bounded, and results stay the same."""

import difflib
import os
import random
import re
import timeit

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, MapType, StringType, StructField, StructType
from pyspark.util import PythonEvalType

import __spark_entry__ as entry
from parchmine import queries
from parchmine.functions import text as T
from parchmine.operators import search
from parchmine.sources import tables

D = "/root/testdata/sf0.1"
needs_tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


def answers(spark, tmp_path, name, **made):
    """The query's rows and DuckDB's over made tables, both sorted."""
    duck = duckdb.connect()
    for table, df in made.items():
        df.write.parquet(f"{tmp_path}/{table}.parquet")
        duck.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet/*.parquet'")
    df = entry.queries()[name](spark, f"file://{tmp_path}")
    want = duck.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    return sorted(map(tuple, df.collect()), key=str), sorted(want, key=str)


@needs_tables
@pytest.mark.parametrize("name", ["selection_cover", "context_selection"])
def test_selections_that_agree_are_met_once(spark, monkeypatch, name):
    met = []
    monkeypatch.setattr(queries, "plan", lambda spark, sql, pages, judged: met.append(pages) or spark.range(1))
    entry.queries()[name](spark, D)
    assert met[0].count() <= 2639 < tables.table(spark, D, "documents").count()


@pytest.mark.parametrize("name", ["selection_cover", "context_selection"])
def test_selections_of_any_ids(spark, tmp_path, name):
    documents = spark.sql("SELECT nullif(id - 1500, 7) AS doc_id, 'src' || id % 3 AS source, 'text' AS text, 'en' AS lang, 4 AS n_chars FROM range(6000)")
    labels = spark.sql("SELECT nullif(id * 5 - 1500, 0) AS doc_id, 1 AS quality, id % 2 AS toxic FROM range(1200) UNION ALL SELECT 11, 1, 0 UNION ALL SELECT 11, 0, 1")
    got, want = answers(spark, tmp_path, name, documents=documents.repartition(7), labels=labels)
    assert got == want and len(got) > 10


@pytest.mark.parametrize("size", [(1000, 10), (10000, 10), (40, 300_000)])
def test_a_worker_holds_few_results_of_a_batch(size):
    rows, length = size
    held = []

    class Map(dict):
        def items(self):
            held.append(len(self))
            return super().items()

    batch = pa.array([f"{i:0{length}d}" for i in range(rows)])
    parts = T.sliced(lambda x: Map({int(x[-6:]): 1.0}), MapType(IntegerType(), DoubleType()), iter([(batch,)]))
    first = next(parts)
    assert len(held) == len(first) <= min(256, max(1, (1 << 20) // length))
    assert [k for p in (first, *parts) for row in p.to_pylist() for k, _ in row] == list(range(rows))


def test_columns_of_nested_kinds(spark):
    pair = StructType([StructField("a", StringType()), StructField("b", IntegerType())])
    maps = T.column(lambda x: x and {len(x): 0.5}, MapType(IntegerType(), DoubleType()))
    tuples = T.column(lambda x: x and [(x, 1), (None, 2)], ArrayType(pair))
    fields = T.column(lambda x: {"a": x, "b": 3}, pair)
    both = T.column(lambda x, y: f"{x}{y}", StringType())
    df = spark.range(0, 1000, 1, 3).selectExpr("IF(id % 7 = 0, NULL, CAST(id AS string)) AS x", "array(id) AS y").repartition(5)
    got = df.select("x", "y", maps("x"), tuples("x"), fields("x"), both(both("x", "y"), "x")).collect()
    assert len(got) == 1000
    for x, y, m, t, f, b in got:
        assert m == (x and {len(x): 0.5}) and t == (x and [(x, 1), (None, 2)]) and f == (x, 3) and b == f"{x}{y}{x}"
    assert spark.range(0).select(maps(F.col("id").cast("string"))).collect() == []


@pytest.mark.parametrize("name", ["navigation_audit", "navigation_links"])
def test_query_holds_no_whole_batch(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    kinds = re.findall(r"ArrowEvalPython .*, (\d+)\n", plan)
    assert kinds and set(kinds) == {str(PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF)}


def test_similarity_is_difflibs():
    rng = random.Random(5)
    for letters in ("a", "ab", "abc目", "abcdefgh 😀"):
        for _ in range(400):
            a, b = ("".join(rng.choices(letters, k=rng.randrange(40))) for _ in "ab")
            assert T.similarity(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).ratio()


def test_similarity_of_long_titles_takes_little_time():
    rng = random.Random(6)
    a, b = (" ".join("".join(rng.choices("etaoinshr", k=6)) for _ in range(250)) for _ in "ab")

    def least(f):
        return min(timeit.repeat(f, number=1, repeat=3))

    assert least(lambda: T.similarity(a, b)) < 0.5 * least(lambda: difflib.SequenceMatcher(None, a, b, autojunk=False).ratio())


def test_term_search_of_odd_documents(spark, tmp_path):
    """Repeated and null doc_ids, ties, words that come often, texts without the terms; and a document over many rows."""
    text = "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN '' ELSE repeat('The  Cat\n', CAST(id % 9 AS int)) || 'dog' || id % 5 || ' ÉTÉ ' || IF(id % 4 = 0, 'on', 'off') END"
    documents = spark.sql(f"SELECT CASE WHEN id % 50 = 1 THEN NULL WHEN id % 3 = 0 THEN 5 ELSE id % 700 END AS doc_id, {text} AS text, 'src' AS source, 'en' AS lang, 1 AS n_chars FROM range(3000)")
    benchmark = spark.sql("SELECT id AS item_id, element_at(array('the cat the', 'dog1 on', 'dog2  été', 'nothing here', '', NULL, 'off on\ncat', 'off'), CAST(id % 8 + 1 AS int)) AS text FROM range(9)")
    got, want = answers(spark, tmp_path, "benchmark_term_search", documents=documents.repartition(5), benchmark=benchmark)
    assert got == want and len(got) > 30


@needs_tables
def test_term_search_shuffles_no_words(spark):
    plan = entry.queries()["benchmark_term_search"](spark, D)._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\((.*?), \d+\)", plan) and not re.search(r"hashpartitioning\([^)]*(word|item_id#\d+L?, doc_id)", plan)


def test_term_search_scores_in_parts(monkeypatch):
    """Many rows of one document, and more documents than are scored at once."""
    monkeypatch.setattr(search, "MOST_ROWS", 3)
    monkeypatch.setattr(search, "MOST_SCORES", 10)
    terms = search.Terms([(1, b"a"), (2, b"a"), (2, b"b")], LongType())
    rows = [(None, [0], [9])] + [(i // 9, [0, 1] if i % 9 else [1], [i // 9 % 4, 1] if i % 9 else [2]) for i in range(900)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 70]), (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())))], ["doc_id", "terms", "counts"]) for i in range(0, len(rows), 70)]
    got = sorted(tuple(r.values()) for b in search.best(terms, 8)(iter(batches)) for r in b.to_pylist())
    fives = [i for i in range(100) if i % 4]
    assert got == [(1, i, 5) for i in fives[:8]] + [(2, i, 10) for i in fives[:8]]
