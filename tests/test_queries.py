import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "INTEGER": "int"}
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-6) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(entry._library.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    result = duck.execute(entry.oracle_sql()[name])
    names = [x[0] for x in result.description]
    assert {k: KINDS[str(t)] for k, t in ((x[0], x[1]) for x in result.description)} == dict(df.dtypes)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=str)
    assert len(got) == len(want)
    assert all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


@pytest.mark.parametrize("name", sorted(set(entry._library.QUERIES) - set(entry._library.ORACLES)))
def test_query_without_oracle_runs(spark, name):
    assert entry.queries()[name](spark, D).count() > 0


def test_navigation_audit_finds_nothing(spark):
    bad = entry.queries()["navigation_audit"](spark, D).where("missing > 0 or repeated > 0 or links != backlinks or not idempotent")
    assert bad.count() == 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
