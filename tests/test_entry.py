"""Every registered raster query against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from lumenweave.plans.queries import ORACLES, QUERIES

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES.split():
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(repr(r[i]) for i in order) for r in data)


def test_flagship(spark):
    df = __spark_entry__.entry(spark)
    assert df.columns == ["severity", "n", "percent"] and sum(r.n for r in df.collect()) > 0


def test_registration():
    assert set(ORACLES) <= set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", [n for n in QUERIES if n in ORACLES])
def test_query_equals_sql(spark, duck, name):
    df = __spark_entry__.queries()[name](spark, D)
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_query_without_sql_runs(spark, name):
    assert __spark_entry__.queries()[name](spark, D).count() > 0
