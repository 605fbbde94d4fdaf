"""Every query against its SQL in DuckDB, on the smallest tables."""

import datetime
import math

import duckdb
import pytest

import __spark_entry__ as entry
from quillstone.queries.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)[:10]
    return f"{v:.5f}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_parity(spark, duck, name):
    got = QUERIES[name](spark, SF)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    order = sorted(columns)
    want = sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_links_of_the_whole_table(spark):
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    assert QUERIES["shortest_link_resolution_all"](spark, "/root/testdata/sf0.001").count() == n
