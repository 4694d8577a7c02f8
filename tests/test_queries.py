"""Every query of the catalogue against its SQL, or at least run, on a small table."""

import math

import duckdb
import pytest

import __spark_entry__ as driver
from panelforge.queries import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES = catalogue()


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5) + 0.0
    return value if value is None or isinstance(value, (int, bool)) else str(value)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if sql])
def test_query_equals_its_sql(spark, sf, duck, name):
    query, sql = QUERIES[name]
    df, want = query(spark, sf), duck.execute(sql)
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", [n for n, (_, sql) in QUERIES.items() if not sql])
def test_query_without_sql_has_rows(spark, sf, name):
    assert QUERIES[name][0](spark, sf).count() > 0


def test_entry_and_registry(spark):
    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = QUERIES["series_trend"][0](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(s_name,Supplier#000000001)" in plan and "l_comment" not in plan and "StringStartsWith(p_brand,Brand#1)" in plan
