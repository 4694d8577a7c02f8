"""Queries at keys that only larger tables have."""

import duckdb

import __spark_entry__ as driver


def test_digit_strip_keys_of_six_digits_are_no_school_numbers(spark, tmp_path):
    rows = [(99998, "a b", 3), (99999, "b c", 1), (100000, "almond 7", 2), (123457, "x", 50)]
    spark.createDataFrame(rows, "p_partkey bigint, p_name string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    got = driver.queries()["digit_strip"](spark, str(tmp_path)).orderBy("p_partkey").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet/*.parquet'")
    want = con.execute(f"SELECT * FROM ({driver.oracle_sql()['digit_strip']}) ORDER BY p_partkey").fetchall()
    assert [(r.p_partkey, r.name, r.number, r.school) for r in got] == want
    assert got[1].number is None and got[0].number == "99998" and got[2].number is None


def test_sources_are_merged_many_groups_at_a_time(spark, sf):
    plan = driver.queries()["sources_merged"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan
