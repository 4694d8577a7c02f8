"""Rows that break rules, sources by county, directories, places in tiers, addresses of pictures: small cases with odd ones."""

import pytest
from pyspark.sql import functions as F

from panelforge.functions import text
from panelforge.operators import match, merge, problems
from panelforge.queries import contracts
from panelforge.sources import files
from panelforge.sources.registry import Registry


def test_a_filter_on_the_county_leaves_the_other_files_unread(spark, sf):
    rows = contracts.SOURCES.rows(spark, sf)
    assert {"county", "school", "program", "year", "points", "round", "status"} == set(rows.columns)
    plan = rows.where("county = 'Orders'")._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" in plan and "lineitem.parquet" not in plan and "events.parquet" not in plan
    assert {r.county for r in contracts.SOURCES.rows(spark, sf, ["visits", "nowhere"]).select("county").distinct().collect()} == {"Visits"}
    about = {r.county: r.about for r in contracts.SOURCES.counties(spark).collect()}
    assert list(about) == ["Lines", "Orders", "Visits"] and about["Lines"]["round"] == "1"
    with pytest.raises(ValueError):
        contracts.SOURCES.rows(spark, sf, ["nowhere"])
    twice = Registry()
    twice.source("a")(lambda s, p: None)
    with pytest.raises(ValueError):
        twice.source("a")(lambda s, p: None)


def test_directories_lists_and_caches(spark, tmp_path):
    for name in ("points-2023.txt", "points-2024.txt", "points.txt", "other-2025.csv"):
        (tmp_path / name).write_text("x")
    found = files.directory(spark, str(tmp_path), ".txt").select("file", "source_rank", "year").orderBy("source_rank").collect()
    assert [tuple(r) for r in found] == [("points.txt", 0, None), ("points-2024.txt", 1, 2024), ("points-2023.txt", 2, 2023)]
    assert [tuple(r) for r in files.listed(spark, ["b", "a"]).collect()] == [("b", 0), ("a", 1)]
    made = []
    for _ in range(2):
        got = files.cached(spark, str(tmp_path / "kept"), lambda: made.append(1) or spark.range(3))
        assert got.count() == 3
    assert made == [1]


def test_problem_rows(spark):
    rows = [
        ("c", "s", "Bygg 41,5", "x", 2020, 40.0), ("c", "s", "Bygg 41,5", "x", 2021, 66.0), ("c", "s", "Helse venteliste", "other", 2020, -1.0),
        ("c", "s", "Vg2 bra", "x", 2020, None), ("c", "s", None, None, None, None), ("c", "s", "Ren", "x", 2020, 65.0), ("c", "s", "Ren", "x", 2020, 65.0),
    ]
    cells = spark.createDataFrame(rows, "county string, school string, program string, category string, year int, points double")
    got = sorted((r.program, r.year or 0, r.rule) for r in problems.cell_problems(cells).collect())
    assert got == [
        ("Bygg 41,5", 0, "number glued to name"), ("Bygg 41,5", 2021, "out of range"), ("Helse venteliste", 0, "status glued to name"),
        ("Helse venteliste", 0, "uncategorised"), ("Helse venteliste", 2020, "out of range"),
    ]
    made = spark.createDataFrame([(1, 40.0, 2.0, 0.5), (2, 71.0, 0.0, 1.5), (3, None, 1.0, float("nan"))], "k int, m double, s double, pi double")
    got = sorted((r.k, r.rule[:6]) for r in problems.forecast_problems(made, ["k"]).collect())
    assert got == [(2, "fill i"), (2, "spread"), (2, "thresh"), (3, "fill i"), (3, "thresh")]
    spreads = spark.createDataFrame([(0, 9.0), (1, 5.0), (2, 6.0), (3, 1.0)], "bucket int, s double")
    assert [(r.above_residual, r.shrinks) for r in problems.spread_problems(spreads, 2.0).orderBy("bucket").collect()] == [
        (True, True), (True, True), (True, False), (False, True),
    ]


def test_entries_are_replaced_whole(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, v int, credit string")
    new = spark.createDataFrame([("a", 9), (None, 8), ("c", 7)], "k string, v int")
    assert sorted(map(str, (tuple(r) for r in merge.superseded(old, new, ["k"]).collect()))) == sorted(
        map(str, [("a", 9, None), (None, 8, None), ("c", 7, None), ("b", 2, "y")])
    )
    assert merge.superseded(old, new.limit(0), ["k"]).count() == 3


def test_every_tier_tells_a_place(spark, sf):
    tiers = {r.tier for r in contracts.located_schools(spark, sf).select("tier").distinct().collect()}
    assert {"manual", "register", "place", "unmatched"} <= tiers
    at = "county string, {} string, lat double, lon double"
    schools = spark.createDataFrame([("c", n) for n in ("Ask", "Bø", "Dal", "Eik", "Fjell", "Gran", None)] + [("d", "Ask")], "county string, school string")
    register = spark.createDataFrame(
        [("c", "Ask", 1, 60.0, 5.0, "Vei 1"), ("c", "Ask", 2, 61.0, 5.0, None), ("c", "Dal", 1, None, None, "Vei 2"), ("c", "Fjell", 1, None, 5.0, "Vei 9"), ("c", "Bø", 1, 1.0, 1.0, None)],
        "county string, navn string, pos int, lat double, lon double, adresse string",
    )
    manual = spark.createDataFrame([("c", "Bø", 59.0, 9.0)], at.format("school"))
    addresses = spark.createDataFrame([("c", "Vei 2", 62.0, 6.0), ("d", "Vei 9", 0.0, 0.0)], at.format("adresse"))
    places = spark.createDataFrame([("c", "Eik skole", 63.0, 7.0), ("c", "Fjell", 64.0, 8.0), ("c", "Dal", 0.0, 0.0), ("c", "Gran", None, 1.0)], at.format("name"))
    got = {(r.county, r.school): (r.tier, r.lat) for r in match.located(schools, register, manual, addresses, places, ["skole"]).collect()}
    assert got == {
        ("c", "Ask"): ("register", 60.0), ("c", "Bø"): ("manual", 59.0), ("c", "Dal"): ("address", 62.0), ("c", "Eik"): ("place", 63.0),
        ("c", "Fjell"): ("place", 64.0), ("c", "Gran"): ("unmatched", None), ("c", None): ("unmatched", None), ("d", "Ask"): ("unmatched", None),
    }


def test_addresses_of_pictures(spark):
    made = lambda f, *urls: [r[0] for r in spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string").select("i", f(F.col("u")).alias("o")).orderBy("i").select("o").collect()]
    assert made(text.displayed, "https://a.no/b.jpg?quality=9&c=&d=1&quality=8#top", "https://a.no/b.png", "https://a.no/b.gif", "https://a.no/b", None) == [
        "https://a.no/b.jpg?quality=75&d=1&width=960#top", "https://a.no/b.png?width=960&quality=75&format=jpg", "https://a.no/b.gif", "https://a.no/b", None,
    ]
    commons = "https://upload.wikimedia.org/wikipedia/commons/"
    assert made(text.thumbnail, commons + "a/ab/P.jpg?x", commons + "thumb/a/ab/P.jpg/3840px-P.jpg", commons + "thumb/a/ab/P.jpg/640px-P.jpg", commons + "a/ab/P.SVG", commons + "a", None) == [
        commons + "thumb/a/ab/P.jpg/960px-P.jpg", commons + "thumb/a/ab/P.jpg/960px-P.jpg", commons + "thumb/a/ab/P.jpg/640px-P.jpg", commons + "a/ab/P.SVG", commons + "a", "",
    ]
    assert made(text.is_email, "a@b.no", "a@b", "a b@c.no", "", None) == [True, False, False, False, None]
