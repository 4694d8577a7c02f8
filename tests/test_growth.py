"""Plans whose cost must not outgrow the tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.operators import match, sweeps
from panelforge.plans.panel import panel
from panelforge.queries import evaluation, layouts, panels
from panelforge.streaming import admission


def plan_of(rows: DataFrame) -> str:
    return rows._jdf.queryExecution().executedPlan().toString()


def test_lines_are_dealt_by_cell_before_they_are_grouped(spark, sf):
    """A task's groups are then the cells dealt to it, not one for nearly each line it reads."""
    plan = plan_of(panel(spark, sf))
    assert "REPARTITION_BY_COL" in plan
    assert "HashAggregate" not in plan[plan.rindex("REPARTITION_BY_COL") :]


def test_few_rows_go_to_the_forecasts(spark, sf):
    """Spreads and bridges have a few rows: forecasts are not shuffled by county to meet them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(evaluation.final_round_chance(spark, sf))
        assert "Exchange hashpartitioning(county" not in plan and "zq" not in plan
        chosen = plan_of(evaluation.choice_list(spark, sf))
        assert chosen.count("Exchange hashpartitioning(county") <= 1 and chosen.index("Generate") < chosen.index("Exchange hashpartitioning(county")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_cdf_of_a_known_table(spark):
    table = [0.0] + [1.0] * 20 + [2.0 + k / 7 for k in range(20)]
    zs = [None, float("nan"), -1.0, 0.0, 0.3, 1.0, 1.5, 2.0, 2.2, 4.714285714285714, 5.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double")
    want = stats.empirical_cdf(F.col("z"), F.array(*[F.lit(q) for q in table]))
    got = stats.with_cdf(rows, "z", table, "p").withColumn("want", want).collect()
    assert len(got) == len(zs) and all(r.p == r.want for r in got)


def test_samples_are_numbered_without_a_join(spark, sf):
    plan = plan_of(panels.samples(spark, sf, spark.createDataFrame([], panel(spark, sf).schema)))
    assert "Join" not in plan


def test_a_busy_sender_is_dealt_by_time(spark):
    """The count of the last seconds is that of a sliding frame, without looking at an event again for each that follows."""
    times = [0, 0, 3, 9, 10, 10, 11, 19, 20, 29, 30, 31, 55, -1, -10, -11]
    rows = spark.createDataFrame([(k, "a" if k < 13 else None, t) for k, t in enumerate(times)] + [(99, "a", None), (98, "a", None)], "id int, key string, t int")
    rows = rows.withColumn("ts", F.timestamp_seconds("t"))
    got = admission.limited(rows, "key", "ts", 10, 3)
    assert "_stretch" in plan_of(got)
    found = {r.id: (r.recent, r.limited) for r in got.collect()}
    for r in rows.collect():
        near = [o for o in rows.collect() if o.key == r.key and (o.t is None if r.t is None else o.t is not None and r.t - 10 < o.t <= r.t)]
        assert found[r.id] == (len(near), len(near) > 3)
    assert len(found) == rows.count() and got.columns == [*rows.columns, "recent", "limited"]


def test_documents_are_numbered_by_their_different_schools(spark):
    """What a task puts in order is a document's schools, each once; a missing key has a number as well."""
    rows = [("a", "x", 1), ("a", "x", 2), ("a", "y", 1), ("b", "y", 1), (None, "z", 1), (None, None, 2)]
    got = layouts._ranked(spark.createDataFrame(rows, "doc string, school string, n int"), ["doc"], "school", "sn", 1)
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(
        [("a", "x", 1, 1), ("a", "x", 2, 1), ("a", "y", 1, 2), ("b", "y", 1, 1), (None, None, 2, 1), (None, "z", 1, 2)], key=str
    )


def test_distances_are_taken_between_places(spark, monkeypatch):
    """Points of a place share its distances, in rows of bounded length that are dealt to all tasks; no pair is lost or doubled."""
    monkeypatch.setattr(match, "CAP", 4)
    at = [(60.0, 5.0)] * 30 + [(60.5, 5.5)] * 3 + [(60.5, 5.5 + 1e-9), (70.0, 5.0), (None, 5.0), (60.0, None)]
    ids = [*range(len(at) - 1), None]
    points = spark.createDataFrame([(i, *p) for i, p in zip(ids, at)] + [(None, 60.5, 5.5), (3, 60.0, 5.0)], "id int, lat double, lon double")
    got = match.within_km(points, points, 100.0, digits=3)
    plan = plan_of(got)
    assert "REPARTITION_BY_NUM" in plan and "ASIN" not in plan[: plan.index("REPARTITION_BY_NUM")]
    one, two = points.toDF("id_a", "lat_a", "lon_a"), points.toDF("id_b", "lat_b", "lon_b")
    km = F.round(stats.haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b")), 3)
    want = one.crossJoin(two).select("id_a", "id_b", km.alias("km")).where("km <= 100")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert max(len(r.ids_a) for r in match._places(points.where("lat is not null"), "a").collect()) < 20


def test_observations_are_read_once_by_all_sweeps(spark, tmp_path, monkeypatch):
    """Visits read the series' rows; none joins a table of series to observations. Both parts are swept at once."""
    cells = [("c", f"s{s}", f"p{p}", f"k{p % 2}", y, "open" if s == 2 else "num", 30.0 + s + p + y % 5, 0.5) for s in range(3) for p in range(2) for y in range(2018, 2022)]
    spark.createDataFrame(cells, "county string, school string, program string, category string, year int, state string, v double, w double").write.parquet(f"{tmp_path}/obs")
    plans, store = [], sweeps.stored
    monkeypatch.setattr(sweeps, "stored", lambda rows, name: plans.append(plan_of(rows)) or store(rows, name))
    found = sweeps.coefficients(spark.read.parquet(f"{tmp_path}/obs")).collect()
    assert sum(f"{tmp_path}/obs" in plan for plan in plans) == 1
    schools = {r.level: r for r in found if r.effect == "school"}
    assert set(schools) == {"s0", "s1", "s2"} and schools["s2"].m is None and schools["s2"].info is None and None not in (schools["s2"].eta, schools["s0"].m)
    numbers = spark.createDataFrame([c for c in cells if c[5] == "num"], "county string, school string, program string, category string, year int, state string, z double, w double")
    alone = {r.school: r.b for r in sweeps.swept(numbers)[2]["school"].collect()}
    assert alone.keys() == {"s0", "s1"} and all(abs(alone[s] - schools[s].m) < 1e-9 for s in alone)
