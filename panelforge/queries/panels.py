"""Exports of the panel, its bookkeeping and its baselines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.operators import baselines
from panelforge.plans.panel import OBS_SQL, PANEL_SQL, SERIES, observations, panel, table
from panelforge.plans.stored import stored

NAMES = {"points": "points", "open": "open", "F": "priority", "D": "documentation", "U": "discontinued"}


def samples(spark, sf_dir, cells: DataFrame | None = None) -> DataFrame:
    """Every cell as a row of the export, with the number of its series among those of the same name."""
    cells = panel(spark, sf_dir) if cells is None else cells
    place = Window.partitionBy("county", "school", F.lower("program")).orderBy("level", "program", "category")
    numbered = cells.withColumn("occurrence", F.dense_rank().over(place) - 1)  # all years of a series are of one rank
    status = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])[F.col("status")]
    return numbered.select(
        "county", "school", "program", "occurrence", "category", "level", "year", "round", "points", status.alias("status")
    )


SAMPLES_SQL = f"""
WITH {PANEL_SQL}, numbered AS (
  SELECT county, school, program, category, level,
    CAST(row_number() OVER (PARTITION BY county, school, lower(program) ORDER BY level, program) - 1 AS INTEGER) AS occurrence
  FROM (SELECT DISTINCT county, school, program, category, level FROM panel))
SELECT county, school, program, occurrence, category, level, year, round, points,
  CASE status WHEN 'F' THEN 'priority' ELSE status END AS status
FROM panel JOIN numbered USING (county, school, program, category, level)"""


def status_histogram(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("county", "status").agg(F.count(F.lit(1)).alias("n"))


def table_stats(spark, sf_dir):
    return panel(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_distinct("county", "school").alias("schools"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
        F.min("points").alias("least"),
        F.max("points").alias("most"),
    )


def global_years(spark, sf_dir):
    return panel(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"))


def series_trend(spark, sf_dir):
    """The filter reaches the scan of the dimension tables; years come in order."""
    return (
        panel(spark, sf_dir)
        .where((F.col("school") == "Supplier#000000001") & F.col("program").like("Brand#1%") & (F.col("status") == "points"))
        .select("program", "year", "points")
        .orderBy("program", "year")
    )


def school_pressure(spark, sf_dir):
    """Median threshold of each school in its newest year; open if none of its cells has a number above 0."""
    cells = panel(spark, sf_dir)
    years = cells.groupBy("county", "school", "year").agg(
        F.count_if(~F.col("status").isin("F", "U")).alias("n"),
        F.median(F.when(~F.col("status").isin("F", "U") & (F.col("points") > 0), F.col("points"))).alias("pressure"),
    )
    known = years.groupBy("county", "school").agg(F.max(F.struct(F.col("year").alias("newest"), "n", "pressure")).alias("of"))
    known = stored(known.select("county", "school", "of.*").withColumn("n", F.nullif("n", F.lit(0))), "pressure")
    known = known.crossJoin(known.agg(F.max("newest").alias("last")))  # one row
    fresh = F.col("newest") >= F.col("last") - 1
    outcome = F.when(~fresh, "stale").when(F.col("n").isNull(), "none").when(F.col("pressure").isNull(), "open").otherwise("points")
    shown = F.when(outcome == "points", F.col("pressure"))
    return known.select(
        "county", "school", "newest", outcome.alias("outcome"), shown.alias("pressure"),
        F.when(shown.isNotNull(), stats.colour_step(shown)).alias("step"),
    )


PRESSURE_SQL = f"""
WITH {PANEL_SQL}, newest AS (SELECT county, school, max(year) AS newest FROM panel GROUP BY ALL),
pool AS (
  SELECT n.county, n.school, n.newest, median(points) FILTER (points > 0) AS pressure, count(*) AS n
  FROM newest n JOIN panel p ON p.county = n.county AND p.school = n.school AND p.year = n.newest
  WHERE status NOT IN ('F', 'U') GROUP BY ALL),
judged AS (
  SELECT e.county, e.school, e.newest, CASE WHEN e.newest < (SELECT max(year) FROM panel) - 1 THEN 'stale'
    WHEN n IS NULL THEN 'none' WHEN pressure IS NULL THEN 'open' ELSE 'points' END AS outcome, pressure
  FROM newest e LEFT JOIN pool USING (county, school, newest))
SELECT county, school, newest, outcome, CASE WHEN outcome = 'points' THEN pressure END AS pressure,
  CASE WHEN outcome = 'points' THEN CASE WHEN pressure < 30 THEN 0 WHEN pressure < 34 THEN 1 WHEN pressure < 38 THEN 2
    WHEN pressure < 42 THEN 3 ELSE 4 END END AS step
FROM judged"""


def newest_year(spark, sf_dir):
    return panel(spark, sf_dir).groupBy("county").agg(F.max("year").alias("newest"))


def series_history(spark, sf_dir):
    return observations(panel(spark, sf_dir)).groupBy(*SERIES).agg(
        F.count_if(F.col("state") == "num").alias("history"), F.max("year").alias("last_year")
    )


def alive_series(spark, sf_dir):
    """Series seen on points or open in the county's newest year or the one before."""
    seen = observations(panel(spark, sf_dir)).groupBy(*SERIES).agg(F.max("year").alias("last_year"))
    return seen.join(newest_year(spark, sf_dir), "county").where(F.col("last_year") >= F.col("newest") - 1).drop("newest")


def round_exceptions(spark, sf_dir):
    """Pairs of years of a series that both come from one round other than the usual one."""
    return (
        panel(spark, sf_dir)
        .where("round is not null")
        .groupBy("county", "school", "program", (F.col("year") - F.col("year") % 2).alias("since"))
        .agg(F.count_distinct("round").alias("n"), F.min("round").alias("round"))
        .where((F.col("n") == 1) & ~F.col("round").eqNullSafe(F.lit("1")))
        .drop("n")
    )


def round_pairs(spark, sf_dir):
    return baselines.round_pairs(panel(spark, sf_dir))


PAIRS_SQL = PANEL_SQL + """, pairs AS (
  SELECT county, school, program, category, year, '1' AS main_round, '2' AS alt_round, v1 AS vm,
    CASE WHEN v1 > 3 THEN 'num' ELSE 'open' END AS main_state, v2 AS va, CASE WHEN v2 > 3 THEN 'num' ELSE 'open' END AS alt_state
  FROM panel WHERE v1 IS NOT NULL AND v2 IS NOT NULL)"""


def round_bridge(spark, sf_dir):
    return baselines.round_bridge(round_pairs(spark, sf_dir))


BRIDGE_SQL = f"""
WITH {PAIRS_SQL}
SELECT county, main_round AS from_round, alt_round AS to_round, category,
  count(*) FILTER (main_state = 'num' AND alt_state = 'num') AS n_pairs,
  round(avg(va - vm) FILTER (main_state = 'num' AND alt_state = 'num'), 6) AS mean,
  round(stddev_pop(va - vm) FILTER (main_state = 'num' AND alt_state = 'num'), 6) AS sd,
  count(*) FILTER (main_state IN ('num', 'zero')) AS n_had_queue,
  count(*) FILTER (main_state IN ('num', 'zero') AND alt_state = 'open') AS n_vanished,
  round(count(*) FILTER (main_state IN ('num', 'zero') AND alt_state = 'open')
    / greatest(1, count(*) FILTER (main_state IN ('num', 'zero'))), 6) AS share_vanished
FROM pairs GROUP BY GROUPING SETS ((county, main_round, alt_round), (county, main_round, alt_round, category))
HAVING count(*) FILTER (main_state = 'num' AND alt_state = 'num') > 0"""


def last_value_asof(spark, sf_dir):
    """For each cell, the newest earlier number of its series."""
    return baselines.last_value(observations(panel(spark, sf_dir)))


LAST_SQL = f"""
WITH {OBS_SQL}
SELECT o.county, o.school, o.program, o.year, p.year AS last_year, p.v AS last_v
FROM obs o ASOF LEFT JOIN (SELECT * FROM obs WHERE state = 'num') p
  ON o.county = p.county AND o.school = p.school AND o.program = p.program AND o.year > p.year"""


def asof_group_effect(spark, sf_dir):
    """A county-year effect (mean of the county less the mean of all) as it was known before every year."""
    num = observations(panel(spark, sf_dir)).where("state = 'num'")
    overall = num.agg(F.avg("v").alias("all"))
    effects = num.groupBy("county", "year").agg(F.avg("v").alias("mean")).crossJoin(overall)
    effects = effects.select("county", F.col("year").alias("known"), (F.col("mean") - F.col("all")).alias("effect"))
    wanted = num.select("county", "year").distinct()
    return (
        wanted.join(effects, "county")
        .where("known < year")
        .groupBy("county", "year")
        .agg(F.max_by("effect", "known").alias("effect"))
        .join(wanted, ["county", "year"], "right")
        .select("county", "year", F.round(F.coalesce("effect", F.lit(0.0)), 6).alias("effect"))
    )


EFFECT_SQL = f"""
WITH {OBS_SQL}, num AS (SELECT * FROM obs WHERE state = 'num'),
effects AS (SELECT county, year, avg(v) - (SELECT avg(v) FROM num) AS effect FROM num GROUP BY ALL)
SELECT w.county, w.year, round(coalesce(e.effect, 0.0), 6) AS effect
FROM (SELECT DISTINCT county, year FROM num) w ASOF LEFT JOIN effects e ON w.county = e.county AND w.year > e.year"""


def programme_mean_baseline(spark, sf_dir):
    num = observations(panel(spark, sf_dir)).where("state = 'num'")
    return num.groupBy("county", "program").agg(F.round(F.avg("v"), 6).alias("mean"), F.count(F.lit(1)).alias("n"))


def age_weighted_mean(spark, sf_dir):
    """Mean of a series with weights that halve every 4 years of age."""
    cells = panel(spark, sf_dir)
    newest = cells.groupBy("county").agg(F.max("year").alias("newest"))
    num = observations(cells).where("state = 'num'").join(newest, "county")
    w = stats.age_weight(F.col("newest"), F.col("year"), F.lit(4.0))
    return num.groupBy(*SERIES).agg(F.round(F.sum(w * F.col("v")) / F.sum(w), 6).alias("mean"), F.round(F.sum(w), 6).alias("weight"))


def unpivot_matrix(spark, sf_dir):
    """Years as columns and back again, as the wide source tables have them; the columns are the years there are."""
    cells = stored(panel(spark, sf_dir).where("status = 'points'"), "cells")
    years = [r.year for r in cells.select("year").distinct().orderBy("year").collect()]  # one row a year
    wide = cells.groupBy(*SERIES).pivot("year", years).agg(F.min("points"))
    named = wide.select(*SERIES, *[F.col(str(y)).alias(f"y{y}") for y in years])
    long = named.unpivot(SERIES, [f"y{y}" for y in years], "column", "points").where("points is not null")
    return long.select(*SERIES, F.substring("column", 2, 4).cast("int").alias("year"), "points")


def rw_innovations(spark, sf_dir):
    """Steps of a county's mean between years that follow each other in the data."""
    means = observations(panel(spark, sf_dir)).where("state = 'num'").groupBy("county", "year").agg(F.avg("v").alias("mean"))
    step = F.col("mean") - F.lag("mean").over(Window.partitionBy("county").orderBy("year"))
    return means.select("county", "year", F.round(step, 6).alias("step")).where("step is not null")


def variance_component(spark, sf_dir):
    """Spread of school effects: mean squared effect plus its posterior variance, at least 0.3 as a standard deviation."""
    num = observations(panel(spark, sf_dir)).where("state = 'num'")
    mu = num.agg(F.avg("v").alias("mu"), F.var_pop("v").alias("s2"))
    schools = num.groupBy("county", "school").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")).crossJoin(mu)
    effect, post = F.col("mean") - F.col("mu"), 1.0 / (F.col("n") / F.col("s2") + 1.0 / 16.0)
    return schools.groupBy("county").agg(F.round(F.greatest(F.lit(0.3), F.sqrt(F.avg(effect * effect + post))), 6).alias("tau"))


def yearly_moves(spark, sf_dir):
    """How far thresholds move from one year to the next."""
    num = observations(panel(spark, sf_dir)).where("state = 'num'")
    w = Window.partitionBy(*SERIES).orderBy("year")
    moves = num.withColumns({"move": F.col("v") - F.lag("v").over(w), "gap": F.col("year") - F.lag("year").over(w)}).where("gap = 1")
    return moves.groupBy("county").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.stddev_pop("move"), 6).alias("sd"),
        F.round(F.avg((F.abs("move") <= 3).cast("double")), 6).alias("within3"),
    )


def outlier_topk(spark, sf_dir):
    """The 25 cells furthest from their series' mean in standard deviations of their county."""
    num = observations(panel(spark, sf_dir)).where("state = 'num'")
    fitted = num.groupBy(*SERIES).agg(F.avg("v").alias("fitted"))
    sigma = num.groupBy("county").agg(F.stddev_pop("v").alias("sigma"))
    z = num.join(fitted, SERIES).join(sigma, "county").withColumn("z", F.round((F.col("v") - F.col("fitted")) / F.col("sigma"), 6))
    return (
        z.select(*SERIES, "year", "v", F.round("fitted", 6).alias("fitted"), "z")
        .orderBy(F.abs("z").desc(), *SERIES, "year")
        .limit(25)
    )


def outlier_counts(spark, sf_dir):
    num = observations(panel(spark, sf_dir)).where("state = 'num'")
    sums = num.groupBy("county").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    z = (F.col("v") - F.col("m")) / F.col("s")
    return num.join(sums, "county").groupBy("county").agg(F.count_if(F.abs(z) > 1.5).alias("far"), F.count(F.lit(1)).alias("n"))


def effect_rank(spark, sf_dir):
    """Schools by mean threshold, with the standard error of a shrunken mean. One row for each school is ranked."""
    num = observations(panel(spark, sf_dir)).where("state = 'num'")
    schools = num.groupBy("county", "school").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.orderBy(F.round("mean", 6).desc(), "county", "school"))
    se = F.sqrt(1.0 / (F.col("n") / 100.0 + 1.0 / 16.0))
    return schools.select("county", "school", F.round("mean", 6).alias("alpha"), F.round(se, 6).alias("alpha_se"), "n", place.alias("rank"))


def nested_dataset(spark, sf_dir):
    """The nested JSON form, one line a school: programmes in order of level and name, values in order of year."""
    from panelforge.sinks.nested import nested_schools

    return nested_schools(panel(spark, sf_dir)).select("county", "school", F.to_json(F.struct("programs")).alias("json"))


def backtest_export(spark, sf_dir):
    """The backtest file's rows: keys split, numbers rounded, null as an empty text."""
    last = last_value_asof(spark, sf_dir)
    key = F.concat_ws("|", *SERIES)
    parts = F.split(key, "[|]")
    return last.select(
        "year", *[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate(SERIES)],
        F.coalesce(F.round("last_v", 1).cast("string"), F.lit("")).alias("last_year_value"),
    )


Q = lambda s: f"WITH {OBS_SQL} {s}"
P = lambda s: f"WITH {PANEL_SQL} {s}"
QUERIES = {
    "samples_export": (samples, SAMPLES_SQL),
    "status_histogram": (status_histogram, P("SELECT county, status, count(*) AS n FROM panel GROUP BY ALL")),
    "table_stats": (table_stats, P("""SELECT count(*) AS cells, count(DISTINCT county || '|' || school) AS schools,
      min(year) AS first_year, max(year) AS last_year, min(points) AS least, max(points) AS most FROM panel""")),
    "global_years": (global_years, P("SELECT string_agg(y, ',' ORDER BY y) AS years FROM (SELECT DISTINCT CAST(year AS VARCHAR) AS y FROM panel)")),
    "series_trend": (series_trend, P("""SELECT program, year, points FROM panel
      WHERE school = 'Supplier#000000001' AND program LIKE 'Brand#1%' AND status = 'points'""")),
    "school_pressure": (school_pressure, PRESSURE_SQL),
    "newest_year": (newest_year, P("SELECT county, max(year) AS newest FROM panel GROUP BY county")),
    "series_history": (series_history, Q("""SELECT county, school, program, count(*) FILTER (state = 'num') AS history,
      max(year) AS last_year FROM obs GROUP BY ALL""")),
    "alive_series": (alive_series, Q("""SELECT county, school, program, max(year) AS last_year FROM obs
      JOIN (SELECT county, max(year) AS newest FROM panel GROUP BY county) n USING (county)
      GROUP BY county, school, program, newest HAVING max(year) >= newest - 1""")),
    "round_exceptions": (round_exceptions, P("""SELECT county, school, program, CAST(year - year % 2 AS INTEGER) AS since, min(round) AS round FROM panel
      WHERE round IS NOT NULL GROUP BY ALL HAVING count(DISTINCT round) = 1 AND min(round) IS DISTINCT FROM '1'""")),
    "round_pairs": (round_pairs, f"WITH {PAIRS_SQL} SELECT * FROM pairs"),
    "round_bridge": (round_bridge, BRIDGE_SQL),
    "last_value_asof": (last_value_asof, LAST_SQL),
    "asof_group_effect": (asof_group_effect, EFFECT_SQL),
    "programme_mean_baseline": (programme_mean_baseline, Q("""SELECT county, program, round(avg(v), 6) AS mean, count(*) AS n
      FROM obs WHERE state = 'num' GROUP BY ALL""")),
    "age_weighted_mean": (age_weighted_mean, Q(""", w AS (
      SELECT o.*, pow(0.5, (n.newest - o.year) / 4.0) AS w FROM obs o
      JOIN (SELECT county, max(year) AS newest FROM panel GROUP BY county) n USING (county) WHERE state = 'num')
      SELECT county, school, program, round(sum(w * v) / sum(w), 6) AS mean, round(sum(w), 6) AS weight FROM w GROUP BY ALL""")),
    "unpivot_matrix": (unpivot_matrix, P("SELECT county, school, program, year, points FROM panel WHERE status = 'points'")),
    "rw_innovations": (rw_innovations, Q(""", m AS (SELECT county, year, avg(v) AS mean FROM obs WHERE state = 'num' GROUP BY ALL),
      s AS (SELECT county, year, round(mean - lag(mean) OVER (PARTITION BY county ORDER BY year), 6) AS step FROM m)
      SELECT * FROM s WHERE step IS NOT NULL""")),
    "variance_component": (variance_component, Q(""", mu AS (SELECT avg(v) AS mu, var_pop(v) AS s2 FROM obs WHERE state = 'num'),
      s AS (SELECT county, school, avg(v) - (SELECT mu FROM mu) AS effect, 1.0 / (count(*) / (SELECT s2 FROM mu) + 1.0 / 16.0) AS post
        FROM obs WHERE state = 'num' GROUP BY ALL)
      SELECT county, round(greatest(0.3, sqrt(avg(effect * effect + post))), 6) AS tau FROM s GROUP BY county""")),
    "yearly_moves": (yearly_moves, Q(""", m AS (
      SELECT county, v - lag(v) OVER w AS move, year - lag(year) OVER w AS gap FROM obs WHERE state = 'num'
      WINDOW w AS (PARTITION BY county, school, program ORDER BY year))
      SELECT county, count(*) AS n, round(stddev_pop(move), 6) AS sd, round(avg(CASE WHEN abs(move) <= 3 THEN 1.0 ELSE 0.0 END), 6) AS within3
      FROM m WHERE gap = 1 GROUP BY county""")),
    "outlier_topk": (outlier_topk, Q(""", z AS (
      SELECT county, school, program, year, v, avg(v) OVER (PARTITION BY county, school, program) AS fitted,
        stddev_pop(v) OVER (PARTITION BY county) AS sigma FROM obs WHERE state = 'num')
      SELECT county, school, program, year, v, round(fitted, 6) AS fitted, round((v - fitted) / sigma, 6) AS z FROM z
      ORDER BY abs(round((v - fitted) / sigma, 6)) DESC, county, school, program, year LIMIT 25""")),
    "outlier_counts": (outlier_counts, Q(""", z AS (
      SELECT county, (v - avg(v) OVER w) / stddev_pop(v) OVER w AS z FROM obs WHERE state = 'num' WINDOW w AS (PARTITION BY county))
      SELECT county, count(*) FILTER (abs(z) > 1.5) AS far, count(*) AS n FROM z GROUP BY county""")),
    "effect_rank": (effect_rank, Q(""", s AS (
      SELECT county, school, round(avg(v), 6) AS alpha, round(sqrt(1.0 / (count(*) / 100.0 + 1.0 / 16.0)), 6) AS alpha_se, count(*) AS n
      FROM obs WHERE state = 'num' GROUP BY ALL)
      SELECT *, CAST(row_number() OVER (ORDER BY alpha DESC, county, school) AS INTEGER) AS rank FROM s""")),
    "nested_dataset": (nested_dataset, None),
    "backtest_export": (backtest_export, f"""WITH last AS ({LAST_SQL.strip()})
      SELECT year, county, school, program, coalesce(CAST(round(last_v, 1) AS VARCHAR), '') AS last_year_value FROM last"""),
}
