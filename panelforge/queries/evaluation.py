"""Evaluation of forecasts: errors, calibration, reliability and chances.

The predictor here is a closed form (a shrunken mean), so that every figure has a SQL twin; the fitted model's forecasts have
the same columns and go through the same functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.operators import baselines
from panelforge.operators.baselines import WALK_SQL
from panelforge.plans.panel import OBS_SQL, observations, panel, table
from panelforge.plans.stored import stored

CALIBRATION = (1998, 1999)
LEAST_PAIRS = 10  # pairs of a category from which its own bridge is used


def predictions(spark, sf_dir, cells: DataFrame | None = None) -> DataFrame:
    """The forecasts of all years that have an earlier one. They are written once, as is the panel they are made from (or given
    as ``cells``): the order lines are read once, whatever a query makes of them."""
    cells = stored(panel(spark, sf_dir), "panel") if cells is None else cells
    return stored(baselines.walk_forward(observations(cells)), "predictions")


def error_report(preds: DataFrame) -> DataFrame:
    """Errors of the forecast and of two rules of thumb, for each range of history and over all."""
    num = preds.where("state = 'num'").select(
        stats.history_bucket(F.col("hist")).alias("bucket"), (F.col("v") - F.col("m")).alias("e"),
        (F.col("v") - F.col("last")).alias("el"), (F.col("v") - F.col("pm")).alias("ep"),
    )
    rmse = lambda c: F.round(F.sqrt(F.avg(F.col(c) * F.col(c))), 6)
    within = lambda c: F.round(F.avg((F.abs(c) <= 3).cast("double")), 6)
    return num.groupingSets([["bucket"], []], "bucket").agg(
        F.count(F.lit(1)).alias("n"), rmse("e").alias("rmse"), F.round(F.avg("e"), 6).alias("bias"), F.round(F.stddev_pop("e"), 6).alias("sd"),
        within("e").alias("within3"), rmse("el").alias("rmse_last_year"), within("el").alias("within3_last_year"), rmse("ep").alias("rmse_prog_mean"),
    )


def spreads(preds: DataFrame, residual: float = 2.0, support: int = 30) -> DataFrame:
    """(bucket, s): spread by history on the calibration years; thin buckets take the largest of the others."""
    e = F.col("v") - F.col("m")
    found = (
        preds.where((F.col("state") == "num") & F.col("T").isin(*CALIBRATION))
        .groupBy(stats.history_bucket(F.col("hist")).alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"))
        .where(F.col("n") >= support)
    )
    buckets = preds.sparkSession.range(len(stats.BUCKETS)).select(F.col("id").cast("int").alias("bucket"))
    most = found.agg(F.max("rmse").alias("most"))
    return buckets.join(found, "bucket", "left").crossJoin(most).select(  # both sides are a few rows
        "bucket", F.greatest(F.coalesce("rmse", "most", F.lit(residual)), F.lit(residual)).alias("s")
    )


def with_spread(preds: DataFrame) -> DataFrame:
    return preds.withColumn("bucket", stats.history_bucket(F.col("hist"))).join(F.broadcast(spreads(preds)), "bucket")  # four rows


def quantile_table(preds: DataFrame) -> DataFrame:
    """One row: the 41 quantiles of standardised errors on the calibration years."""
    z = (F.col("v") - F.col("m")) / F.col("s")
    return (
        with_spread(preds)
        .where((F.col("state") == "num") & F.col("T").isin(*CALIBRATION))
        .agg(F.percentile(z, stats.QUANTILES).alias("q"))
        .select(F.transform("q", lambda x: F.round(x, 3)).alias("zq"))
    )


def walk_forward_baseline(spark, sf_dir):
    return error_report(predictions(spark, sf_dir))


def history_buckets(spark, sf_dir):
    return predictions(spark, sf_dir).groupBy("T", stats.history_bucket(F.col("hist")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def sigma_calibration(spark, sf_dir):
    return spreads(predictions(spark, sf_dir)).select("bucket", F.round("s", 6).alias("s"))


def error_quantiles(spark, sf_dir):
    return quantile_table(predictions(spark, sf_dir)).select(F.posexplode("zq").alias("k", "z"))


def interval_coverage(spark, sf_dir):
    rows = with_spread(predictions(spark, sf_dir)).where("state = 'num'")
    inside = F.abs(F.col("v") - F.col("m")) <= stats.COVERAGE_80 * F.col("s")
    return rows.groupBy("T").agg(F.round(F.avg(inside.cast("double")), 6).alias("coverage"), F.count(F.lit(1)).alias("n"))


def brier_scores(spark, sf_dir):
    """Brier score of the fill probability and of the base rate; the base rate is a one-row aggregate."""
    y = (F.col("state") != "open").cast("double")
    rows = predictions(spark, sf_dir).select("T", y.alias("y"), "pi")
    base = rows.agg(F.avg("y").alias("base"))
    return rows.crossJoin(base).groupBy("T").agg(
        F.round(F.avg(F.pow(F.col("y") - F.col("pi"), 2)), 6).alias("brier"),
        F.round(F.avg(F.pow(F.col("y") - F.col("base"), 2)), 6).alias("brier_base_rate"),
        F.round(F.max("base"), 6).alias("base_rate"),
    )


def log_loss(spark, sf_dir):
    y = (F.col("state") != "open").cast("double")
    q = F.least(F.greatest(F.col("pi"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return predictions(spark, sf_dir).groupBy("T").agg(
        F.round(-F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q)), 6).alias("log_loss"), F.count(F.lit(1)).alias("n")
    )


def _scored(preds: DataFrame, *by: str) -> tuple[DataFrame, list[float] | None]:
    """Each forecast with its spread at eight applicant scores, and the 41 quantiles, or none without calibration years.

    With ``by``, forecasts are dealt by these columns before each becomes eight rows.
    """
    quantiles = quantile_table(preds).first()["zq"]
    rows = with_spread(preds).repartition(*by) if by else with_spread(preds)
    return rows.withColumn("x", F.explode(F.array(*[F.lit(float(x)) for x in stats.SCORES]))), quantiles


def _chances(preds: DataFrame) -> DataFrame:
    """Each forecast at eight applicant scores, with the outcome."""
    return _with_chances(*_scored(preds))


def _with_chances(scored: DataFrame, quantiles: list[float] | None) -> DataFrame:
    got = F.when(F.col("state").isin("open", "zero"), 1.0).otherwise((F.col("x") >= F.col("v")).cast("double"))
    chance = lambda cdf: (1.0 - F.col("pi")) + F.col("pi") * cdf
    placed = stats.with_cdf(scored.withColumn("z", (F.col("x") - F.col("m")) / F.col("s")), "z", quantiles, "cdf")
    return placed.select(
        "county", "school", "program", "category", "T", "x", "m", "s", "pi", "last", got.alias("y"),
        chance(F.col("cdf")).alias("p"), chance(stats.normal_cdf(F.col("z"))).alias("p_normal"),
    )


def reliability_table(spark, sf_dir):
    """Deciles of predicted chance (rounded to 9 digits first) against what happened."""
    rows = _chances(predictions(spark, sf_dir)).withColumn("p", F.round("p", 9))
    return rows.groupBy(stats.decile(F.col("p")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed")
    )


def chance_scores(spark, sf_dir):
    """Brier scores of the empirical and the normal chance, and of the rule that last year's figure decides."""
    rule = (F.col("x") >= F.col("last")).cast("double")
    sq = lambda p: F.round(F.avg(F.pow(p - F.col("y"), 2)), 6)
    return _chances(predictions(spark, sf_dir)).groupBy("T").agg(
        sq(F.col("p")).alias("brier"), sq(F.col("p_normal")).alias("brier_normal"), sq(rule).alias("brier_last_year"),
        F.count("last").alias("n_last_year"),
    )


def chance_ecdf(spark, sf_dir):
    """Every forecast at every score, by the empirical and by the normal distribution."""
    rows = _chances(predictions(spark, sf_dir))
    return rows.select("county", "school", "program", "T", "x", F.round("p", 6).alias("p"), F.round("p_normal", 6).alias("p_normal"))


def _final(spark, sf_dir) -> DataFrame:
    """Chances before and after the later round, by the bridge of the category where it has enough pairs, else the county's.

    The bridge has a row for each county and category, so it goes to where the forecasts are.
    """
    cells = stored(panel(spark, sf_dir), "panel")
    bridge = stored(baselines.round_bridge(baselines.round_pairs(cells)), "bridge")
    shifts = F.struct(F.col("mean").alias("shift"), F.col("share_vanished").alias("gone"))
    county = bridge.where("category is null").select("county", shifts.alias("of_county"))
    kind = bridge.where(f"category is not null and n_pairs >= {LEAST_PAIRS}").select("county", "category", shifts.alias("of_kind"))
    scored, quantiles = _scored(predictions(spark, sf_dir, cells))
    rows = _with_chances(scored, quantiles).join(F.broadcast(county), "county", "left").join(F.broadcast(kind), ["county", "category"], "left")
    by = F.coalesce("of_kind", "of_county")
    rows = rows.withColumns({"gone": F.coalesce(by["gone"], F.lit(0.0)), "shift": F.coalesce(by["shift"], F.lit(0.0))})
    rows = rows.withColumn("zf", (F.col("x") - F.col("m") - F.col("shift")) / F.col("s"))
    gone = F.col("gone")
    return stats.with_cdf(rows, "zf", quantiles, "cdf").withColumn("p_final", (1.0 - F.col("pi")) + F.col("pi") * (gone + (1.0 - gone) * F.col("cdf")))


def final_round_chance(spark, sf_dir):
    return _final(spark, sf_dir).select(
        "county", "school", "program", "T", "x", F.round("p", 6).alias("p"), F.round("p_final", 6).alias("p_final")
    )


def choice_list(spark, sf_dir):
    """For each school, year and score, a list of all its programmes: the chance of at least one place, and bands."""
    rows = _with_chances(*_scored(predictions(spark, sf_dir), "county", "school", "T")).withColumn("p", F.round("p", 9))
    band = stats.band(F.col("p"))
    return rows.groupBy("county", "school", "T", "x").agg(
        F.round(1 - F.exp(F.sum(F.ln(F.greatest(1 - F.col("p"), F.lit(1e-12))))), 6).alias("any_place"),
        *[F.count_if(band == b).alias(b) for b in ("likely", "possible", "unlikely")],
    )


def labels_brier(spark, sf_dir):
    """Brier score and reliability bins of a made-up probability on the labels table."""
    rows = table(spark, sf_dir, "labels").where("quality is not null").select(
        (F.col("doc_id") * 37 % 101 / 100.0).alias("p"), F.col("quality").cast("double").alias("y")
    )
    return rows.groupBy(stats.decile(F.col("p")).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("predicted"), F.round(F.avg("y"), 6).alias("observed"),
        F.round(F.avg(F.pow(F.col("p") - F.col("y"), 2)), 6).alias("brier"),
    )


BUCKET = "CASE WHEN hist = 0 THEN 0 WHEN hist = 1 THEN 1 WHEN hist IN (2, 3) THEN 2 ELSE 3 END"
PREDS = OBS_SQL + WALK_SQL
SPREADS = PREDS + f""",
found AS (
  SELECT {BUCKET} AS bucket, sqrt(avg((v - m) * (v - m))) AS rmse FROM preds WHERE state = 'num' AND T IN {CALIBRATION}
  GROUP BY 1 HAVING count(*) >= 30),
spreads AS (
  SELECT CAST(b.bucket AS INTEGER) AS bucket, greatest(coalesce(rmse, (SELECT max(rmse) FROM found), 2.0), 2.0) AS s
  FROM (SELECT unnest([0, 1, 2, 3]) AS bucket) b LEFT JOIN found USING (bucket)),
spread AS (SELECT p.*, s.bucket, s.s FROM (SELECT *, {BUCKET} AS b FROM preds) p JOIN spreads s ON s.bucket = p.b)"""
TABLE = SPREADS + f""",
zq AS (
  SELECT list_transform(quantile_cont((v - m) / s, [{", ".join(map(str, stats.QUANTILES))}]), lambda q: round(q, 3)) AS zq
  FROM spread WHERE state = 'num' AND T IN {CALIBRATION})"""
ECDF = """greatest(0.005, least(0.995, CASE WHEN len(list_filter(zq, lambda q: q <= {z})) = 0 THEN 0.0
  WHEN len(list_filter(zq, lambda q: q <= {z})) >= 41 THEN 1.0
  ELSE (len(list_filter(zq, lambda q: q <= {z})) - 1 + ({z} - zq[len(list_filter(zq, lambda q: q <= {z}))])
    / (zq[len(list_filter(zq, lambda q: q <= {z})) + 1] - zq[len(list_filter(zq, lambda q: q <= {z}))])) / 40.0 END))"""
ERF = """(1.0 - ((((1.061405429 * u - 1.453152027) * u + 1.421413741) * u - 0.284496736) * u + 0.254829592) * u * exp(-a * a))"""
CHANCES = TABLE + f""",
grid AS (
  SELECT county, school, program, category, T, state, v, CAST(unnest([20, 25, 30, 35, 40, 45, 50, 55]) AS DOUBLE) AS x, m, s, pi, last, zq
  FROM spread, zq),
zs AS (SELECT *, (x - m) / s AS z, abs((x - m) / s) / sqrt(2.0) AS a, 1.0 / (1.0 + 0.3275911 * (abs((x - m) / s) / sqrt(2.0))) AS u FROM grid),
chances AS (
  SELECT county, school, program, category, T, x, m, s, pi, last, zq,
    CASE WHEN state IN ('open', 'zero') OR x >= v THEN 1.0 ELSE 0.0 END AS y,
    (1.0 - pi) + pi * {ECDF.format(z="z")} AS p,
    (1.0 - pi) + pi * 0.5 * (1.0 + CASE WHEN z < 0 THEN -{ERF} ELSE {ERF} END) AS p_normal
  FROM zs)"""
FINAL = CHANCES + f""",
pairs AS (SELECT county, category, v2 - v1 AS d, v1 > 3 AS early, v2 > 3 AS late FROM panel WHERE v1 IS NOT NULL AND v2 IS NOT NULL),
bridge AS (
  SELECT county, category, count(*) FILTER (early AND late) AS n, round(avg(d) FILTER (early AND late), 6) AS shift,
    round(count(*) FILTER (early AND NOT late) / greatest(1, count(*) FILTER (early)), 6) AS gone
  FROM pairs GROUP BY GROUPING SETS ((county), (county, category)) HAVING count(*) FILTER (early AND late) > 0),
shifted AS (
  SELECT c.*, coalesce(k.gone, b.gone, 0.0) AS gone, (x - m - coalesce(k.shift, b.shift, 0.0)) / s AS zf FROM chances c
  LEFT JOIN bridge b ON b.county = c.county AND b.category IS NULL
  LEFT JOIN bridge k ON k.county = c.county AND k.category = c.category AND k.n >= {LEAST_PAIRS}),
final AS (SELECT *, (1.0 - pi) + pi * (gone + (1.0 - gone) * {ECDF.format(z="zf")}) AS p_final FROM shifted)"""

QUERIES = {
    "walk_forward_baseline": (walk_forward_baseline, f"""WITH {PREDS}, e AS (
      SELECT {BUCKET} AS bucket, v - m AS e, v - last AS el, v - pm AS ep FROM preds WHERE state = 'num')
      SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(e), 6) AS bias,
        round(stddev_pop(e), 6) AS sd, round(avg(CASE WHEN abs(e) <= 3 THEN 1.0 ELSE 0.0 END), 6) AS within3,
        round(sqrt(avg(el * el)), 6) AS rmse_last_year,
        round(avg(CASE WHEN abs(el) <= 3 THEN 1.0 WHEN abs(el) > 3 THEN 0.0 END), 6) AS within3_last_year,
        round(sqrt(avg(ep * ep)), 6) AS rmse_prog_mean
      FROM e GROUP BY GROUPING SETS ((bucket), ())"""),
    "history_buckets": (history_buckets, f"WITH {PREDS} SELECT T, CAST({BUCKET} AS INTEGER) AS bucket, count(*) AS n FROM preds GROUP BY 1, 2"),
    "sigma_calibration": (sigma_calibration, f"WITH {SPREADS} SELECT bucket, round(s, 6) AS s FROM spreads"),
    "error_quantiles": (error_quantiles, f"WITH {TABLE} SELECT CAST(generate_subscripts(zq, 1) - 1 AS INTEGER) AS k, unnest(zq) AS z FROM zq"),
    "interval_coverage": (interval_coverage, f"""WITH {SPREADS} SELECT T,
      round(avg(CASE WHEN abs(v - m) <= 1.2816 * s THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS n
      FROM spread WHERE state = 'num' GROUP BY T"""),
    "brier_scores": (brier_scores, f"""WITH {PREDS}, y AS (SELECT T, pi, CASE WHEN state <> 'open' THEN 1.0 ELSE 0.0 END AS y FROM preds),
      b AS (SELECT avg(y) AS base FROM y)
      SELECT T, round(avg(pow(y - pi, 2)), 6) AS brier, round(avg(pow(y - base, 2)), 6) AS brier_base_rate, round(max(base), 6) AS base_rate
      FROM y, b GROUP BY T"""),
    "log_loss": (log_loss, f"""WITH {PREDS}, y AS (SELECT T, CASE WHEN state <> 'open' THEN 1.0 ELSE 0.0 END AS y,
      least(greatest(pi, 1e-6), 1 - 1e-6) AS q FROM preds)
      SELECT T, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 6) AS log_loss, count(*) AS n FROM y GROUP BY T"""),
    "reliability_table": (reliability_table, f"""WITH {CHANCES}, r AS (SELECT round(p, 9) AS p, y FROM chances)
      SELECT CAST(least(greatest(trunc(p * 10), 0), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed
      FROM r GROUP BY 1"""),
    "chance_scores": (chance_scores, f"""WITH {CHANCES} SELECT T, round(avg(pow(p - y, 2)), 6) AS brier, round(avg(pow(p_normal - y, 2)), 6) AS brier_normal,
      round(avg(pow(CASE WHEN x >= last THEN 1.0 WHEN x < last THEN 0.0 END - y, 2)), 6) AS brier_last_year, count(last) AS n_last_year
      FROM chances GROUP BY T"""),
    "chance_ecdf": (chance_ecdf, f"""WITH {CHANCES} SELECT county, school, program, T, x, round(p, 6) AS p, round(p_normal, 6) AS p_normal
      FROM chances"""),
    "final_round_chance": (final_round_chance, f"""WITH {FINAL} SELECT county, school, program, T, x, round(p, 6) AS p, round(p_final, 6) AS p_final
      FROM final"""),
    "choice_list": (choice_list, f"""WITH {CHANCES}, r AS (SELECT county, school, T, x, round(p, 9) AS p FROM chances)
      SELECT county, school, T, x, round(1 - exp(sum(ln(greatest(1 - p, 1e-12)))), 6) AS any_place, count(*) FILTER (p >= 0.7) AS likely,
        count(*) FILTER (p >= 0.35 AND p < 0.7) AS possible, count(*) FILTER (p < 0.35) AS unlikely
      FROM r GROUP BY ALL"""),
    "labels_brier": (labels_brier, """WITH r AS (SELECT doc_id * 37 % 101 / 100.0 AS p, CAST(quality AS DOUBLE) AS y FROM labels WHERE quality IS NOT NULL)
      SELECT CAST(least(greatest(trunc(p * 10), 0), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS predicted, round(avg(y), 6) AS observed,
        round(avg(pow(p - y, 2)), 6) AS brier FROM r GROUP BY 1"""),
}
