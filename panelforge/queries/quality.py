"""Checks as queries: what they return are the rows, or the numbers of rows, that break a rule."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.plans.panel import PANEL_SQL, SERIES, panel, table
from panelforge.queries import evaluation


def quality_report(spark, sf_dir):
    """How many rows break each rule: range, status, uniqueness, references, nulls, status against number.

    One pass over the panel's cells by series and year, one over orders and their lines by order key.
    """
    cells, lines, orders = panel(spark, sf_dir), table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    of_row = {
        "range": (F.col("points") < 0) | (F.col("points") > 65),
        "status": ~F.col("status").isin("points", "open", "F", "D", "U"),
        "null_key": F.col("school").isNull() | F.col("program").isNull() | F.col("year").isNull(),
        "number_without_status": (F.col("status") == "points") != F.col("points").isNotNull(),
    }
    series_years = cells.groupBy(*SERIES, "year").agg(
        F.count(F.lit(1)).alias("rows"), *[F.count_if(broken).alias(rule) for rule, broken in of_row.items()]
    )
    of_panel = series_years.agg(F.count_if(F.col("rows") > 1).alias("unique_series_year"), *[F.sum(r).alias(r) for r in of_row])
    per_order = (
        lines.groupBy("l_orderkey", "l_linenumber")
        .agg(F.count(F.lit(1)).alias("rows"))
        .groupBy("l_orderkey")
        .agg(F.sum("rows").alias("lines"), F.count_if(F.col("rows") > 1).alias("repeated"))
    )
    keys = orders.groupBy("o_orderkey").agg(F.count(F.lit(1)).alias("orders"))
    of_orders = per_order.join(keys, F.col("l_orderkey") == F.col("o_orderkey"), "full").agg(
        F.sum("repeated").alias("unique_line"),
        F.sum(F.when(F.col("orders").isNull(), F.col("lines"))).alias("order_reference"),
        F.sum(F.when(F.col("lines").isNull(), F.col("orders"))).alias("order_without_lines"),
    )
    counts = [one.na.fill(0).unpivot([], one.columns, "rule", "n") for one in (of_panel, of_orders)]
    return counts[0].unionByName(counts[1])


def name_defects(spark, sf_dir):
    """Names that end in a number, and names that hold a status word."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", "p_name").alias("name"))
    number, word = F.col("name").rlike("[0-9]+$"), F.lower("name").rlike("(promo|open)")
    return part.where(number | word).select("p_partkey", number.alias("trailing_number"), word.alias("status_word"))


def chance_monotone(spark, sf_dir):
    """Forecasts whose chance falls as the applicant's score rises; there should be none."""
    rows = evaluation._chances(evaluation.predictions(spark, sf_dir))
    w = Window.partitionBy(*SERIES, "T").orderBy("x")
    steps = rows.select(*SERIES, "T", "x", "p", (F.col("p") - F.lag("p").over(w)).alias("step"))
    return steps.agg(
        F.count_if(F.col("step") < -1e-9).alias("falls"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("outside"), F.count(F.lit(1)).alias("n")
    )


def quantiles_sorted(spark, sf_dir):
    q = evaluation.quantile_table(evaluation.predictions(spark, sf_dir))
    return q.select((F.array_sort("zq") == F.col("zq")).alias("sorted"), F.size("zq").alias("n"), F.get("zq", F.lit(20)).between(-0.6, 0.6).alias("centred"))


def spread_checks(spark, sf_dir):
    """Spreads by history, and whether each is positive and not below the residual floor."""
    return evaluation.spreads(evaluation.predictions(spark, sf_dir)).select("bucket", (F.col("s") >= 2.0).alias("above_floor"))


def final_not_below(spark, sf_dir):
    """Chances that a later round would lower; where thresholds only fall there are none."""
    rows = evaluation._final(spark, sf_dir)
    return rows.agg(F.count_if(F.col("p_final") < F.col("p") - 1e-9).alias("below"), F.count(F.lit(1)).alias("n"))


def photo_rejects(spark, sf_dir):
    """Pictures with sizes made of order keys: accepted, or the first reason against them."""
    w, h = 300 + F.col("o_orderkey") % 900, 200 + F.col("o_custkey") % 700
    ratio = F.round(w / h, 6)
    reason = (
        F.when((w < 560) | (h < 300), "small").when(~ratio.between(1.05, 3.6), "aspect").otherwise("ok")
    )
    return table(spark, sf_dir, "orders").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def photo_accepted(spark, sf_dir):
    """Per customer the chosen order by position and up to two others, as a picture and its alternates."""
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    ranked = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.row_number().over(w).alias("k")).where("k <= 3")
    kept = ranked.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("k", "o_orderkey"))).alias("a"))
    picks = F.transform("a", lambda x: x["o_orderkey"])
    return kept.select("o_custkey", F.get(picks, F.lit(0)).alias("photo"), F.array_join(F.slice(picks, 2, 2).cast("array<string>"), ",").alias("alternates"))


def link_health(spark, sf_dir):
    """Status codes made of page ids, judged."""
    code = F.get(F.array(*[F.lit(c) for c in (200, 301, 404, 410, 429, 503)]), (F.col("page_id") % 6).cast("int"))
    health = F.when(code.between(200, 399), "OK").when(code.isin(429, 503), "THROTTLED").otherwise("DEAD")
    return table(spark, sf_dir, "pages").groupBy(health.alias("health")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {
    "quality_report": (quality_report, f"""WITH {PANEL_SQL}
      SELECT 'range' AS rule, count(*) AS n FROM panel WHERE points < 0 OR points > 65
      UNION ALL SELECT 'status', count(*) FROM panel WHERE status NOT IN ('points', 'open', 'F', 'D', 'U')
      UNION ALL SELECT 'unique_series_year', count(*) FROM (SELECT 1 FROM panel GROUP BY county, school, program, year HAVING count(*) > 1)
      UNION ALL SELECT 'unique_line', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
      UNION ALL SELECT 'order_reference', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
      UNION ALL SELECT 'order_without_lines', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
      UNION ALL SELECT 'null_key', count(*) FROM panel WHERE school IS NULL OR program IS NULL OR year IS NULL
      UNION ALL SELECT 'number_without_status', count(*) FROM panel WHERE (status = 'points') <> (points IS NOT NULL)"""),
    "name_defects": (name_defects, """WITH n AS (SELECT p_partkey, p_type || ' ' || p_name AS name FROM part),
      f AS (SELECT p_partkey, regexp_matches(name, '[0-9]+$') AS trailing_number, regexp_matches(lower(name), '(promo|open)') AS status_word FROM n)
      SELECT * FROM f WHERE trailing_number OR status_word"""),
    "chance_monotone": (chance_monotone, f"""WITH {evaluation.CHANCES}, s AS (SELECT p, p - lag(p) OVER (PARTITION BY county, school, program, T ORDER BY x) AS step FROM chances)
      SELECT count(*) FILTER (step < -1e-9) AS falls, count(*) FILTER (p < 0 OR p > 1) AS outside, count(*) AS n FROM s"""),
    "quantiles_sorted": (quantiles_sorted, f"""WITH {evaluation.TABLE} SELECT list_sort(zq) = zq AS sorted, CAST(len(zq) AS INTEGER) AS n, zq[21] BETWEEN -0.6 AND 0.6 AS centred FROM zq"""),
    "spread_checks": (spread_checks, f"WITH {evaluation.SPREADS} SELECT bucket, s >= 2.0 AS above_floor FROM spreads"),
    "final_not_below": (final_not_below, f"WITH {evaluation.FINAL} SELECT count(*) FILTER (p_final < p - 1e-9) AS below, count(*) AS n FROM final"),
    "photo_rejects": (photo_rejects, """WITH s AS (SELECT 300 + o_orderkey % 900 AS w, 200 + o_custkey % 700 AS h FROM orders)
      SELECT CASE WHEN w < 560 OR h < 300 THEN 'small' WHEN NOT round(w / h, 6) BETWEEN 1.05 AND 3.6 THEN 'aspect' ELSE 'ok' END AS reason, count(*) AS n FROM s GROUP BY 1"""),
    "photo_accepted": (photo_accepted, """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders)
      SELECT o_custkey, max(o_orderkey) FILTER (k = 1) AS photo, coalesce(string_agg(o_orderkey, ',' ORDER BY k) FILTER (k BETWEEN 2 AND 3), '') AS alternates
      FROM r WHERE k <= 3 GROUP BY o_custkey"""),
    "link_health": (link_health, """SELECT CASE WHEN page_id % 6 < 2 THEN 'OK' WHEN page_id % 6 < 4 THEN 'DEAD' ELSE 'THROTTLED' END AS health, count(*) AS n FROM pages GROUP BY 1"""),
}
