"""Baselines that need no fit: round pairs and bridge, last values, shrunken means, walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.panel import SERIES


def round_pairs(cells: DataFrame) -> DataFrame:
    """Cells published in two rounds of one year; a threshold of at most 3 counts as no queue."""
    state = lambda c: F.when(F.col(c) > 3, "num").otherwise("open")
    return cells.where("v1 is not null and v2 is not null").select(
        *SERIES, "category", "year", F.lit("1").alias("main_round"), F.lit("2").alias("alt_round"), F.col("v1").alias("vm"),
        state("v1").alias("main_state"), F.col("v2").alias("va"), state("v2").alias("alt_state"),
    )


def round_bridge(pairs: DataFrame) -> DataFrame:
    """How thresholds move from the earlier to the later round, by county and by county and category.

    The means are over pairs where both rounds had a queue; pairs without a main round are left out.
    """
    later = F.col("alt_round").cast("int") > F.col("main_round").cast("int")
    side = lambda a, b: F.when(later, F.col(a)).otherwise(F.col(b))
    turned = pairs.where("main_round is not null and alt_round is not null").select(
        "county", "category", F.least("main_round", "alt_round").alias("from_round"), F.greatest("main_round", "alt_round").alias("to_round"),
        (side("va", "vm") - side("vm", "va")).alias("d"), side("main_state", "alt_state").alias("early"), side("alt_state", "main_state").alias("late"),
    )
    both, queue = (F.col("early") == "num") & (F.col("late") == "num"), F.col("early").isin("num", "zero")
    gone = F.count_if(queue & (F.col("late") == "open"))
    keys = ["county", "from_round", "to_round"]
    return (
        turned.groupingSets([keys, [*keys, "category"]], *keys, "category")
        .agg(
            F.count_if(both).alias("n_pairs"),
            F.round(F.avg(F.when(both, F.col("d"))), 6).alias("mean"),
            F.round(F.stddev_pop(F.when(both, F.col("d"))), 6).alias("sd"),
            F.count_if(queue).alias("n_had_queue"),
            gone.alias("n_vanished"),
            F.round(gone / F.greatest(F.lit(1), F.count_if(queue)), 6).alias("share_vanished"),
        )
        .where("n_pairs > 0")
    )


def last_value(obs: DataFrame) -> DataFrame:
    """The newest earlier number of the same series: one window over the series, no self-join."""
    before = Window.partitionBy(*SERIES).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    num = F.when(F.col("state") == "num", F.struct("year", "v"))
    return obs.withColumn("_last", F.last(num, ignorenulls=True).over(before)).select(
        *SERIES, "year", F.col("_last.year").alias("last_year"), F.col("_last.v").alias("last_v")
    )


def walk_forward(obs: DataFrame, strength: float = 4.0) -> DataFrame:
    """Predict each year from everything before it by a series mean that is shrunk to its programme's mean.

    Every year of a county that has an earlier number is predicted; in its first years there is nothing to predict from.

    Sums up to each year are running windows, so the data are not multiplied by the number of folds. The observations move once,
    to their series; the means of programmes and counties are a row a year of each and go to where the observations are.
    """
    num = F.col("state") == "num"

    def before(keys: list[str], s: str, n: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
        totals = obs.groupBy(*keys, "year").agg(F.sum(F.when(num, F.col("v"))).alias("s"), F.count_if(num).alias("n"))
        return totals.select(
            *keys, "year", F.coalesce(F.sum("s").over(w), F.lit(0.0)).alias(s), F.coalesce(F.sum("n").over(w), F.lit(0)).alias(n)
        )

    earlier = Window.partitionBy(*SERIES).orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    series = obs.withColumns({
        "s": F.coalesce(F.sum(F.when(num, F.col("v"))).over(earlier), F.lit(0.0)),
        "hist": F.count(F.when(num, 1)).over(earlier),
        "last": F.last(F.when(num, F.col("v")), ignorenulls=True).over(earlier),
    })
    means = before(["county", "program"], "ps", "pn")
    counties = before(["county"], "cs", "cn")
    opened = obs.groupBy("county", "year").agg(F.count_if(F.col("state") != "open").alias("f"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy("county").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    opened = opened.select("county", "year", (F.sum("f").over(w) / F.sum("c").over(w)).alias("pi"))
    mu = F.coalesce(F.try_divide("ps", "pn"), F.try_divide("cs", "cn"))
    return (
        series.join(F.broadcast(means), ["county", "program", "year"])
        .join(F.broadcast(counties.join(opened, ["county", "year"])), ["county", "year"])
        .select(
            *SERIES, "category", F.col("year").alias("T"), "state", "v", ((F.col("s") + strength * mu) / (F.col("hist") + strength)).alias("m"),
            "pi", "hist", "last", F.try_divide("ps", "pn").alias("pm"),
        )
        .where("m is not null")
    )


WALK_SQL = """,
t AS (
  SELECT o.*, coalesce(sum(s.v) FILTER (s.state = 'num'), 0) AS s, count(s.v) FILTER (s.state = 'num') AS hist,
    arg_max(s.v, s.year) FILTER (s.state = 'num') AS last
  FROM obs o LEFT JOIN obs s ON o.county = s.county AND o.school = s.school AND o.program = s.program AND s.year < o.year
  GROUP BY ALL),
pm AS (
  SELECT y.county, y.program, y.year, avg(o.v) AS pm FROM (SELECT DISTINCT county, program, year FROM obs) y
  LEFT JOIN obs o ON o.county = y.county AND o.program = y.program AND o.year < y.year AND o.state = 'num' GROUP BY ALL),
cm AS (
  SELECT y.county, y.year, avg(o.v) FILTER (o.state = 'num') AS cm,
    avg(CASE WHEN o.state = 'open' THEN 0.0 ELSE 1.0 END) FILTER (o.state IS NOT NULL) AS pi
  FROM (SELECT DISTINCT county, year FROM obs) y LEFT JOIN obs o ON o.county = y.county AND o.year < y.year GROUP BY ALL),
preds AS (
  SELECT county, school, program, category, year AS T, state, v, (s + 4.0 * coalesce(pm, cm)) / (hist + 4.0) AS m, pi, hist, last, pm
  FROM t JOIN pm USING (county, program, year) JOIN cm USING (county, year) WHERE coalesce(pm, cm) IS NOT NULL)"""
