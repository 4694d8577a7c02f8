"""Checks whose result is the offending rows, each with the rule that it breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words of a status that has run into a name, and the greatest threshold and the bounds of a forecast.
STATUS_WORDS = "ventelis|fortrinn|fortinn|utgår|ledige|dokumentasjon"
MOST_POINTS = 65.0
LEAST_FORECAST, MOST_FORECAST = -10.0, 70.0


def broken(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with ``rule``: a row for each rule that it breaks, in one pass. A rule that comes to null is not broken."""
    names = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in rules.items()]), lambda r: r.isNotNull())
    return rows.withColumn("rule", F.explode(names))


def cell_problems(cells: DataFrame, words: str = STATUS_WORDS, most: float = MOST_POINTS) -> DataFrame:
    """(county, school, program, year, rule) of cells (county, school, program, category, year, points).

    What is wrong with a name is told once, with a null year; what is wrong with a number, once a year.
    """
    keys = ["county", "school", "program"]
    names = broken(
        cells.select(*keys, "category").distinct(),
        {
            "number glued to name": F.col("program").rlike(r"\s\d+(?:[.,]\d+)?$"),
            "status glued to name": F.col("program").rlike(f"(?i){words}"),
            "uncategorised": F.col("category") == "other",
        },
    ).select(*keys, F.lit(None).cast("int").alias("year"), "rule")
    numbers = broken(cells, {"out of range": ~F.col("points").between(0, most)}).select(*keys, "year", "rule")
    return names.unionByName(numbers).distinct()


def forecast_problems(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` with the rule that a forecast (m, s, pi) breaks; a missing figure breaks its rule."""
    outside = lambda c, low, high: ~F.coalesce(F.col(c).between(low, high), F.lit(False))
    rules = {
        "fill is no probability": outside("pi", 0, 1),
        "spread not positive": ~F.coalesce(F.col("s") > 0, F.lit(False)),
        "threshold not plausible": outside("m", LEAST_FORECAST, MOST_FORECAST),
    }
    return broken(forecasts, rules).select(*keys, "rule")


def spread_problems(spreads: DataFrame, residual: float) -> DataFrame:
    """(bucket, s, above_residual, shrinks): a spread is not below the residual's nor above that of the shorter history."""
    before = F.lag("s").over(Window.orderBy("bucket"))  # a few buckets
    return spreads.select(
        "bucket", "s", (F.col("s") >= residual).alias("above_residual"), F.coalesce(F.col("s") <= before, F.lit(True)).alias("shrinks")
    )


def round_years(cells: DataFrame, usual: str) -> DataFrame:
    """(county, year, round) where all of a county's cells of a year are of one round, and that is not the usual one.

    Cells without a round say nothing.
    """
    of = cells.where("round is not null").groupBy("county", "year").agg(F.min("round").alias("round"), F.max("round").alias("last"))
    return of.where((F.col("round") == F.col("last")) & (F.col("round") != F.lit(usual))).drop("last")
