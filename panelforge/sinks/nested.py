"""The nested JSON dataset and its relational export."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nested_schools(cells: DataFrame) -> DataFrame:
    """(county, school, programs): programmes in order of level and name, each with entries (year, value) in order.

    A value is a number or a status, as text. Two aggregations, each over what one series or one school holds.
    """
    value = F.coalesce(F.col("points").cast("string"), F.col("status"))
    series = cells.groupBy("county", "school", "program", "level", "category").agg(
        F.array_sort(F.collect_list(F.struct(F.col("year").cast("string").alias("year"), value.alias("value")))).alias("values")
    )
    return series.groupBy("county", "school").agg(
        F.array_sort(F.collect_list(F.struct("level", "program", "category", "values"))).alias("programs")
    )


def write_json(cells: DataFrame, path: str) -> None:
    nested_schools(cells).write.mode("overwrite").json(path)


def write_model(meta: dict, schools: DataFrame, path: str) -> None:
    """The compact model file: one line with ``meta``, then a line for each school."""
    head = schools.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "value string")
    head.unionByName(schools.select(F.to_json(F.struct(*schools.columns)).alias("value"))).write.mode("overwrite").text(path)


def write_drift(log: DataFrame, path: str) -> None:
    log.write.mode("overwrite").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """With a header; null as an empty text."""
    rows.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """The relational export: one Parquet table each, those with a year partitioned by it (written anew every time)."""
    for name, rows in tables.items():
        by = ["year"] if "year" in rows.columns else []
        if by:
            rows = rows.hint("rebalance", "year")  # one year may hold most rows; adaptive execution splits it
        rows.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")
