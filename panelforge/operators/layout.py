"""Geometry of positioned words: lines, columns, carried headers, repaired years. One plan for all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, keys: list[str], at: str, gap: float, name: str = "island") -> DataFrame:
    """Number the clusters of each group from 0; one begins where the step from the element before exceeds ``gap``."""
    w = Window.partitionBy(*keys).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn(
        name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    ).drop("_new")


def carried(rows: DataFrame, keys: list[str], order: list[str], column: str, name: str) -> DataFrame:
    """The last value of ``column`` that is not null, up to each row."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(column, ignorenulls=True).over(w))


def nearest(rows: DataFrame, columns: DataFrame, page: list[str]) -> DataFrame:
    """The column of the same page whose centre is nearest to each row's x; of equals, the first.

    ``columns`` are gathered by page (a page's header has a few), so rows are not multiplied.
    """
    heads = columns.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("col_no", "cx"))).alias("_heads"))
    best = F.array_min(F.transform("_heads", lambda h: F.struct(F.abs(h["cx"] - F.col("x")).alias("d"), h["col_no"].alias("col_no"))))
    return rows.join(heads, page).withColumn("col_no", best["col_no"]).drop("_heads")


def floor_column(rows: DataFrame, columns: DataFrame, page: list[str], slack: float = 8.0) -> DataFrame:
    """The last column that begins at most ``slack`` right of each row's x; null left of all."""
    heads = columns.groupBy(*page).agg(F.collect_list(F.struct("x0", "col_no")).alias("_heads"))
    left = F.array_max(F.filter("_heads", lambda h: h["x0"] <= F.col("x") + slack))
    return rows.join(heads, page).withColumn("col_no", left["col_no"]).drop("_heads")


def smallest_band(lines: DataFrame, bands: DataFrame, page: list[str]) -> DataFrame:
    """The lowest band of the page that holds each line's centre; null if none does."""
    held = bands.groupBy(*page).agg(F.collect_list(F.struct((F.col("bottom") - F.col("top")).alias("h"), "top", "bottom", "band")).alias("_b"))
    best = F.array_min(F.filter("_b", lambda b: (b["top"] <= F.col("y")) & (F.col("y") <= b["bottom"])))
    return lines.join(held, page, "left").withColumn("band", best["band"]).drop("_b")


def repaired_years(years: Column) -> Column:
    """Header years that should rise by one: repeats are raised; if that does not give a run, they stay as they are."""
    none = F.array().cast("array<int>")
    fixed = F.aggregate(
        years, none, lambda acc, y: F.concat(acc, F.array(F.greatest(y.cast("int"), F.coalesce(F.try_element_at(acc, F.lit(-1)) + 1, y.cast("int")))))
    )
    steps = F.transform(F.sequence(F.lit(1), F.greatest(F.size(fixed) - 1, F.lit(1))), lambda i: F.get(fixed, i) - F.get(fixed, i - 1))
    return F.when(F.forall(steps, lambda d: F.coalesce(d, F.lit(1)) == 1), fixed).otherwise(years)


def before_gap(glyphs: DataFrame, keys: list[str], at: str, gap: float) -> DataFrame:
    """What stands before the first gap that is larger than ``gap``."""
    return islands(glyphs, keys, at, gap, "_k").where("_k = 0").drop("_k")


def matrix_rows(words: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """(doc, page, line, row_label, col_no, year, text) of a matrix: a header of years, then labels with values below.

    ``words`` have (doc, page, text, x0, x1, top). A page's first line with two or more years is its header, and values
    belong to the year column nearest to their centre; words left of the first column are the label.
    """
    page = ["doc", "page"]
    lined = islands(words.withColumn("x", (F.col("x0") + F.col("x1")) / 2), page, "top", tolerance, "line")
    year = F.when(F.col("text").rlike("^20[0-9]{2}$"), F.col("text").cast("int"))
    headers = lined.where(year.isNotNull()).groupBy(*page, "line").agg(
        F.array_sort(F.collect_list(F.struct(F.col("x").alias("cx"), year.alias("year")))).alias("h")
    )
    first = headers.where(F.size("h") >= 2).groupBy(*page).agg(F.min(F.struct("line", "h")).alias("f"))
    fixed = repaired_years(F.transform("f.h", lambda h: h["year"]))
    heads = first.select(*page, F.col("f.line").alias("head"), F.col("f.h").alias("h"), fixed.alias("years"))
    columns = heads.select(*page, F.posexplode(F.arrays_zip(F.transform("h", lambda h: h["cx"]).alias("cx"), F.col("years").alias("year"))).alias("col_no", "c"))
    columns = columns.select(*page, "col_no", F.col("c.cx").alias("cx"), F.col("c.year").alias("year"))
    below = lined.join(heads.select(*page, "head", F.get("h", F.lit(0))["cx"].alias("left")), page).where(F.col("line") > F.col("head"))
    labels = below.where(F.col("x") < F.col("left") - 15).groupBy(*page, "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda w: w["text"]), " ").alias("row_label")
    )
    values = nearest(below.where(F.col("x") >= F.col("left") - 15).select(*page, "line", "x", "text"), columns, page)
    out = values.join(labels, [*page, "line"], "left").join(columns.drop("cx"), [*page, "col_no"])
    return carried(out, page, ["line", "col_no"], "row_label", "row_label").select(*page, "line", "row_label", "col_no", "year", "text")
