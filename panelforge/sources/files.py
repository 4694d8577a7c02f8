"""Directories of source files, newest first, with values that their names carry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def directory(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """(file, source_rank, year, content): files with the suffix, rank 0 being the last name, with the year in it."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(path)
    rank = F.row_number().over(Window.orderBy(F.col("file").desc())) - 1  # one row for each file of a directory
    return files.select(name.alias("file"), "content").withColumns(
        {"source_rank": rank, "year": F.regexp_extract("file", "(20[0-9]{2})", 1).try_cast("int")}
    )


def listed(spark: SparkSession, names: list[str]) -> DataFrame:
    """A fixed list of files in order of priority."""
    return spark.createDataFrame([(n, i) for i, n in enumerate(names)], "file string, source_rank int")


def matched_lines(docs: DataFrame, key: str, text: str, pattern: str, groups: list[str]) -> DataFrame:
    """(key, line_no, group...) of the lines that match; the pattern is tried before any group is taken out."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).where(F.col("line").rlike(pattern))
    return lines.select(key, "line_no", *[F.regexp_extract("line", pattern, i + 1).alias(g) for i, g in enumerate(groups)])


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """The Parquet table at ``path``, made and written if it is not there."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        make().write.parquet(path)
    return spark.read.parquet(path)
