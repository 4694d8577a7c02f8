"""Session settings and registered functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution splits skewed joins and merges small partitions; sizes are left to it.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "panelforge", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | settings).items():
        builder = builder.config(key, value)
    return register(builder.getOrCreate())


def register(spark: SparkSession) -> SparkSession:
    """Make the Python functions usable from SQL: nfkc, similarity, html_cells."""
    from panelforge.functions.text import nfkc
    from panelforge.operators.taxonomy import close_similarity
    from panelforge.sources.html import HtmlCells

    spark.udf.register("nfkc", nfkc)
    spark.udf.register("similarity", close_similarity)
    spark.udtf.register("html_cells", HtmlCells)
    return spark
