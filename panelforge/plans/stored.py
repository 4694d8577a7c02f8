"""Intermediate results that a query reads more than once, written to the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder for a local session, and an error for a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _OWN.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="panelforge-"))


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` once and read them back: what follows reads a table, and a lost executor costs its tasks only."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
