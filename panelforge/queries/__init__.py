"""The registry of queries: each a function of (spark, sf_dir), most with the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


def catalogue() -> dict[str, tuple[Query, str | None]]:
    from panelforge.queries import contracts, evaluation, events, layouts, merging, model, panels, quality, rules, texts

    out: dict[str, tuple[Query, str | None]] = {}
    for module in (panels, merging, evaluation, texts, events, layouts, quality, rules, model, contracts):
        out |= module.QUERIES
    return out
