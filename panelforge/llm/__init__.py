"""Operators for preparing training text. Nothing else in the library imports this subpackage.

``queries()`` and ``oracle_sql()`` list the operators as thin queries over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelforge.llm import (
    byte_bpe,
    chat_format,
    decontaminate,
    embedding_dedup,
    filter_audit,
    jaccard_join,
    langid,
    line_templates,
    periodic_runs,
    substring_dedup,
    toxicity,
    url_filter,
    vector_search,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": langid.query,
        "op2_chat_formatting": chat_format.query,
        "op3_byte_bpe": byte_bpe.query,
        "op4_benchmark_decontamination": decontaminate.query,
        "op5_toxicity": toxicity.query,
        "op6_substring_dedup": substring_dedup.query,
        "op7_ngram_jaccard_join": jaccard_join.query,
        "op8_url_filter": url_filter.query,
        "op9_line_dedup": line_templates.query,
        "op10_embedding_near_dedup": embedding_dedup.query,
        "op11_periodic_runs": periodic_runs.query,
        "op12_vector_search": vector_search.query,
        "op13_filter_audit": filter_audit.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": chat_format.ORACLE_SQL,
        "op6_substring_dedup": substring_dedup.ORACLE_SQL,
        "op8_url_filter": url_filter.ORACLE_SQL,
        "op9_line_dedup": line_templates.ORACLE_SQL,
        "op10_embedding_near_dedup": embedding_dedup.ORACLE_SQL,
        "op11_periodic_runs": periodic_runs.ORACLE_SQL,
        "op13_filter_audit": filter_audit.ORACLE_SQL,
    }
