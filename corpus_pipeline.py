"""From raw documents to token ids, in five stages over everything that the stage before kept.

Each stage's rows are written to the shared folder before the next one starts; once they are, the stage's own intermediate
tables are deleted, and at the end the rows of all stages but the last. The token ids are not written: the caller's action
makes them from the last table.

Defined cases, for the whole run and for each stage: a null or empty text counts as clean, has no lines to drop, is
nobody's copy and matches no benchmark item, so its row stays, with no tokens; a null doc_id stays, as no decision can
name it; rows that repeat a document as a whole share its fate, so repeats of a kept one all stay; empty tables give an
empty result with the same columns; other columns, whatever their names, go through the first four stages unchanged, but
``n_chars``, which follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import byte_bpe, decontaminate, jaccard_join, line_templates, toxicity
from panelforge.llm.common import materialise, scratch, table


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of what they decode to."""
    import public_tokenizers

    done = byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return done.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("line_dedup", line_templates.keep_new_lines),
    ("ngram_jaccard_join", jaccard_join.keep_one),
    ("benchmark_decontamination", decontaminate.keep_clean),
    ("byte_bpe", encoded),
]

#: SQL can express neither the trained classifier nor the tokenizer; a test holds the run against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with scratch(STAGES[-2][0]):
        for name, stage in STAGES[:-1]:
            with scratch(name):
                docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
