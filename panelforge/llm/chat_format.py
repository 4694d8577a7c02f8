"""Preference formatting of chosen and rejected conversations.

The longest common turn prefix of the two (same role and text, turn by turn) is rendered once as the prompt; what
follows it is rendered as two completions, each with the character spans that training looks at: the text and
end mark of assistant turns. Everything is done with array functions on one row for each pair.

Defined cases: a null role counts as ``user``, a null text as empty, also in arrays that callers give; a null turn counts
as one with both null, a null conversation as one without turns; columns named like a result are replaced by it and all
others stay; repeated rows of a conversation count once, and
turns with the same number are ordered by role and text; rows without a conversation id are left out; equal
conversations give empty completions; an empty table gives an empty result; other columns of turns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import quoted, table

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def _turns(kept: Column) -> Column:
    """A conversation as array<struct<role, text>>, in order, from the rows where ``kept`` holds."""
    row = F.struct("turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_sort(F.array_distinct(F.collect_list(F.when(kept, row))))
    return F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def _rendered(turn: Column) -> Column:
    return F.concat(F.lit(BEGIN), turn["role"], F.lit("\n"), turn["text"], F.lit(END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _spans(turns: Column) -> Column:
    """array<struct<start, stop>> of the characters of rendered ``turns`` that are trained on."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def step(acc: Column, turn: Column) -> Column:
        stop = acc["at"] + F.length(_rendered(turn))
        span = F.struct((stop - F.length(turn["text"]) - F.lit(len(END))).alias("start"), stop.alias("stop"))
        found = F.when(turn["role"] == "assistant", F.concat(acc["found"], F.array(span))).otherwise(acc["found"])
        return F.struct(stop.cast("int").alias("at"), found.cast("array<struct<start:int,stop:int>>").alias("found"))

    start = F.struct(F.lit(0).cast("int").alias("at"), none.alias("found"))
    return F.aggregate(turns, start, step, lambda acc: acc["found"])


def _whole(turns: Column) -> Column:
    """The conversation without nulls: roles default to ``user``, texts to empty, the whole to no turns."""
    kind = "array<struct<role:string,text:string>>"
    filled = F.transform(
        turns,
        lambda t: F.struct(F.coalesce(t["role"], F.lit("user")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")),
    )
    return F.coalesce(filled.cast(kind), F.array().cast(kind))


RESULTS = ("n_common", "prompt", "chosen_text", "chosen_spans", "rejected_text", "rejected_spans")


def format_pairs(pairs: DataFrame, chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """Add prompt, completions and their spans to rows with two conversations (array<struct<role, text>>)."""
    kept = [c for c in pairs.columns if c not in RESULTS]
    rows = pairs.select(
        F.struct(*[F.col(quoted(c)) for c in kept]).alias("row"), _whole(F.col(quoted(chosen))).alias("a"), _whole(F.col(quoted(rejected))).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    both = F.least(F.size(a), F.size(b))
    same = F.when(both > 0, F.transform(F.sequence(F.lit(1), F.greatest(both, F.lit(1))), lambda i: F.element_at(a, i) == F.element_at(b, i)))
    first = F.coalesce(F.array_position(same, F.lit(False)), F.lit(0))
    common = F.when(first > 0, first - 1).otherwise(both).cast("int")
    rest = lambda c: F.slice(c, F.col("n_common") + 1, F.greatest(F.size(c), F.lit(1)))
    return (
        rows.withColumn("n_common", common)
        .withColumns({"prefix": F.slice(a, F.lit(1), F.col("n_common")), "a": rest(a), "b": rest(b)})
        .select(
            *[F.col(f"row.{quoted(c)}") for c in kept],
            "n_common",
            _text(F.col("prefix")).alias("prompt"),
            _text(a).alias("chosen_text"),
            _spans(a).alias("chosen_spans"),
            _text(b).alias("rejected_text"),
            _spans(b).alias("rejected_spans"),
        )
    )


def pairs_of(conversations: DataFrame) -> DataFrame:
    """Preference pairs (pair_id, chosen, rejected) from conversations 2k and 2k + 1.

    Chosen is conversation 2k as it is; rejected is the same up to its last assistant turn, with the last assistant
    turn of 2k + 1 in its place. Where either has no assistant turn, there is no pair.
    """
    odd = F.col("conv_id").bitwiseAND(1) == 1
    both = (
        conversations.where("conv_id is not null")
        .groupBy(F.shiftright("conv_id", 1).alias("pair_id"))
        .agg(_turns(~odd).alias("chosen"), _turns(odd).alias("other"))
    )
    last = lambda c: F.size(c) + 1 - F.array_position(F.reverse(F.transform(c, lambda t: t["role"])), F.lit("assistant"))
    has = lambda c: F.exists(c, lambda t: t["role"] == "assistant")
    chosen, other = F.col("chosen"), F.col("other")
    return (
        both.where(has(chosen) & has(other))
        .withColumn("_k", last(chosen).cast("int"))
        .withColumn(
            "rejected", F.concat(F.slice(chosen, F.lit(1), F.col("_k") - 1), F.slice(other, last(other).cast("int"), F.lit(1)))
        )
        .select("pair_id", "chosen", "rejected")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return format_pairs(pairs_of(table(spark, sf_dir, "conversations"))).select(
        "pair_id",
        F.col("n_common").cast("bigint").alias("n_common"),
        "prompt",
        F.col("chosen_text").alias("chosen"),
        shown(F.col("chosen_spans")).alias("chosen_mask"),
        F.col("rejected_text").alias("rejected"),
        shown(F.col("rejected_spans")).alias("rejected_mask"),
    )


ORACLE_SQL = """
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 AS odd, role, text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k
  FROM (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text
        FROM conversations WHERE conv_id IS NOT NULL)),
ends AS (SELECT pair_id, odd, max(k) AS k FROM t WHERE role = 'assistant' GROUP BY ALL),
pairs AS (SELECT a.pair_id, a.k AS ka, b.k AS kb FROM ends a JOIN ends b ON a.pair_id = b.pair_id WHERE a.odd = 0 AND b.odd = 1),
sides AS (
  SELECT pair_id, 'chosen' AS side, k, role, text FROM t JOIN pairs USING (pair_id) WHERE odd = 0
  UNION ALL
  SELECT pair_id, 'rejected', k, role, text FROM t JOIN pairs USING (pair_id) WHERE odd = 0 AND k < ka
  UNION ALL
  SELECT pair_id, 'rejected', ka, role, text FROM t JOIN pairs USING (pair_id) WHERE odd = 1 AND k = kb),
n AS (
  SELECT c.pair_id, coalesce(min(c.k) FILTER (c.role <> r.role OR c.text <> r.text) - 1, max(c.k)) AS n
  FROM sides c JOIN sides r ON c.pair_id = r.pair_id AND c.k = r.k
  WHERE c.side = 'chosen' AND r.side = 'rejected' GROUP BY 1),
shown AS (
  SELECT pair_id, side, k, n, role, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS s,
         length(text) + 11 AS len
  FROM sides JOIN n USING (pair_id)),
placed AS (
  SELECT *, sum(CASE WHEN k > n THEN length(s) ELSE 0 END) OVER (PARTITION BY pair_id, side ORDER BY k) AS stop FROM shown)
SELECT pair_id, CAST(max(n) AS BIGINT) AS n_common,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (side = 'chosen' AND k <= n), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (side = 'chosen' AND k > n), '') AS chosen,
  coalesce(string_agg(CAST(stop - len AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY k)
    FILTER (side = 'chosen' AND k > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(s, '' ORDER BY k) FILTER (side = 'rejected' AND k > n), '') AS rejected,
  coalesce(string_agg(CAST(stop - len AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY k)
    FILTER (side = 'rejected' AND k > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY pair_id
"""
