"""What each filter of a chain removes, in every order of the chain: an audit of how filters interact.

Five filters judge a text; each letter names what fails it:

* A: under 200 words
* B: 100 * distinct words < 50 * words
* C: 100 * capitals ``[A-Z]`` > 3 * code points
* D: holds one of ``#$%&*|``
* E: identical to the text of a smaller doc_id

Texts are judged in Arrow's own buffers: a batch's bytes are one array with the texts' offsets. A table of byte classes marks
separators, capitals, symbols and first bytes of characters; prefix sums of the marks, looked up at the offsets, are the
counts of each text. Words are hashed by prefix sums too; sorted by text and hash, each is compared byte by byte with the one
before it, and a text in which equal hashes turn out to be different words is counted again with a set. So a text is a mask
of four bits, and identical texts are found by 128 bits of a SHA-256 digest, with the smallest document of each digest that
repeats written as a table of its own and joined, so that adaptive execution splits a digest with very many copies.

All that follows needs only the documents of each part by mask, at most 32 numbers a part, for all 120 orders: a document is
removed by the first filter of an order that it fails. Over all orders, each of the k filters that a document fails is first
in 120 / k of them, which is the Shapley count.

Defined cases: a null text is empty; an empty text fails A, and E if a smaller doc_id has an empty text too; a row without
doc_id has no label, and is neither smaller than others nor later; repeated rows count each, and are not earlier than each
other; a null lang is the part ''; of several labels of a document, one that is 1 is enough; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import chunks, materialise, table
from panelforge.llm.words import PLAIN, mixed, word_hashes

FILTERS = "ABCDE"
LEAST_WORDS = 200
LEAST_DISTINCT = 50  # in a hundred words
MOST_CAPITALS = 3  # in a hundred code points
SYMBOLS = b"#$%&*|"

_BYTES = np.arange(256)
_CAPITAL = (_BYTES >= 65) & (_BYTES <= 90)
_SYMBOL = np.isin(_BYTES, np.frombuffer(SYMBOLS, np.uint8))
_BEGINS = (_BYTES & 0xC0) != 0x80  # first byte of a character in UTF-8


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a column of strings without nulls; the bytes are Arrow's own, not a copy."""
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[edges[0] : edges[-1]], edges - edges[0]


def _sums(marks: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Marks of each text, by prefix sums."""
    return np.diff(np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])[edges])


def _equal_words(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes at ``a`` and at ``b`` are equal, eight at a time."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(padded, 8)
    equal, rest = np.ones(len(a), bool), np.arange(len(a))
    for at in range(0, int(size.max(initial=0)), 8):
        rest = rest[(size[rest] > at) & equal[rest]]
        if not len(rest):
            break
        x, y = (np.ascontiguousarray(eights[p[rest] + at]).view("<u8").ravel() for p in (a, b))
        unused = np.maximum(0, at + 8 - size[rest]).astype(np.uint64) * np.uint64(8)
        equal[rest] = (x ^ y) << unused == 0
    return equal


def distinct_words(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, different words) of each text."""
    # one separator after each text keeps the last word of one from the first of the next
    texts = [data[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
    hashes, first, starts = word_hashes(texts, PLAIN)
    joined = np.frombuffer(b" ".join([*texts, b""]).translate(PLAIN), np.uint8)
    gaps = np.flatnonzero(joined == 32)
    ends = gaps[np.searchsorted(gaps, starts)]
    counts = np.diff(first)
    text = np.repeat(np.arange(len(texts)), counts)
    with np.errstate(over="ignore"):
        key = mixed(hashes + mixed(text.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    a, b = order[:-1], order[1:]
    same = (key[a] == key[b]) & (text[a] == text[b])
    x, y = a[same], b[same]
    size = ends[x] - starts[x]
    verified = (size == ends[y] - starts[y]) & _equal_words(joined, starts[x], starts[y], size)
    repeats = np.bincount(text[y[verified]], minlength=len(texts))
    found = counts - repeats
    # another word between two equal ones, or two texts' keys mixed, breaks a row of equal keys: those texts are counted anew
    broken = np.union1d(text[y[~verified]], text[np.concatenate([a, b])[np.tile((key[a] == key[b]) & (text[a] != text[b]), 2)]])
    for i in broken.tolist():
        found[i] = len(set(texts[i].split()))
    return counts, found


def masks(column: pa.Array) -> np.ndarray:
    """Bit k is set if the text fails the k-th of the first four filters."""
    data, edges = buffers(column)
    words, distinct = distinct_words(data, edges)
    capitals, symbols, characters = (_sums(kind[data], edges) for kind in (_CAPITAL, _SYMBOL, _BEGINS))
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * capitals > MOST_CAPITALS * characters, symbols > 0)
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 512, 1):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(masks(batch.column(3)), pa.int32())],
            ["doc_id", "part", "digest", "mask"],
        )


def judged(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask) of every row of ``docs`` (doc_id, text, lang): five bits, set where the text fails."""
    text = F.coalesce("text", F.lit(""))
    scanned = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        F.substring(F.unhex(F.sha2(text, 256)), 1, 16).alias("digest"), text.alias("text"),
    ).mapInArrow(_masked, "doc_id bigint, part string, digest binary, mask int")
    scanned = materialise(scanned, "masks")
    firsts = (
        scanned.groupBy("digest")
        .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        .where("first < last")
        .select("digest", "first")
    )
    late = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return scanned.join(materialise(firsts, "first-copies"), "digest", "left").select(
        "doc_id", "part", (F.col("mask") + F.when(late, 16).otherwise(0)).alias("mask")
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step, with ``labels`` (doc_id, quality, toxic) of some documents."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    counts = judged(docs).join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    steps = counts.withColumn("filter_order", F.explode(orders)).select(
        "*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step")
    )
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    own = bit(F.substring("filter_order", F.col("step"), F.lit(1)))
    earlier = F.aggregate(
        F.sequence(F.lit(1), F.lit(len(FILTERS))), F.lit(0),
        lambda acc, k: acc + F.when(k < F.col("step"), bit(F.substring("filter_order", k, F.lit(1)))).otherwise(0),
    )
    steps = steps.withColumns({"own": own, "earlier": earlier})
    fails, before = F.col("mask").bitwiseAND(F.col("own")) != 0, F.col("mask").bitwiseAND(F.col("earlier")) != 0
    of = lambda test, value="n": F.sum(F.when(test, F.col(value)).otherwise(0)).cast("bigint")
    share = F.lit(120) / F.bit_count("mask")  # of the orders, in which the filter is the first that the document fails
    return steps.groupBy("part", "filter_order", "step").agg(
        of(~fails & ~before).alias("kept"),
        of(fails & ~before).alias("removed"),
        of(fails & before).alias("redundant"),
        of(F.col("mask") == F.col("own")).alias("unique_fails"),
        of(fails & ~before, "good").alias("good_lost"),
        of(fails & ~before, "toxic").alias("toxic_lost"),
        F.sum(F.when(fails, F.col("n") * share.cast("bigint")).otherwise(0)).cast("bigint").alias("shapley"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels"))


_LETTERS = ", ".join(f"('{x}', {1 << k})" for k, x in enumerate(FILTERS))
ORACLE_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
firsts AS (SELECT text, min(doc_id) AS first FROM texts GROUP BY text),
masks AS (
  SELECT doc_id, part, CASE WHEN len(ws) < {LEAST_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(ws)) < {LEAST_DISTINCT} * len(ws) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > {MOST_CAPITALS} * length(text) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first < doc_id THEN 16 ELSE 0 END AS mask
  FROM texts JOIN firsts USING (text)),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM masks LEFT JOIN known USING (doc_id) GROUP BY ALL),
letters(x, b) AS (VALUES {_LETTERS}),
orders AS (
  SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits
  FROM letters p, letters q, letters r, letters s, letters t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND p.b | q.b | r.b | s.b | t.b = 31),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, bits[step] AS own, list_sum(bits[1 : step - 1]) AS earlier
  FROM (SELECT *, unnest(range(1, 6)) AS step FROM orders)),
tried AS (
  SELECT *, mask & own > 0 AS fails, mask & CAST(coalesce(earlier, 0) AS INTEGER) > 0 AS before FROM counts, steps),
removed AS (
  SELECT part, filter_order, step, own, coalesce(sum(n) FILTER (NOT fails AND NOT before), 0) AS kept,
    coalesce(sum(n) FILTER (fails AND NOT before), 0) AS removed, coalesce(sum(n) FILTER (fails AND before), 0) AS redundant,
    coalesce(sum(n) FILTER (mask = own), 0) AS unique_fails, coalesce(sum(good) FILTER (fails AND NOT before), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails AND NOT before), 0) AS toxic_lost
  FROM tried GROUP BY ALL)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM removed
"""
