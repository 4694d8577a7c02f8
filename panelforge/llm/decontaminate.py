"""Benchmark decontamination by spaced seeds.

A mask reads some of the next token positions and ignores the others, so substituted tokens at ignored positions
do not hinder a hit. The masks' hashes of all benchmark items are joined with those of every document; around each
hit the two token sequences are laid on top of each other and the overlap is verified. Two texts overlap where
``WINDOW`` consecutive tokens differ in at most ``SUBSTITUTIONS`` places; the four masks are lossless for this: for
any places of the substitutions, one of them reads none (a test goes through all). An item of 8 to 12 tokens must
occur as a whole with at most one substitution, and is sought by its two halves; a shorter one must occur as it is
(``shortest`` leaves out items of fewer tokens, which common texts may hold by chance; by default none).

Tokens are lower-case runs of letters and digits; in scripts without spaces each character is one.

The benchmark side goes to the executors in blocks of at most ``block_chars`` characters, one pass each, so that
what is broadcast has a bound; the documents are never shuffled. Hits are expanded ``HITS`` at a time, so a seed that
stands in very many items, or very often in a text, costs time in proportion to its overlaps but no more memory.

Defined cases: null and empty texts on either side match nothing; a null item_id is an id like any other; repeated
documents and items give a row for each pair; very long texts are read whole; empty tables give an empty result;
other columns of the inputs are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import chunks, table
from panelforge.llm.words import spaced

#: Positions that each mask reads. Found by a greedy search over all masks of 7 positions.
MASKS = ((0, 1, 2, 3, 5, 6, 7), (0, 1, 2, 4, 7, 8, 9), (0, 1, 2, 3, 4, 5, 6), (0, 1, 2, 4, 5, 6, 7))
WINDOW = 13
SUBSTITUTIONS = 2
ONE_OFF = 8  # from so many tokens on, an item below WINDOW may differ in one place
HITS = 1 << 20
#: ASCII characters that are neither letters nor digits become spaces.
TO_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
SCHEMA = "doc_id bigint, item_id bigint, item_tokens int, matched_tokens int, covered_tokens int, doc_start int, item_start int"


def tokens_of(text: str | None) -> list[bytes]:
    return spaced(text or "").encode("utf-8", "surrogatepass").translate(TO_SPACES).split()


class Seeds:
    """The benchmark side: token ids of all items, and their places by hash for every mask."""

    def __init__(self, items: list[tuple[int | None, str | None]], shortest: int = 1):
        tokens = [(item, found) for item, text in items if len(found := tokens_of(text)) >= max(shortest, 1)]
        self.ids = [item for item, _ in tokens]
        words = sorted({w for _, found in tokens for w in found})
        self.number = {w: i + 1 for i, w in enumerate(words)}
        rand = np.random.default_rng(20240501)
        self.code = rand.integers(1, 1 << 63, len(words) + 1).astype(np.uint64)
        self.factor = rand.integers(1, 1 << 63, 64).astype(np.uint64) | np.uint64(1)
        self.items = [np.array([self.number[w] for w in found], np.int32) for _, found in tokens]
        masks: dict[tuple[int, ...], list[tuple[int, int, int]]] = defaultdict(list)
        for i, item in enumerate(self.items):
            n = len(item)
            if n < ONE_OFF:
                places = [(tuple(range(n)), 0)]
            elif n < WINDOW:
                places = [(tuple(range(n // 2)), 0), (tuple(range(n - n // 2)), n // 2)]
            else:
                places = [(m, q) for m in MASKS for q in range(n - m[-1])]
            for mask, q in places:
                masks[mask].append((int(self.hashes(item, np.array([q]), mask)[0]), i, q))
        self.tables = {}
        for mask, rows in masks.items():
            keys, item, place = (np.array(x, t) for x, t in zip(zip(*sorted(rows)), (np.uint64, np.int64, np.int64)))
            self.tables[mask] = keys, item, place

    def hashes(self, ids: np.ndarray, starts: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
        with np.errstate(over="ignore"):
            out = np.zeros(len(starts), np.uint64)
            for k, offset in enumerate(mask):
                out += self.code[ids[starts + offset]] * self.factor[k]
        return out ^ (out >> np.uint64(31))

    def overlaps(self, texts: list[str | None], any_item: bool = False) -> list[list[tuple[int, int, int, int, int]]]:
        """For each text, (item's place, matched, covered, start in text, start in item) of each item it overlaps;
        with ``any_item``, of one of them."""
        get, found = self.number.get, [tokens_of(t) for t in texts]
        sizes = np.array([len(x) for x in found], np.int64)
        ids = np.fromiter((get(w, 0) for x in found for w in x), np.int32, int(sizes.sum()))
        first = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(texts)), sizes)
        out: list[dict[int, tuple]] = [{} for _ in texts]
        for hits in self._hits(ids, first, owner):
            for t, i, shift in np.unique(hits, axis=0).tolist():
                if any_item and out[t]:
                    continue
                if (row := self.verified(ids[first[t] : first[t + 1]], self.items[i], shift)) is not None:
                    out[t][i] = max(out[t].get(i, (0,)), row)
        return [[(i, *row) for i, row in sorted(x.items())] for x in out]

    def _hits(self, ids: np.ndarray, first: np.ndarray, owner: np.ndarray) -> Iterator[np.ndarray]:
        """Rows (text, item, shift of the item in the text) for equal hashes, about ``HITS`` at a time."""
        known = ids > 0
        held, count = [np.zeros((0, 3), np.int64)], 0
        for mask, (keys, item, place) in self.tables.items():
            n = len(ids) - mask[-1]
            if n <= 0:
                continue
            good = known[:n].copy()
            for offset in mask[1:]:
                good &= known[offset : offset + n]
            starts = np.flatnonzero(good)
            starts = starts[owner[starts] == owner[starts + mask[-1]]]
            if not starts.size:
                continue
            h = self.hashes(ids, starts, mask)
            lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
            some = np.flatnonzero(hi > lo)
            starts, lo, many = starts[some], lo[some], (hi - lo)[some]
            cuts = np.searchsorted(np.cumsum(many), np.arange(HITS, int(many.sum()) + HITS, HITS))
            for a, b in zip([0, *(cuts + 1).tolist()], [*(cuts + 1).tolist(), len(starts)]):
                m = many[a:b]
                if not m.size:
                    continue
                at = starts[a:b].repeat(m)
                row = np.arange(len(at)) - np.repeat(np.cumsum(m) - m, m) + lo[a:b].repeat(m)
                held.append(np.stack([owner[at], item[row], at - first[owner[at]] - place[row]], 1))
                count += len(at)
                if count >= HITS:
                    yield np.concatenate(held)
                    held, count = [np.zeros((0, 3), np.int64)], 0
        yield np.concatenate(held)

    @staticmethod
    def verified(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int, int] | None:
        """(matched, covered, start in text, start in item) of the overlap of the item laid at ``shift``, or None."""
        lo, hi = max(0, -shift), min(len(item), len(text) - shift)
        width, most = (WINDOW, SUBSTITUTIONS) if len(item) >= WINDOW else (len(item), int(len(item) >= ONE_OFF))
        if hi - lo < width:
            return None
        same = (text[lo + shift : hi + shift] == item[lo:hi]).astype(np.int64)
        sums = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(sums[width:] - sums[:-width] >= width - most)
        if not good.size:
            return None
        edge = np.zeros(hi - lo + 1, np.int64)
        np.add.at(edge, good, 1)
        np.add.at(edge, good + width, -1)
        covered = np.cumsum(edge)[:-1] > 0
        start = int(good[0]) + lo
        return int(same[covered].sum()), int(covered.sum()), start + shift, start


def blocks_of(benchmark: DataFrame, block_chars: int, shortest: int = 1) -> Iterator[Seeds]:
    """The benchmark (item_id, text) in blocks of bounded size; one block for a usual benchmark."""
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    chars = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    n = -(-max(chars, 1) // block_chars)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Seeds([(r["item_id"], r["text"]) for r in part.toLocalIterator()], shortest)


def overlaps(docs: DataFrame, benchmark: DataFrame, block_chars: int = 4_000_000, shortest: int = 1) -> DataFrame:
    """A row for each document and item that overlap: how much of the item, and where the overlap begins."""
    spark, out = docs.sparkSession, None
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    for block in blocks_of(benchmark, block_chars, shortest):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            seeds: Seeds = shared.value
            for batch in chunks(batches):
                rows = [
                    (doc, seeds.ids[i], len(seeds.items[i]), matched, covered, start, item_start)
                    for doc, found in zip(batch.column(0).to_pylist(), seeds.overlaps(batch.column(1).to_pylist()))
                    for i, matched, covered, start, item_start in found
                ]
                if rows:
                    kinds = (pa.int64(), pa.int64(), *(pa.int32(),) * 5)
                    names = [x.split()[0] for x in SCHEMA.split(", ")]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        part = read.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def contaminated(
    spark: SparkSession, text: Column, benchmark: DataFrame, block_chars: int = 4_000_000, shortest: int = 1
) -> Column:
    """Whether a text column overlaps any item."""
    out = F.lit(False)
    for block in blocks_of(benchmark, block_chars, shortest):
        out = out | _hit(spark.sparkContext.broadcast(block))(F.coalesce(text, F.lit("")))
    return out


def _hit(shared):
    @F.pandas_udf("boolean")
    def hit(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            texts = part.tolist()
            flags = [bool(x) for k in range(0, len(texts), 256) for x in shared.value.overlaps(texts[k : k + 256], True)]
            yield pd.Series(flags, dtype="bool")

    return hit


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of ``docs`` that overlap no item of the benchmark table, with their columns as they are."""
    return docs.where(~contaminated(spark, docs["text"], table(spark, sf_dir, "benchmark")))
