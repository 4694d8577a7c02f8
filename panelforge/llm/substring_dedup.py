"""Removal of long passages that an earlier document has, by suffix automata.

A window of 50 words is removed if it also starts in a document with a smaller id; the words it covers go. Windows
are found by matching statistics: a text is streamed through the suffix automaton of reference texts, which tells for
every position how long the match is that ends there, and from whom.

The reference is the corpus itself, so its automaton cannot be broadcast as a whole; it is cut into shards that hold
all a window can match, and shard and stream meet by key instead:

1. Each stretch of 30 words picks the smallest hash of its 10-word runs, its anchor. Equal windows hold equal stretches,
   so only windows whose stretches all have anchors that several documents share can match. Anchors are counted with
   partial aggregation and joined back to their documents.
2. The words of candidate windows go, deduplicated, to the shard of their smallest anchor. There they arrive in the
   order of their first document, and each is streamed through the automaton of those before it, then added to it.
   A shard is the text around one anchor; one with a single distinct text needs no automaton. An anchor of more than
   ``SHARD_TEXTS`` texts is cut into as many shards as that takes; the texts of each are streamed past every shard's
   automaton, a task for each pair, so that a task holds two shards at most, whatever share of the corpus has the anchor.
3. Each document looks up its texts' results; words are removed where a window was found in an earlier document.

Words are runs of characters other than ASCII white space, unchanged.

Defined cases: a null text has no words; a row without doc_id loses no words and removes none; repeated rows do not
remove each other, as their ids are equal; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import block_pairs, chunks, materialise, scratch, table
from panelforge.llm.words import PLAIN, run_hashes, word_hashes

WINDOW = 50
STRETCH = 30
RUN = 10
SHARD_TEXTS = 256


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    n, size = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while size * 2 <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size : width - size + n])


def _texts(column: pa.Array) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in column.to_pylist()]


def stretch_anchors(texts: list[bytes], least: int = WINDOW) -> Iterator[np.ndarray]:
    """For each text, the anchor (int64) of the stretch at each word; none for texts of fewer than ``least`` words."""
    hashes, first, _ = word_hashes(texts, PLAIN)
    runs = run_hashes(hashes, RUN).view(np.int64)
    lows = sliding_min(runs, STRETCH - RUN + 1)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        yield lows[a : b - STRETCH + 1] if b - a >= least else lows[:0]


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 128, 1):
        found = [np.unique(x) for x in stretch_anchors(_texts(batch.column(1)))]
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(x) for x in found])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(ids, pa.int64())], ["anchor", "doc_id"])


def candidate_texts(words: list[bytes], lows: np.ndarray, shared: np.ndarray) -> list[dict]:
    """Stretches of words whose windows may occur elsewhere: anchor, place of the first window, words."""
    good = np.isin(lows, shared)
    span = WINDOW - STRETCH + 1
    count = np.concatenate([[0], np.cumsum(good)])
    windows = count[span:] - count[:-span] == span
    route = sliding_min(lows, span)
    at = np.flatnonzero(windows)
    if not at.size:
        return []
    cuts = np.flatnonzero((np.diff(at) > 1) | (np.diff(route[at]) != 0)) + 1
    return [
        {"anchor": int(route[p[0]]), "start": int(p[0]), "words": b" ".join(words[p[0] : p[-1] + WINDOW])}
        for p in np.split(at, cuts)
    ]


PARTS = "array<struct<anchor:bigint,start:int,words:binary>>"
_PARTS = pa.list_(pa.struct([("anchor", pa.int64()), ("start", pa.int32()), ("words", pa.binary())]))


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents without candidates are done; the others keep their text and list their candidate texts."""
    for batch in chunks(batches, 128, 1):
        texts = _texts(batch.column(1))
        counts, digests, kept, parts = [], [], [], []
        for text, lows, shared in zip(texts, stretch_anchors(texts), batch.column(2)):
            words = text.split()
            found = candidate_texts(words, lows, shared.values.to_numpy()) if shared.is_valid and len(lows) else []
            counts.append(len(words))
            parts.append(found)
            digests.append(None if found else hashlib.sha256(b" ".join(words)).hexdigest())
            kept.append(b" ".join(words) if found else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(kept, pa.binary()),
             pa.array(parts, _PARTS)],
            ["doc_id", "n_words", "digest", "words", "parts"],
        )


class SuffixAutomaton:
    """Of several word sequences, added one by one; each state knows the first owner of its sequences."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.owner = [-1], [0], [None]

    def _new(self, step: dict, link: int, length: int, owner) -> int:
        self.next.append(step)
        self.link.append(link)
        self.length.append(length)
        self.owner.append(owner)
        return len(self.length) - 1

    def _split(self, state: int, word: bytes, to: int) -> int:
        """The part of ``to`` as long as ``state`` and one word, as a state of its own."""
        twin = self._new(dict(self.next[to]), self.link[to], self.length[state] + 1, self.owner[to])
        self.link[to] = twin
        while state >= 0 and self.next[state].get(word) == to:
            self.next[state][word] = twin
            state = self.link[state]
        return twin

    def add(self, words: list[bytes], owner) -> None:
        last = 0
        for word in words:
            if (to := self.next[last].get(word)) is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._split(last, word, to)
                continue
            new, state = self._new({}, 0, self.length[last] + 1, owner), last
            while state >= 0 and word not in self.next[state]:
                self.next[state][word] = new
                state = self.link[state]
            if state >= 0:
                to = self.next[state][word]
                self.link[new] = to if self.length[to] == self.length[state] + 1 else self._split(state, word, to)
            last = new

    def first_owners(self, words: list[bytes], width: int) -> list:
        """For every window of ``width`` words, the first owner of an equal window, or None."""
        out, state, matched = [], 0, 0
        for end, word in enumerate(words, 1):
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            state = self.next[state].get(word, 0)
            matched = matched + 1 if state else 0
            while matched >= width and self.length[self.link[state]] >= width:
                state = self.link[state]  # longer matches say no more about the window
                matched = self.length[state]
            if end >= width:
                out.append(self.owner[state] if matched >= width else None)
        return out


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of a pair of shards of one anchor, in the order of their first document: of each of their windows, the first
    document that has it among those of the other shard (or of the only one) and the text itself."""
    from panelforge.llm.jaccard_join import groups_of

    for group in groups_of(batches, "g"):
        texts, firsts, shards = (group.column(c).to_pylist() for c in ("words", "first", "b"))
        pair = (group.column("bi")[0].as_py(), group.column("bj")[0].as_py())
        automata = {shard: SuffixAutomaton() for shard in pair} if len(texts) > 1 else None
        out = []
        for text, first, shard in zip(texts, firsts, shards):
            words = text.split(b" ")
            if automata is None:
                out.append([first] * (len(words) - WINDOW + 1))
                continue
            found = automata[pair[shard == pair[0]]].first_owners(words, WINDOW)
            if None in found or pair[0] != pair[1]:
                automata[shard].add(words, first)
            out.append([first if x is None else x for x in found])
        yield pa.RecordBatch.from_arrays(
            [group.column("anchor").combine_chunks(), group.column("text").combine_chunks(), pa.array(out, pa.list_(pa.int64()))],
            ["anchor", "text", "owners"],
        )


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 256):
        gone_counts, digests = [], []
        for text, hits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            words = text.split(b" ")
            edge = np.zeros(len(words) + 1, np.int64)
            starts = np.unique(np.array([x for part in hits or () for x in part], np.int64))
            edge[starts] += 1
            edge[starts + WINDOW] -= 1
            gone = np.cumsum(edge)[:-1] > 0
            gone_counts.append(int(gone.sum()))
            digests.append(hashlib.sha256(b" ".join(words[i] for i in np.flatnonzero(~gone))).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(gone_counts, pa.int64()), pa.array(digests, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256"],
        )


SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``."""
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    with scratch("candidates"):  # the anchors go once the candidates are written
        anchors = materialise(
            read.where("doc_id is not null").mapInArrow(_anchors, "anchor bigint, doc_id bigint"), "anchors"
        )
        shared = (
            anchors.groupBy("anchor")
            .agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
            .where("lo < hi")
            .select("anchor")
        )
        shared = materialise(shared, "shared-anchors")  # so that the join sees its size and splits a hot anchor
        of_docs = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("shared"))
        done = materialise(
            read.join(of_docs, "doc_id", "left").mapInArrow(
                _candidates, f"doc_id bigint, n_words bigint, digest string, words binary, parts {PARTS}"
            ),
            "candidates",
        )
    open_docs = done.where("digest is null").withColumn("whole", F.xxhash64("words"))
    parts = open_docs.select("doc_id", "whole", F.explode("parts").alias("p")).select(
        "doc_id", "whole", "p.anchor", "p.start", F.xxhash64("p.words").alias("text"), F.col("p.words").alias("words")
    )
    texts = materialise(
        parts.groupBy("anchor", "text").agg(F.min("doc_id").alias("first"), F.first("words").alias("words")), "anchor-texts"
    )
    dealt = block_pairs(texts, ["anchor"], "text", SHARD_TEXTS, 1).withColumn("g", F.xxhash64("anchor", "bi", "bj"))
    owners = dealt.repartition("g").sortWithinPartitions("g", "first", "text").mapInArrow(
        _owners, "anchor bigint, text bigint, owners array<bigint>"
    )
    places = F.transform("owners", lambda x, i: F.when(x < F.col("doc_id"), F.col("start") + i))
    hits = (
        parts.select("doc_id", "whole", "anchor", "start", "text")
        .join(owners, ["anchor", "text"])
        .select("doc_id", "whole", F.filter(places, lambda x: x.isNotNull()).alias("hit"))
        .groupBy("doc_id", "whole")
        .agg(F.collect_list("hit").alias("hits"))
    )
    changed = (
        open_docs.join(hits, ["doc_id", "whole"], "left")
        .select("doc_id", "n_words", "words", "hits")
        .mapInArrow(_removed, SCHEMA)
    )
    same = done.where("digest is not null").select(
        "doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("digest").alias("kept_sha256")
    )
    return same.unionByName(changed)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
spots AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS p FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, p, md5(array_to_string(ws[p : p + 49], ' ')) AS h FROM spots),
firsts AS (SELECT h, min(doc_id) AS first FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i
  FROM win JOIN firsts USING (h) WHERE first < doc_id),
word AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (
  SELECT a.doc_id, count(g.i) AS n_removed, string_agg(a.word, ' ' ORDER BY a.i) FILTER (g.i IS NULL) AS text
  FROM word a LEFT JOIN gone g ON a.doc_id = g.doc_id AND a.i = g.i GROUP BY a.doc_id)
SELECT w.doc_id, CAST(len(w.ws) AS BIGINT) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM w LEFT JOIN kept k USING (doc_id)
"""
