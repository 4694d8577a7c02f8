"""Periodic runs of words and their collapse, by Kolpakov and Kucherov's algorithm.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no neighbour extends. All runs
of at least ``exponent`` periods and ``shortest`` words are found:

1. ``factors`` cuts a word sequence into Lempel-Ziv factors with its suffix automaton: each is the longest stretch that also
   starts earlier, or one new word.
2. ``crossing`` is Main's algorithm: runs that end in a factor and start before it, or at its first word, are found by
   common extensions from the factor's border, of each period. Such a run starts less than a period before the factor before
   (or that factor would be longer), which bounds the stretch to be searched.
3. Runs inside a factor are copied from its earlier occurrence.

Before that, ``islands`` leaves out words that cannot be in a run of four periods: all triples of words in such a run occur
three times in it at least, the nearest of them within a quarter of its words. What is left is cut where a triple was left
out, and looked at again until nothing changes. This works on hashes, which can only keep more; runs are found on the words
themselves. Each document is one row of one task; words of a batch are numbers in numpy, and the automaton holds one island
of one document at a time.

Words are runs of characters other than ASCII white space, unchanged. A word is dropped if any run contains it after that
run's first period; the others are joined by single spaces.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; rows are looked at one by one, so
repeated rows and rows without doc_id get results of their own; an empty table gives an empty result; other columns are
ignored, whatever their names. Memory of a task grows with its longest text, and within it by some 500 bytes a word of the
largest island.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import chunks, table
from panelforge.llm.words import PLAIN, mixed, run_hashes, word_hashes

EXPONENT = 4
SHORTEST = 6
BLANKS = "[\\x20\\x09-\\x0D]+"


def factors(words: Sequence[int]) -> list[tuple[int, int, int | None]]:
    """Lempel-Ziv factors as (start, length, start of an earlier occurrence or None); the two may overlap."""
    step: list[dict[int, int]] = [{}]
    link, length, end = [-1], [0], [-1]  # end: where the first occurrence of a state's stretches ends
    last = 0
    for at, word in enumerate(words):
        new, state = len(step), last
        step.append({})
        length.append(length[last] + 1)
        end.append(at)
        link.append(0)
        while state >= 0 and word not in step[state]:
            step[state][word] = new
            state = link[state]
        if state >= 0:
            to = step[state][word]
            if length[to] != length[state] + 1:
                twin = len(step)
                step.append(dict(step[to]))
                length.append(length[state] + 1)
                end.append(end[to])
                link.append(link[to])
                link[to] = twin
                while state >= 0 and step[state].get(word) == to:
                    step[state][word] = twin
                    state = link[state]
                to = twin
            link[new] = to
        last = new
    out, start, n = [], 0, len(words)
    while start < n:
        state, stop = 0, start
        while stop < n:
            to = step[state][words[stop]]
            if end[to] >= stop:  # occurs here first
                break
            state, stop = to, stop + 1
        out.append((start, stop - start, end[state] - (stop - start) + 1) if stop > start else (start, 1, None))
        start = max(stop, start + 1)
    return out


def extensions(s: Sequence[int]) -> list[int]:
    """Of each place, the length of the longest stretch from there that the sequence begins with."""
    n, left, right = len(s), 0, 0
    z = [0] * n
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def crossing(words: Sequence[int], low: int, border: int, stop: int, most: int, wanted) -> Iterator[tuple[int, int, int]]:
    """(start, end, period <= ``most``) of repetitions within ``low`` and ``stop`` that start at ``border`` or before and end
    after it."""
    left, right = words[low:border], words[border:stop]
    a, b = len(left), len(right)
    ahead = extensions([*right, -1, *left, *right])  # against what starts at each place
    back = extensions([*left[::-1], -1, *right[::-1], *left[::-1]])  # against what ends there
    for q in range(1, most + 1):
        if q < b:  # a whole period after the border
            start, end = border - back[a + 1 + b - q], border + q + ahead[q]
            if wanted(end - start, q):
                yield start, end, q
        if q <= a:  # a whole period before it
            start, end = border - q - (back[q] if q < a else 0), border + ahead[b + 1 + a - q]
            if end > border and wanted(end - start, q):
                yield start, end, q


def runs(words: Sequence[int], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of all runs of a sequence of numbers from 0, in order."""
    wanted = lambda length, q: length >= shortest and length >= exponent * q
    found: dict[int, dict[int, int]] = {}  # start: {end: period}

    def add(start: int, end: int, q: int) -> None:
        if end < len(words) and words[end] == words[end - q]:
            return  # goes on in a later factor, where it is found
        ends = found.setdefault(start, {})
        ends[end] = min(ends.get(end, q), q)

    before = 0  # length of the factor before
    for start, length, source in factors(words):
        most = (length + before - 1) // (exponent - 1)
        if most:
            for run in crossing(words, max(0, start - before - most), start, start + length, most, wanted):
                add(*run)
        if source is not None and length >= shortest and found:
            moved = start - source
            inside = range(source + 1, source + length)
            # an earlier occurrence that overlaps the factor has runs that are themselves copied on the way
            for s in inside if start < source + length or len(found) > length else sorted(found.keys() & inside):
                for end, q in list(found.get(s, {}).items()):
                    end = min(end + moved, start + length)
                    if wanted(end - s - moved, q):
                        add(s + moved, end, q)
        before = length
    return [(s, end - s, q) for s, ends in sorted(found.items()) for end, q in sorted(ends.items(), key=lambda x: x[1])]


def islands(hashes: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (from, to) of all texts' words that hold every run of four periods and six words; ``first`` has the places
    where texts begin, and the end."""
    triples = run_hashes(hashes, 3)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(triples)]
    at = np.flatnonzero(np.arange(len(triples)) + 3 <= first[1:][text])  # triples that end in their text
    part = text[at]
    while len(at):
        with np.errstate(over="ignore"):
            key = mixed(triples[at] ^ mixed(part.astype(np.uint64)))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        gap = np.where(same, np.diff(at[order]), 1 << 40)
        edge = np.array([1 << 40])
        nearest = np.empty(len(at), np.int64)
        nearest[order] = np.minimum(np.concatenate([edge, gap]), np.concatenate([gap, edge]))
        bounds = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(at)]])
        times = np.empty(len(at), np.int64)
        times[order] = np.repeat(np.diff(bounds), np.diff(bounds))
        size = np.bincount(part)[part] + 2
        good = (times >= 3) & (nearest <= size // 4)
        new = np.concatenate([[True], (np.diff(at[good]) > 1) | (np.diff(part[good]) != 0)]) if good.any() else np.zeros(0, bool)
        now, at_now = np.cumsum(new) - 1, at[good]
        long = np.bincount(now)[now] >= 4 if len(now) else new
        if good.all() and long.all() and (now == part - part[0]).all():
            break
        at, part = at_now[long], now[long]
        part = np.unique(part, return_inverse=True)[1]
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(part)) + 1
    return [(int(p[0]), int(p[-1]) + 3) for p in np.split(at, cuts)]


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def _found(exponent: int, shortest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, 128, 1):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
            hashes, first, _ = word_hashes(texts, PLAIN)
            if exponent >= EXPONENT and shortest >= SHORTEST:
                parts = islands(hashes, first)
            else:
                parts = [(a, b) for a, b in zip(first[:-1].tolist(), first[1:].tolist()) if b > a]
            of_text: dict[int, list[tuple[int, int]]] = {}
            for a, b in parts:
                of_text.setdefault(int(np.searchsorted(first, a, "right")) - 1, []).append((a, b))
            counts, found, kept = [], [], []
            for i, text in enumerate(texts):
                words, got = text.split(), []
                for a, b in of_text.get(i, ()):
                    numbers: dict[bytes, int] = {}
                    a, b = a - int(first[i]), b - int(first[i])
                    own = [numbers.setdefault(w, len(numbers)) for w in words[a:b]]
                    got += [(a + s, n, q) for s, n, q in runs(own, exponent, shortest)]
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in got])
                if got:
                    edge = np.zeros(len(words) + 1, np.int64)
                    for s, n, q in got:
                        edge[s + q] += 1
                        edge[s + n] -= 1
                    words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0)]
                kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, _RUNS), pa.array(kept, pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"],
            )

    return run


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs by start and period, collapsed text) of every row of ``docs``; ``exponent`` is 2 at least."""
    if exponent < 2:
        raise ValueError("a run has two periods at least")
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return read.mapInArrow(
        _found(exponent, shortest),
        "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string",
    )


def repeated_tail(doc_id: Column, text: Column) -> Column:
    """The text with the tail that the query plants: of every tenth hash, words from the a-th on repeat with period p."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i >= a, a + (i - a) % p).otherwise(i).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(places, lambda i: F.get(words, i)), " ")).otherwise("")

    words = F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")
    return F.when(h % 10 == 0, F.transform(F.array(words), planted)[0]).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = find_runs(docs.select("doc_id", repeated_tail(F.col("doc_id"), F.col("text")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), longest.alias("_top"), listed.alias("_listed"), "collapsed"
    ).select(
        "doc_id",
        "n_runs",
        (-F.col("_top.s")).alias("start"),
        F.col("_top.length").alias("length"),
        (-F.col("_top.q")).alias("period"),
        F.floor(1000 * F.col("_top.length") / -F.col("_top.q")).alias("exponent_milli"),
        F.sha2("_listed", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: Every pair of equal words of a text, at most a quarter of it apart; pairs of one distance and consecutive places are a run.
ORACLE_SQL = r"""
WITH split AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS k,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
hashed AS (
  SELECT doc_id, ws, len(ws) AS n, xor(list_reduce(range(8 * len(k)), lambda acc, i:
    xor(xor(acc, CASE WHEN i % 8 = 0 THEN ord(k[i // 8 + 1]) ELSE 0 END) >> 1,
      3988292384 * (xor(acc, CASE WHEN i % 8 = 0 THEN ord(k[i // 8 + 1]) ELSE 0 END) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM split),
placed AS (
  SELECT *, CASE WHEN n > 0 THEN (h // 10) % n END AS a,
    CASE WHEN n > 0 THEN 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) END AS p FROM hashed),
docs AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0
    THEN list_transform(range(n), lambda i: ws[CASE WHEN i >= a THEN a + (i - a) % p ELSE i END + 1]) ELSE ws END AS ws FROM placed),
words AS (SELECT doc_id, n, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM docs),
pairs AS (
  SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word
  WHERE y.i > x.i AND y.i - x.i <= x.n // 4),
marked AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM pairs),
repeats AS (
  SELECT doc_id, q, min(i) AS s, count(*) + q AS l FROM marked GROUP BY doc_id, q, island HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM repeats GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (
  SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) FILTER (g.i IS NULL) AS text
  FROM words w LEFT JOIN gone g ON w.doc_id = g.doc_id AND w.i = g.i GROUP BY w.doc_id),
of_doc AS (
  SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS listed,
    max({'l': l, 's': -s, 'q': -q}) AS top FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(-top.s AS BIGINT) AS start, CAST(top.l AS BIGINT) AS length,
  CAST(-top.q AS BIGINT) AS period, CAST(1000 * top.l // -top.q AS BIGINT) AS exponent_milli,
  sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(k.text, '')) AS collapsed_sha256
FROM docs d LEFT JOIN of_doc USING (doc_id) LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
