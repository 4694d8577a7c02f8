"""Join of documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

1. Each text becomes its set of shingles and 128 MinHash values. Texts with equal sets form a class, and one of them
   stands for it from here on, so copies are never compared or expanded into pairs.
2. Classes that share four MinHash values in a row of bands meet in a bucket. There, MinHash values are compared a few
   at a time; a pair is dropped as soon as the posterior probability that its similarity reaches the threshold, given
   the matches so far and a uniform prior, falls below ``TOLERANCE``. Of the pairs that stay, a bucket gives only a
   spanning forest, never all pairs.
3. The forests' connected components are candidate groups. In each, the pairs that share a band are compared in the same
   way and those that stay are verified exactly on their shingles; what leaves the task is a count and a root for each
   class.

Two classes of similarity 0.8 miss each other in all 32 bands with a probability below 1e-7. Large buckets and groups
are cut into blocks, and each pair of blocks is a task of its own, so no task holds an unbounded group.

Words are lower-case runs of letters and digits, in scripts without spaces single characters. Shingles and words are told apart by 64-bit hashes.

Defined cases: a text of one to four words has one shingle, all its words; a text without words (null, empty) is in no
class and links with nothing; a row without doc_id is in a class, but never its representative; repeated rows are
copies of each other; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import block_pairs, chunks, materialise, quoted, table
from panelforge.llm.components import components
from panelforge.llm.words import NORMAL, mixed, run_hashes, spaced, word_hashes

WIDTH = 5
THRESHOLD = 0.8
HASHES = 128  # 16 bits of each, four to a band
STEP = 16
TOLERANCE = 1e-7
BUCKET_ROWS = 1000
GROUP_ROWS, GROUP_SHINGLES = 256, 3_000_000

_RAND = np.random.default_rng(71)
FACTORS = _RAND.integers(1, 1 << 63, HASHES).astype(np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _RAND.integers(1, 1 << 63, HASHES).astype(np.uint64)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data = [spaced(t or "").encode("utf-8", "surrogatepass") for t in texts]
    hashes, first, _ = word_hashes(data, NORMAL)
    runs = run_hashes(hashes, WIDTH)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= WIDTH:
            out.append(np.unique(runs[a : b - WIDTH + 1]))
        else:
            out.append(run_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(texts, HASHES) uint16: parts of the MinHash values; every set must have an element."""
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), HASHES), np.uint16)
    with np.errstate(over="ignore"):
        for k in range(HASHES):
            low = np.minimum.reduceat(flat * FACTORS[k] + SHIFTS[k], first)
            out[:, k] = (mixed(low) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit id for each set (as int64), equal for equal sets."""
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    with np.errstate(over="ignore"):
        sums = np.add.reduceat(mixed(flat * BASE_A), first) ^ np.add.reduceat(mixed(flat * BASE_B), first) << np.uint64(1)
        return mixed(sums + np.array([len(s) for s in sets], np.uint64)).view(np.int64)


BASE_A, BASE_B = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@lru_cache(maxsize=8)
def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> tuple[int, ...]:
    """For STEP, 2 * STEP, ... compared values, the fewest matches that keep a pair.

    With a uniform prior, the posterior after m matches of k is Beta(m + 1, k - m + 1), and the probability that it
    reaches t is that of at most m successes in k + 1 trials of probability t.
    """
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        while True:
            total += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if total >= tolerance:
                break
            m += 1
        out.append(m)
    return tuple(out)


def surviving(sig: np.ndarray, size: int, sigs: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Those of ``rows`` that may reach the threshold with the given one: by size, then by MinHash step by step."""
    other = sizes[rows]
    rows = rows[np.minimum(other, size) >= THRESHOLD * np.maximum(other, size) - 1e-9]
    matches = np.zeros(len(rows), np.int64)
    for step, least in enumerate(least_matches()):
        if not rows.size:
            break
        part = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (sigs[rows, part] == sig[part]).sum(axis=1)
        keep = matches >= least
        rows, matches = rows[keep], matches[keep]
    return rows


def forest(sigs: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph of surviving pairs."""
    left, out = np.arange(len(sizes)), []
    while left.size > 1:
        frontier, left = [int(left[0])], left[1:]
        while frontier and left.size:
            i = frontier.pop()
            found = surviving(sigs[i], int(sizes[i]), sigs, sizes, left)
            if found.size:
                out.extend((i, int(j)) for j in found)
                frontier.extend(found.tolist())
                left = np.setdiff1d(left, found, assume_unique=True)
    return out


def verified_links(sets: list[np.ndarray], sigs: np.ndarray, pairs_of: Callable[[int], np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row, the rows among ``pairs_of(row)`` that reach the threshold, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(values), np.int32)
    for i in range(len(sets)):
        rows = surviving(sigs[i], int(sizes[i]), sigs, sizes, pairs_of(i))
        if not rows.size:
            continue
        own = codes[first[i] : first[i + 1]]
        mark[own] = 1
        if len(rows) > 24:
            lengths = sizes[rows]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            at = np.arange(int(lengths.sum())) + np.repeat(first[rows] - starts, lengths)
            common = np.add.reduceat(mark[codes[at]], starts)
        else:
            common = np.array([mark[codes[first[j] : first[j + 1]]].sum() for j in rows])
        mark[own] = 0
        rows = rows[common >= THRESHOLD * (sizes[i] + sizes[rows] - common) - 1e-9]
        if rows.size:
            yield i, rows


class BandMates:
    """The rows of a group that share a band (four MinHash values) with a given one."""

    def __init__(self, sigs: np.ndarray):
        self.bands = np.ascontiguousarray(sigs).view(np.int64)
        self.order = np.argsort(self.bands, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.bands, self.order, axis=0)
        self.mark = np.zeros(len(sigs), bool)

    def of(self, row: int) -> np.ndarray:
        self.mark[:] = False
        for band, value in enumerate(self.bands[row]):
            values = self.sorted[:, band]
            lo, hi = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
            self.mark[self.order[lo:hi, band]] = True
        return np.flatnonzero(self.mark)


def groups_of(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Consecutive rows with the same key, from batches in which equal keys stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(edges, edges[1:]):
            if b == a:
                continue
            if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != int(keys[a]):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, 128, 1):
        sets = shingle_sets(batch.column(1).to_pylist())
        some = [i for i, s in enumerate(sets) if len(s)]
        cid: list = [None] * len(sets)
        bands: list = [None] * len(sets)
        if some:
            kept = [sets[i] for i in some]
            for i, c, b in zip(some, class_ids(kept).tolist(), signatures(kept).view(np.int64)):
                cid[i], bands[i] = c, b
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(cid, pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
             pa.array(bands, pa.list_(pa.int64()))],
            ["doc_id", "cid", "n", "bands"],
        )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.ascontiguousarray(column.combine_chunks().flatten().to_numpy()).view(np.uint16).reshape(-1, HASHES)


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a: list[int] = []
    b: list[int] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    for group in groups_of(batches, "g"):
        cids = group.column("cid").to_pylist()
        for i, j in forest(_matrix(group.column("bands")), group.column("n").to_numpy()):
            a.append(cids[i])
            b.append(cids[j])
        if len(a) > 10_000:
            yield flush()
            a.clear()
            b.clear()
    yield flush()


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts of representatives to their shingles; a row whose text is not the one meant is left out."""
    for batch in chunks(batches, 128, 1):
        sets = shingle_sets(batch.column(0).to_pylist())
        cids = batch.column(1).to_pylist()
        found = class_ids([s if len(s) else np.zeros(1, np.uint64) for s in sets]).tolist()
        good = [i for i, s in enumerate(sets) if len(s) and found[i] == cids[i]]
        rest = batch.select(batch.schema.names[1:]).take(pa.array(good, pa.int64()))
        yield pa.RecordBatch.from_arrays(
            [*rest.columns, pa.array([sets[i].tobytes() for i in good], pa.binary())], [*rest.schema.names, "shingles"]
        )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in groups_of(batches, "g"):
        cids, place = [], {}
        rows = list(zip(group.column("cid").to_pylist(), group.column("b").to_pylist(), group.column("copies").to_pylist(),
                        group.column("shingles").to_pylist()))
        for row in rows:
            if row[0] not in place:  # repeated rows of a representative
                place[row[0]] = len(cids)
                cids.append(row)
        bi, bj = group.column("bi")[0].as_py(), group.column("bj")[0].as_py()
        cids.sort(key=lambda r: (r[1], r[0]))
        sets = [np.frombuffer(r[3], np.uint64) for r in cids]
        block = np.array([r[1] for r in cids])
        copies = np.array([r[2] for r in cids], np.int64)
        sigs = signatures(sets)
        mates = BandMates(sigs)

        def ahead(i: int) -> np.ndarray:
            if bi != bj and block[i] != bi:
                return np.zeros(0, np.int64)
            rows = mates.of(i)
            return rows[rows > i] if bi == bj else rows[block[rows] == bj]

        links, root = np.zeros(len(cids), np.int64), list(range(len(cids)))

        def top(i: int, root: list[int] = root) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i, found in verified_links(sets, sigs, ahead):
            links[i] += copies[found].sum()
            links[found] += copies[i]
            for j in found.tolist():
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in cids], pa.int64()), pa.array(links),
             pa.array([cids[top(i)][0] for i in range(len(cids))], pa.int64()),
             pa.array([group.column("blocks")[0].as_py() > 1] * len(cids))],
            ["cid", "links", "root", "cut"],
        )


def classes_and_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links, component_id, kept) for every row of ``docs``.

    class_id is the smallest doc_id with the same shingles, n_links the number of other documents within the
    threshold (copies included), component_id the smallest doc_id that links lead to, kept whether it is doc_id.
    """
    read = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    sketches = materialise(read.mapInArrow(_sketches, "doc_id bigint, cid bigint, n int, bands array<bigint>"), "sketches")
    classes = (
        sketches.where("cid is not null")
        .groupBy("cid")
        .agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"))
    )
    # any row of a class has its bands; the one with the smallest id is taken
    reps = sketches.select("cid", "doc_id", "bands").join(
        classes.select("cid", F.col("rep").alias("doc_id"), "n"), ["cid", "doc_id"]
    )
    members = reps.select("cid", F.posexplode("bands").alias("band", "value")).select(
        "cid", F.xxhash64("band", "value").alias("bucket")
    ).distinct()
    dealt = block_pairs(members, ["bucket"], "cid", BUCKET_ROWS)
    links = (
        dealt.select("cid", F.xxhash64("bucket", "bi", "bj").alias("g"))
        .join(reps.select("cid", "n", "bands").dropDuplicates(["cid"]), "cid")
        .repartition("g")
        .sortWithinPartitions("g")
        .mapInArrow(_bucket_links, "a bigint, b bigint")
    )
    groups = components(links).select(F.col("node").alias("cid"), F.col("component").alias("grp"))
    groups = groups.join(classes, "cid")
    sizes = groups.groupBy("grp").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / GROUP_ROWS, F.sum("n") / GROUP_SHINGLES)).cast("int").alias("blocks")
    )
    placed = groups.join(sizes, "grp").withColumn("b", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    shingled = (
        read.join(placed.withColumnRenamed("rep", "doc_id"), "doc_id")
        .select("text", "cid", "grp", "copies", "blocks", "b")
        .mapInArrow(_shingled, "cid bigint, grp bigint, copies bigint, blocks int, b int, shingles binary")
        .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumns({"bi": F.least("b", "o"), "bj": F.greatest("b", "o")})
        .withColumn("g", F.xxhash64("grp", "bi", "bj"))
        .drop("o", "grp")
    )
    verified = materialise(
        shingled.repartition("g").sortWithinPartitions("g").mapInArrow(
            _verified, "cid bigint, links bigint, root bigint, cut boolean"
        ),
        "verified",
    )
    joined = components(verified.where("cut").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    tops = verified.where("not cut").select("cid", F.col("root").alias("top"), "links").unionByName(
        verified.where("cut").groupBy("cid").agg(F.sum("links").alias("links"))
        .join(joined, F.col("cid") == F.col("node"), "left")
        .select("cid", F.coalesce("component", "cid").alias("top"), "links")
    )
    known = classes.join(tops, "cid", "left").select(
        "cid", "rep", F.coalesce("top", "cid").alias("top"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
    )
    least = known.groupBy("top").agg(F.min("rep").alias("component_id"))
    known = materialise(known.join(least, "top").select("cid", F.col("rep").alias("class_id"), "n_links", "component_id"), "classes")
    return (
        sketches.select("doc_id", "cid")
        .join(known, "cid", "left")
        .select(
            "doc_id",
            "class_id",
            F.coalesce("n_links", F.lit(0)).alias("n_links"),
            F.when(F.col("cid").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.col("component_id").isNull()))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes_and_links(table(spark, sf_dir, "documents"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``docs`` without the documents that links connect to one with a smaller id; columns stay as they are.

    Rows that repeat the doc_id of a kept document all stay, as they are one document; rows without doc_id stay too, as
    no decision can name them.
    """
    gone = classes_and_links(docs).groupBy("doc_id").agg(F.max("kept").alias("kept")).where("not kept")
    return docs.join(gone.select("doc_id"), "doc_id", "left_anti").select(*map(quoted, docs.columns))
