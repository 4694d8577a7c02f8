"""Near-duplicate vectors by a subspace pigeonhole join.

For unit vectors, a cosine of at least c means a squared distance of at most D = 2 - 2c. All vectors are turned by one
fixed rotation and cut into blocks of about eight coordinates; each block gets a share of D in proportion to its
width. The squared distance is the sum over blocks, so two vectors within D are within the share of at least one
block. Each block is range-joined: its space is split into cells at quantiles of its coordinates, one coordinate after the
other, as often as it takes for a label's vectors to come to about ``CELL_ROWS`` a cell. A vector is at home in its own
cell and asks there and in every cell whose distance from it is within the block's share (the sum of the squared gaps on
all split coordinates), and pairs of a cell within the share are candidates. The union of all blocks' candidates is
verified exactly, by cosine in double precision.

The quantiles are taken from a sample of about ``SAMPLE`` vectors by a hash of the id; they steer how evenly cells are
filled, never what is found. The more vectors a label has, the more cells it gets, so the vectors compared with each one
grow more slowly than the label.

Equal vectors of a label form a class that is compared once. Cells with many vectors are cut into blocks of rows, and
each pair of blocks is a task of its own.

Defined cases: a vector links only with vectors of the same label (of any type) and length; a null label, and a vector
that is null, empty or zero or holds a null or non-finite component, link with nothing; very large and very small
components are scaled before anything is squared; a row without vec_id can be linked to, and its component is that of
the others, null if there is none; repeated rows are other vectors with the same id; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import block_pairs, materialise, table
from panelforge.llm.components import components
from panelforge.llm.jaccard_join import groups_of

COSINE = 0.98
BLOCK_WIDTH = 8
CELL_ROWS = 256  # vectors of a label that a cell is meant for
GROUP_ROWS = 4000  # rows of a cell in one task
SAMPLE = 20_000
MOST_BITS = 3  # splits of one coordinate: two halves, four quarters, eight parts
SLACK = 1e-6  # for the rounding of coordinates; candidates are verified anyway


@lru_cache(maxsize=16)
def rotation(dim: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))[0]


def blocks(dim: int, cosine: float) -> list[tuple[np.ndarray, float]]:
    """(coordinates, share of the squared distance) of each block."""
    parts = np.array_split(np.arange(dim), max(1, dim // BLOCK_WIDTH))
    return [(p, (2.0 - 2.0 * cosine) * len(p) / dim) for p in parts]


def _rows_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Vectors of each length as (places, matrix in double precision), each scaled by the power of two that brings its
    largest component to between 1/2 and 1, which changes no digit and keeps squares in range."""
    sizes = column.value_lengths().to_numpy()
    flat, first = column.flatten().to_numpy().astype(np.float64), np.concatenate([[0], np.cumsum(sizes)])
    out = {}
    for dim in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == dim)
        rows = flat[first[at][:, None] + np.arange(dim)]
        out[dim] = at, _scaled(rows)
    return out


def _scaled(rows: np.ndarray) -> np.ndarray:
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, keepdims=True))[1])


def _turned(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True) @ rotation(rows.shape[1])


def splits(width: int, halvings: int) -> list[int]:
    """How often each coordinate of a block is halved, if the block's space is to be halved so many times."""
    total = min(halvings, MOST_BITS * width)
    return [total // width + (axis < total % width) for axis in range(width)]


def cells(part: np.ndarray, edges: np.ndarray, bits: list[int], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, cells, whether the cell is the row's own) for all cells within the share of each row of ``part``.

    ``edges`` has the 2 ** MOST_BITS - 1 quantiles of each coordinate.
    """
    rows, code, gap = np.arange(len(part)), np.zeros(len(part), np.int64), np.zeros(len(part))
    home = np.ones(len(part), bool)
    for axis, n in enumerate(bits):
        if not n:
            continue
        step = 1 << (MOST_BITS - n)
        bounds = np.concatenate([[-np.inf], edges[axis, step - 1 :: step], [np.inf]])
        x = part[rows, axis]
        own = np.searchsorted(bounds[1:-1], x, "right")
        parts = []
        for k in range(1 << n):
            away = np.maximum(np.maximum(bounds[k] - x, x - bounds[k + 1]), 0.0)
            total = gap + away * away
            good = np.flatnonzero(total <= share)
            parts.append((rows[good], code[good] << n | k, total[good], home[good] & (own[good] == k)))
        rows, code, gap, home = (np.concatenate(x) for x in zip(*parts))
    return rows, code, home


def quantiles(vectors: DataFrame, total: int) -> dict[int, np.ndarray]:
    """Of each length, (coordinates, 2 ** MOST_BITS - 1) quantiles of the turned coordinates of a sample."""
    drawn = F.pmod(F.xxhash64("cid", F.lit("cells")), F.lit(1 << 30)) < F.lit(int(min(1.0, SAMPLE / max(total, 1)) * (1 << 30)))
    got = vectors.where(drawn).select(F.col("embedding").cast("array<double>")).toArrow().column(0)
    if not len(got):
        return {}
    at = np.arange(1, 1 << MOST_BITS) / (1 << MOST_BITS)
    return {dim: np.quantile(_turned(rows), at, axis=0).T for dim, (_, rows) in _rows_of(got.combine_chunks()).items()}


def _celled(cosine: float, shared):
    """Rows (cid, label, halvings, vector) to one row for each cell of each block that the vector asks in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                cids, labels, halvings = (batch.column(c).to_numpy() for c in range(3))
                for dim, (place, rows) in _rows_of(batch.column(3)).items():
                    turned = _turned(rows)
                    edges = shared.value.get(dim)
                    if edges is None:  # a length that is not in the sample: halves at zero
                        edges = np.zeros((dim, (1 << MOST_BITS) - 1))
                    for b, (coords, share) in enumerate(blocks(dim, cosine)):
                        limit = share * (1.0 + SLACK) + SLACK
                        for depth in np.unique(halvings[place]).tolist():
                            some = np.flatnonzero(halvings[place] == depth)
                            part = turned[np.ix_(some, coords)]
                            row, code, home = cells(part, edges[coords], splits(len(coords), depth), limit)
                            flat = pa.array(part[row].astype(np.float32).ravel())
                            at = place[some[row]]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(cids[at]), pa.array(labels[at]), pa.array(np.full(len(at), dim * 1000 + b, np.int64)),
                                 pa.array(code), pa.array(home), pa.array(np.full(len(at), share)),
                                 pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(coords), dtype=np.int32), flat)],
                                ["cid", "label", "block", "code", "home", "share", "part"],
                            )

    return run


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs (a < b) of each cell: one that asks there, one that is at home there."""
    for group in groups_of(batches, "g"):
        cid, home = group.column("cid").to_numpy(), group.column("home").to_numpy(zero_copy_only=False).astype(bool)
        own, cut = group.column("b").to_numpy(), group.column("bi")[0].as_py() != group.column("bj")[0].as_py()
        part = group.column("part").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(len(cid), -1)
        at_home = np.flatnonzero(home)
        if not at_home.size:
            continue
        limit = group.column("share")[0].as_py() * (1.0 + SLACK) + SLACK
        squares = (part**2).sum(axis=1)
        for k in range(0, len(cid), 512):
            ask = slice(k, k + 512)
            d = squares[ask, None] + squares[at_home] - 2.0 * part[ask] @ part[at_home].T
            good = (d <= limit) & (cid[ask, None] < cid[at_home])
            if cut:
                good &= own[ask, None] != own[at_home]
            i, j = np.nonzero(good)
            if i.size:
                yield pa.RecordBatch.from_arrays([pa.array(cid[ask][i]), pa.array(cid[at_home[j]])], ["a", "b"])


def _checked(cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                keep = np.zeros(batch.num_rows, bool)
                for dim, (at, x) in _rows_of(batch.column(2)).items():
                    y = batch.column(3).take(pa.array(at)).flatten().to_numpy().astype(np.float64).reshape(-1, dim)
                    y = _scaled(y)
                    norms = np.sqrt((x * x).sum(axis=1)) * np.sqrt((y * y).sum(axis=1))
                    keep[at] = (x * y).sum(axis=1) / norms >= cosine
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors`` (vec_id, embedding, label)."""
    usable = (
        F.col("label").isNotNull()
        & (F.size("embedding") > 0)
        & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("embedding", lambda x: x != 0)
    )
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.when(F.col("label").isNotNull(), F.xxhash64("label")).alias("label"), "embedding"
    ).withColumn("cid", F.when(usable, F.xxhash64("label", "embedding")))
    classes = (
        rows.where("cid is not null")
        .groupBy("cid", "label", "embedding")
        .agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    )
    classes = materialise(classes, "vectors")
    # labels with vectors of one length: a few numbers each
    sizes = materialise(
        classes.groupBy("label", F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n")), "label-sizes"
    )
    halvings = F.greatest(F.lit(0), F.ceil(F.log2(F.col("n") / F.lit(CELL_ROWS)))).cast("int")
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    edges = vectors.sparkSession.sparkContext.broadcast(quantiles(classes, total))
    celled = (
        classes.withColumn("dim", F.size("embedding"))
        .join(sizes, ["label", "dim"])
        .select("cid", "label", halvings.alias("halvings"), F.col("embedding").cast("array<double>"))
        .mapInArrow(
            _celled(cosine, edges),
            "cid bigint, label bigint, block bigint, code bigint, home boolean, share double, part array<float>",
        )
    )
    members = celled.select("cid", F.xxhash64("label", "block", "code").alias("cell"), "home", "share", "part")
    candidates = (
        block_pairs(members, ["cell"], "cid", GROUP_ROWS)
        .withColumn("g", F.xxhash64("cell", "bi", "bj"))
        .repartition("g")
        .sortWithinPartitions("g")
        .mapInArrow(_pairs, "a bigint, b bigint")
        .distinct()
    )
    whole = classes.select("cid", F.col("embedding").cast("array<double>").alias("v"))
    links = materialise(
        candidates.join(whole.select(F.col("cid").alias("a"), F.col("v").alias("x")), "a")
        .join(whole.select(F.col("cid").alias("b"), F.col("v").alias("y")), "b")
        .select("a", "b", "x", "y")
        .mapInArrow(_checked(cosine), "a bigint, b bigint"),
        "vector-links",
    )
    copies = classes.select(F.col("cid").alias("b"), "copies")
    counts = (
        links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        .join(copies, "b")
        .groupBy(F.col("a").alias("cid"))
        .agg(F.sum("copies").alias("others"))
    )
    tops = components(links).withColumnRenamed("node", "cid")
    known = (
        classes.select("cid", "rep", "copies")
        .join(counts, "cid", "left")
        .join(tops, "cid", "left")
        .select(
            "cid", "rep", F.coalesce("component", "cid").alias("top"),
            (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        )
    )
    least = known.groupBy("top").agg(F.min("rep").alias("component_id"))
    return (
        rows.select("vec_id", "cid")
        .join(known.join(least, "top").select("cid", "n_links", "component_id"), "cid", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
            F.coalesce("component_id", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (
  SELECT vec_id, vec_id FROM v
  UNION
  SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component_id, e.vec_id) AS component_id,
  coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM embeddings e
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) n ON n.a = e.vec_id
LEFT JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""
