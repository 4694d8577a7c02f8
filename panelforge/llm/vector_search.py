"""Nearest vectors by inner product, with a hierarchical k-means tree.

Vectors get one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm, and queries a zero there: then the nearest point
is the one with the largest inner product, whatever the norms. The tree is fitted on the driver on a sample of at most
``SAMPLE`` different vectors (by hash), node by node, with ``BRANCHES`` children, until a leaf stands for about ``LEAF_ROWS``
vectors; every vector is then sent down the tree to its leaf. The tree is broadcast: its size is bounded by the sample.

A query goes best bin first: a priority queue holds the tree's nodes by the distance from the query to their centroids, the
nearest is taken out, and either opened or, if it is a leaf, visited. How many leaves are visited is calibrated: of about
``TRIALS`` queries the true neighbours are found by looking at all vectors (a pass in which only each task's best are kept),
and visits are widened until the share of true neighbours found reaches ``RECALL``.

A leaf's vectors and the queries that visit it meet by key, each cut into blocks of about ``BLOCK`` rows, so that a task
holds two blocks, whatever share of all vectors a leaf has. Of each block and query the best are kept, and merged by query.
Visits come in rounds: the first few leaves, then several times as many, then the rest (``ROUND_ENDS``). A query takes the
score of its last place into the next round, where only vectors that reach it are kept, so what is moved for a query hardly
grows with the number of leaves it visits.

Vectors that are equal are one class: only the ``k`` + 1 smallest ids of a class can be in a result, and queries that are
equal share one search, so copies cost a row of a table, not a comparison each. Classes are told apart by 64-bit hashes.

Defined cases: a vector that is null, empty or zero or holds a null or non-finite component takes no part, nor does a row
without id; vectors of different length do not meet; a row that repeats id and vector counts once, and a query leaves out
itself, but not another vector with its id; fewer candidates than ``k`` are all returned; of equal scores the smaller id comes first; an empty table
gives an empty result; other columns are ignored, whatever their names. For the tree, components are scaled by a power of
two, so very large and very small ones are searched alike; a score beyond double precision is infinite, as the product is.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import materialise, table
from panelforge.llm.jaccard_join import groups_of

K = 20
SAMPLE = 50_000
BRANCHES = 8
LEAF_ROWS = 256
LEAST_SAMPLE = 8  # sampled vectors of a leaf, which bounds the tree where the sample is a small part of all vectors
ROUNDS = 12  # of k-means
TRIALS = 200
RECALL = 0.97  # of the calibration; the results are held to 0.9
ROUND_ENDS = (4, 32)  # leaves visited by the end of the first rounds
BLOCK = 2048
SHARES = 64  # of the ids of a vector with very many
SPARE = 12  # more than k + 1 are kept of a block before scores are computed as they are returned


@dataclass
class Tree:
    """Nodes in the order in which they were made; node 0 is the root and ``leaf`` numbers the leaves, -1 inside."""

    centroids: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    top: float  # largest norm, after scaling
    power: int  # components are scaled by 2 ** -power

    def points(self, rows: np.ndarray) -> np.ndarray:
        rows = np.ldexp(rows, -self.power)
        return np.hstack([rows, np.sqrt(np.maximum(self.top**2 - (rows * rows).sum(axis=1), 0.0))[:, None]])

    def leaves_of(self, rows: np.ndarray) -> np.ndarray:
        """The leaf of each vector, down the tree by the nearest centroid."""
        points, out = self.points(rows), np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, here = todo.pop()
            kids = self.children[node]
            if not kids:
                out[here] = self.leaf[node]
                continue
            own = _nearest(points[here], self.centroids[kids])
            todo += [(kids[k], here[own == k]) for k in np.unique(own).tolist()]
        return out

    def visits(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """The first ``most`` leaves of each query, best bin first."""
        scaled = np.hstack([np.ldexp(queries, -self.power), np.zeros((len(queries), 1))])
        # a query is as far out as it may be: only differences between distances of one query matter
        away = (self.centroids**2).sum(axis=1) - 2.0 * scaled @ self.centroids.T
        out = []
        for row in away:
            distance, heap, found = row.tolist(), [(0.0, 0)], []
            while heap and len(found) < most:
                _, node = heapq.heappop(heap)
                if self.children[node]:
                    for kid in self.children[node]:
                        heapq.heappush(heap, (distance[kid], kid))
                else:
                    found.append(int(self.leaf[node]))
            out.append(found)
        return out


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids**2).sum(axis=1) - 2.0 * points @ centroids.T, axis=1)


def _means(points: np.ndarray, k: int, rand: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(centroids, the one of each point); fewer than ``k`` where points coincide."""
    centroids = points[rand.choice(len(points), min(k, len(points)), replace=False)]
    for _ in range(ROUNDS):
        own = _nearest(points, centroids)
        used, own = np.unique(own, return_inverse=True)
        sums = np.zeros((len(used), points.shape[1]))
        np.add.at(sums, own, points)
        moved = sums / np.bincount(own)[:, None]
        if moved.shape == centroids.shape and np.allclose(moved, centroids):
            break
        centroids = moved
    used, own = np.unique(_nearest(points, centroids), return_inverse=True)
    return centroids[used], own


def fit(rows: np.ndarray, total: int, top: float, power: int, seed: int = 12) -> Tree:
    """A tree over a sample of ``total`` vectors whose largest norm, scaled, is ``top``."""
    tree = Tree(np.zeros((1, rows.shape[1] + 1)), [[]], np.zeros(1, np.int64), top, power)
    points, rand = tree.points(rows), np.random.default_rng(seed)
    fine = max(LEAST_SAMPLE, int(LEAF_ROWS * len(rows) / max(total, 1)))
    centroids, children, todo = [points.mean(axis=0) if len(points) else np.zeros(rows.shape[1] + 1)], [[]], [(0, np.arange(len(points)))]
    while todo:
        node, members = todo.pop()
        if len(members) <= fine:
            continue
        means, own = _means(points[members], min(BRANCHES, -(-len(members) // fine)), rand)
        if len(means) < 2:
            continue
        for k, mean in enumerate(means):
            children[node].append(len(centroids))
            todo.append((len(centroids), members[own == k]))
            centroids.append(mean)
            children.append([])
    inner = np.array([bool(c) for c in children])
    return Tree(np.array(centroids), children, np.where(inner, -1, np.cumsum(~inner) - 1), top, power)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    sizes = batch.column(column).value_lengths().to_numpy()
    for dim in np.unique(sizes).tolist():
        yield dim, batch if (sizes == dim).all() else batch.filter(pa.array(sizes == dim))


def _placed(trees: Broadcast):
    """The leaf of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                for dim, batch in _by_length(whole.slice(k, 1024), 2):
                    leaves = trees.value[dim].leaves_of(_matrix(batch.column(2), dim)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0), pa.array(np.full(len(leaves), dim, np.int32)), pa.array(leaves), batch.column(1), batch.column(2)],
                        ["cid", "dim", "leaf", "least_id", "v"],
                    )

    return run


def _asked(trees: Broadcast, low: int, high: dict[int, int]):
    """A row for each leaf that a query (cid, bound, v) visits in a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                for dim, batch in _by_length(whole.slice(k, 256), 2):
                    if high[dim] <= low:
                        continue
                    found = [x[low:] for x in trees.value[dim].visits(_matrix(batch.column(2), dim), high[dim])]
                    row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
                    cid, bound, v = (c.take(row) for c in batch.columns)
                    leaves = pa.array(np.concatenate(found).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [cid, pa.array(np.full(len(row), dim, np.int32)), leaves, bound, v], ["cid", "dim", "leaf", "bound", "v"]
                    )

    return run


def _best(
    queries: np.ndarray, bounds: np.ndarray, rows: np.ndarray, least_ids: np.ndarray, most: int
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of the ``most`` best rows of each query, of those that reach its bound; scores are sums in the
    order of the coordinates' pairs, so a pair has one score wherever it is computed."""
    with np.errstate(over="ignore"):
        rounding = 1e-12 * np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((rows * rows).sum(axis=1).max(initial=0.0))
    for k in range(0, len(queries), 256):
        block = queries[k : k + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            rough = block @ rows.T
        least = np.where(bounds[k : k + 256] > -np.inf, bounds[k : k + 256] - rounding[k : k + 256], -np.inf)[:, None]
        if rough.shape[1] > most + SPARE:
            least = np.maximum(least, -np.partition(-rough, most + SPARE - 1, axis=1)[:, most + SPARE - 1 : most + SPARE])
        q, r = np.nonzero(~(rough < least))
        with np.errstate(over="ignore", invalid="ignore"):
            score = (block[q] * rows[r]).sum(axis=1)
        order = np.lexsort((least_ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        kept = (np.arange(len(q)) - np.searchsorted(q, q) < most) & ~(score < bounds[k : k + 256][q])
        yield q[kept] + k, r[kept], score[kept]


def _met(most: int):
    """Groups of a block of a leaf's vectors and a block of its queries to (query, cid, score) of the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, "g"):
            asks = group.column("asks").to_numpy().astype(bool)
            if asks.all() or not asks.any():
                continue
            dim, cid = group.column("dim")[0].as_py(), group.column("cid").to_numpy()
            v, ids = _matrix(group.column("v").combine_chunks(), dim), group.column("least_id").to_numpy()
            bounds = group.column("bound").to_numpy()[asks]
            for q, r, score in _best(v[asks], bounds, v[~asks], ids[~asks], most):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cid[asks][q]), pa.array(cid[~asks][r]), pa.array(ids[~asks][r]), pa.array(score)], ["query", "cid", "least_id", "score"]
                )

    return run


def _tried(trials: Broadcast, most: int):
    """Of all vectors of a task, the best for each calibration query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple]] = {}  # the best so far: (score, -least id, leaf)
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                for dim, batch in _by_length(whole.slice(k, 4096), 4):
                    cids, queries = trials.value.get(dim, ((), None))
                    if not len(cids):
                        continue
                    own, ids, leaves = batch.column(0).to_numpy(), batch.column(3).to_numpy(), batch.column(2).to_numpy()
                    none = np.full(len(queries), -np.inf)
                    for q, r, score in _best(queries, none, _matrix(batch.column(4), dim), ids, most + 1):
                        for a, b, s in zip(q.tolist(), r.tolist(), score.tolist()):
                            if own[b] != cids[a]:
                                held.setdefault((dim, a), []).append((s, -int(ids[b]), int(leaves[b])))
            held = {key: heapq.nlargest(most, rows) for key, rows in held.items()}
        rows = [(*key, *x) for key, found in held.items() for x in found]
        yield pa.RecordBatch.from_pylist(
            [{"dim": d, "trial": a, "score": s, "least_id": -i, "leaf": leaf} for d, a, s, i, leaf in rows],
            pa.schema([("dim", pa.int32()), ("trial", pa.int32()), ("score", pa.float64()), ("least_id", pa.int64()), ("leaf", pa.int32())]),
        )

    return run


def _top(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """The ``most`` best rows of each key; a task's best are taken before rows are moved."""
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "least_id")
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, cid) of the rows that take part; ``v`` keeps the type of its numbers, cid is equal for equal vectors."""
    number = vectors.schema["embedding"].dataType.elementType.simpleString()
    number = number if number in ("float", "double") else "double"
    # a zero has one sign, so that equal vectors are one class
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.transform("embedding", lambda x: x.cast(number) + F.lit(0.0).cast(number)).alias("v")
    )
    return rows.where(
        F.col("vec_id").isNotNull()
        & (F.size("v") > 0)
        & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists("v", lambda x: x != 0)
    ).withColumn("cid", F.xxhash64("v"))


def classes_of(rows: DataFrame, k: int, asks: Column) -> DataFrame:
    """(cid, v, ids, least_id, asks) of each different vector, with the ``k`` + 1 smallest ids that have it.

    A vector with very many ids is cut down in each of many shares of its ids first, then among what these have left."""
    rows = rows.groupBy("cid", "v", "vec_id").agg(F.max(asks).alias("asks")).withColumn("share", F.pmod(F.xxhash64("vec_id"), F.lit(SHARES)))
    few = rows.select("cid", "v", "vec_id", "share")
    for keys in (["cid", "v", "share"], ["cid", "v"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        few = few.withColumn("_k", place).where(F.col("_k") <= k + 1).drop("_k")
    ids = few.groupBy("cid", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asking = rows.where("asks").groupBy("cid", "v").agg(F.lit(True).alias("asks"))
    return ids.join(asking, ["cid", "v"], "left").select(
        "cid", "v", "ids", F.get("ids", F.lit(0)).alias("least_id"), F.coalesce("asks", F.lit(False)).alias("asks")
    )


def _drawn(rows: DataFrame, most: int, total: int, salt: str) -> DataFrame:
    share = min(1.0, most / max(total, 1))
    return rows.where(F.pmod(F.xxhash64("cid", F.lit(salt)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))


def _matrices(rows: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Of each length, (cids, vectors) of a bounded sample, in the order of their cid."""
    got = rows.select("cid", "v").toArrow().combine_chunks()
    out = {}
    for batch in got.to_batches():
        for dim, part in _by_length(batch, 1):
            cids = part.column(0).to_numpy()
            order = np.argsort(cids)
            out[dim] = cids[order], _matrix(part.column(1), dim)[order]
    return out


def calibrated(trees: dict[int, Tree], trials: dict[int, tuple[np.ndarray, np.ndarray]], truth: dict[int, dict[int, list[int]]], recall: float) -> dict[int, int]:
    """Of each length, how many leaves to visit: widened until the true neighbours' leaves are visited to the share asked for."""
    out = {}
    for dim, tree in trees.items():
        leaves, queries = int((tree.leaf >= 0).sum()), trials.get(dim, ((), np.zeros((0, dim))))[1]
        wanted = truth.get(dim, {})
        place = [{leaf: k for k, leaf in enumerate(order)} for order in tree.visits(queries, leaves)]
        ranks = np.sort([place[q][leaf] for q, found in wanted.items() for leaf in found])  # the visit that finds each
        out[dim] = int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1 if len(ranks) else leaves
    return out


def index(classes: DataFrame, sample: int = SAMPLE) -> dict[int, Tree]:
    """A tree for each length of the vectors of ``classes``."""
    size = F.size("v").alias("dim")
    largest = F.max(F.array_max(F.transform("v", F.abs)).cast("double"))
    sizes = {r.dim: (r.n, r.most) for r in classes.groupBy(size).agg(F.count(F.lit(1)).alias("n"), largest.alias("most")).collect()}
    powers = {dim: int(np.frexp(most)[1]) - 1 for dim, (_, most) in sizes.items()}
    scaled = F.transform("v", lambda x: x / F.col("scale"))
    norm = F.sqrt(F.aggregate(scaled, F.lit(0.0), lambda acc, x: acc + x * x))
    scale = F.coalesce(*[F.when(F.size("v") == d, F.lit(2.0**p)) for d, p in powers.items()], F.lit(1.0))
    tops = {r.dim: r.top for r in classes.withColumn("scale", scale).groupBy(size).agg(F.max(norm).alias("top")).collect()}
    drawn = _matrices(_drawn(classes, sample, sum(n for n, _ in sizes.values()), "tree"))
    empty = lambda dim: (None, np.zeros((0, dim)))  # noqa: E731  a length that is not in the sample: one leaf
    return {dim: fit(drawn.get(dim, empty(dim))[1], n, tops[dim], powers[dim]) for dim, (n, _) in sizes.items()}


def _visited(placed: DataFrame, asking: DataFrame, found: DataFrame | None, asked, most: int) -> DataFrame:
    """(query, cid, least_id, score): ``found`` so far and what this round's visits add, the ``most`` best of each query."""
    low = F.lit(float("-inf"))
    asking = asking.withColumn("bound", low)
    if found is not None:
        bounds = found.groupBy(F.col("query").alias("cid")).agg(F.when(F.count(F.lit(1)) >= most, F.min("score")).alias("_bound"))
        asking = asking.join(bounds, "cid", "left").withColumn("bound", F.coalesce("_bound", "bound"))
    kind = asking.schema["v"].dataType.simpleString()
    asks = asking.select("cid", "bound", "v").mapInArrow(asked, f"cid bigint, dim int, leaf int, bound double, v {kind}")
    asks = materialise(asks, "visits")
    blocks = lambda rows, name: rows.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias(name))
    sizes = materialise(blocks(placed, "nv").join(blocks(asks, "nq"), ["dim", "leaf"]), "leaf-sizes")  # a row a leaf, so it is bounded as the tree is

    def dealt(rows: DataFrame, own: tuple[str, str], other: tuple[str, str]) -> DataFrame:
        block = F.pmod(F.xxhash64("cid", F.lit("block")), F.col(own[0])).cast("int").alias(own[1])
        others = F.explode(F.sequence(F.lit(0), F.col(other[0]) - 1)).alias(other[1])
        rows = rows.join(F.broadcast(sizes), ["dim", "leaf"]).select(*rows.columns, block, others)
        return rows.withColumn("g", F.xxhash64("dim", "leaf", "v_block", "q_block"))

    columns = ["cid", "dim", "least_id", "bound", "v", "asks", "g"]
    vectors = dealt(placed, ("nv", "v_block"), ("nq", "q_block")).withColumns({"asks": F.lit(False), "bound": low})
    queries = dealt(asks, ("nq", "q_block"), ("nv", "v_block")).withColumns({"asks": F.lit(True), "least_id": F.lit(0).cast("bigint")})
    met = vectors.select(columns).unionByName(queries.select(columns)).repartition("g").sortWithinPartitions("g")
    got = met.mapInArrow(_met(most), "query bigint, cid bigint, least_id bigint, score double")
    # classes of one score and several ids fill a result with the smallest ids, so as many classes as places are enough
    return materialise(_top(got if found is None else found.unionByName(got), ["query"], most), "found")


def search(vectors: DataFrame, queries: str, k: int = K, recall: float = RECALL, sample: int = SAMPLE, trials: int = TRIALS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row of ``vectors`` (vec_id, embedding) that meets
    the condition ``queries`` on vec_id, nearest first."""
    spark, context = vectors.sparkSession, vectors.sparkSession.sparkContext
    rows = usable(vectors)
    classes = materialise(classes_of(rows, k, F.expr(queries)), "vector-classes")
    kind = classes.schema["v"].dataType.simpleString()
    trees = index(classes, sample)
    if not trees:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shared = context.broadcast(trees)
    placed = classes.select("cid", "least_id", "v").mapInArrow(_placed(shared), f"cid bigint, dim int, leaf int, least_id bigint, v {kind}")
    placed = materialise(placed, "leaves")

    asking = classes.where("asks")
    tests = _matrices(_drawn(asking, trials, asking.count(), "trials"))
    best = placed.mapInArrow(_tried(context.broadcast(tests), k), "dim int, trial int, score double, least_id bigint, leaf int")
    truth: dict[int, dict[int, list[int]]] = {}
    for r in _top(best, ["dim", "trial"], k).collect():  # k rows for each of a bounded number of queries
        truth.setdefault(r.dim, {}).setdefault(r.trial, []).append(r.leaf)
    visits = calibrated(trees, tests, truth, recall)

    found = None
    for low, high in zip((0, *ROUND_ENDS), (*ROUND_ENDS, max(visits.values()))):
        if low < max(visits.values()):
            ends = {dim: min(high, most) for dim, most in visits.items()}
            found = _visited(placed, asking.select("cid", "v"), found, _asked(shared, low, ends), k + 1)
    answers = (
        found.join(classes.select("cid", "ids"), "cid")
        .select("query", "score", "cid", F.explode("ids").alias("vec_id"))
        .groupBy("query")
        .agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "cid"))).alias("best"))
        .select("query", F.slice("best", 1, k + 1).alias("best"))
    )
    answers = materialise(answers, "answers")
    own = rows.where(queries).select(F.col("vec_id").alias("query_id"), F.col("cid").alias("query")).distinct()
    others = F.slice(F.filter("best", lambda b: (b["vec_id"] != F.col("query_id")) | (b["cid"] != F.col("query"))), 1, k)
    return own.join(answers, "query").select("query_id", F.posexplode(others).alias("at", "b")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "b.vec_id", (-F.col("b.less")).alias("score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "vec_id % 20 = 0")
