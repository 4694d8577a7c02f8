import math

import numpy as np
import pytest

from panelforge.llm import vector_search as v


def usable(x):
    return x and all(c is not None and math.isfinite(c) for c in x) and any(x)


def brute(rows, k=20, kind=np.float64):
    """{(query row's id, vector): [(vec_id, score)]}, by comparing each query with all."""
    rows = sorted({(i, tuple(np.array(x, kind).astype(float).tolist())) for i, x in rows if i is not None and usable(x)})
    out = {}
    for i, x in rows:
        if i % 20 == 0:
            with np.errstate(over="ignore", invalid="ignore"):
                scores = [((np.array(x) * np.array(y)).sum(), j) for j, y in rows if len(x) == len(y) and (j, y) != (i, x)]
            out.setdefault(i, []).append([(j, s) for s, j in sorted(scores, key=lambda p: (-p[0], p[1]))[:k]])
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        assert r["rank"] == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.vec_id, r.score))
    return out


ASKS = "vec_id % 20 = 0"


def clustered(rand, n, dim=16):
    centers = rand.normal(size=(12, dim))
    return [(centers[k % 12] * (1 + k % 3) + rand.normal(size=dim) * 0.4).tolist() for k in range(n)]


def test_edge_rows_against_brute_force(spark, monkeypatch):
    rand = np.random.default_rng(1)
    vectors = clustered(rand, 500)
    rows = list(enumerate(vectors))
    x = vectors[0]
    bad = [None, [], [0.0] * 16, [float("nan"), *x[1:]], [float("inf"), *x[1:]], [None, *x[1:]]]
    rows += [(1000 + 20 * i, b) for i, b in enumerate(bad)] + [(1001, x), (1003, [-0.0 if c == 0 else c for c in x]), (None, x)]
    rows += [(2000 + i, vectors[7]) for i in range(70)]  # a class of more ids than a result holds
    rows += [rows[3], rows[20], rows[20], (3000, [1.0, 2.0]), (3001, [2.0, 1.0]), (3020, [3.0]), (4000, [1.0, 0.0, 0.0]), (4001, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, cid int, leaf string")
    want = {i: lists[0] for i, lists in brute(rows).items() if lists[0]}
    assert 3020 not in want and len(want[3000]) == 1
    for leaf, block in ((256, 2048), (20, 8)):
        monkeypatch.setattr(v, "LEAF_ROWS", leaf)
        monkeypatch.setattr(v, "BLOCK", block)
        got = found(v.search(df, ASKS, recall=1.0))  # calibrated on all queries, so all are found
        assert {i: [j for j, _ in r] for i, r in got.items()} == {i: [j for j, _ in r] for i, r in want.items()}
        assert all(a[1] == b[1] for i in want for a, b in zip(got[i], want[i]))
    empty = v.search(df.limit(0), ASKS)
    assert empty.count() == 0 and empty.columns == ["query_id", "rank", "vec_id", "score"]


def test_one_id_with_two_vectors_and_ties(spark):
    unit = np.eye(30)
    rows = [(20, unit[0].tolist()), (20, unit[1].tolist())] + [(100 - i, unit[i].tolist()) for i in range(2, 30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = v.search(df, ASKS).collect()
    assert len(got) == 3 * 20  # two vectors of 20, one of 80
    tied = sorted([20, 20, *range(71, 99)])
    assert sorted(r.vec_id for r in got if r.query_id == 80) == sorted([x for x in tied if x != 80][:20])
    assert sorted(r.vec_id for r in got if r.query_id == 20) == sorted([x for x in tied][1:21] * 2)


@pytest.mark.parametrize("scale", [1e150, 1e-150, 1e300])
def test_norms_of_any_size(spark, scale):
    rows = [(i, [c * scale for c in x]) for i, x in enumerate(clustered(np.random.default_rng(3), 200, 8))]
    got = found(v.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ASKS, recall=1.0))
    want = brute(rows)
    if scale < 1e200:
        assert got == {i: lists[0] for i, lists in want.items()}
    else:
        assert {i: len(r) for i, r in got.items()} == {i: len(lists[0]) for i, lists in want.items()}


def test_tree_places_and_visits_every_leaf():
    rand = np.random.default_rng(5)
    rows = rand.normal(size=(3000, 16)) * rand.random((3000, 1))
    tree = v.fit(rows, 30_000, float(np.sqrt((np.ldexp(rows, -2) ** 2).sum(axis=1).max())), 2)
    leaves = int((tree.leaf >= 0).sum())
    assert leaves > 50 and set(tree.leaves_of(rows).tolist()) == set(range(leaves))
    orders = tree.visits(rows[:50], leaves)
    assert all(sorted(o) == list(range(leaves)) for o in orders)
    assert [o[:5] for o in orders] == tree.visits(rows[:50], 5)
    points = tree.points(rows)
    # the nearest of the points with the added coordinate is the one with the largest inner product
    ask = np.hstack([np.ldexp(rows[:50], -2), np.zeros((50, 1))])
    away = ((ask[:, None] - points[None]) ** 2).sum(axis=2)
    assert (away.argmin(axis=1) == (rows[:50] @ rows.T).argmax(axis=1)).all()
    assert (np.array([o[0] for o in orders]) == tree.leaves_of(rows[:50])).mean() < 1  # queries are not points


def recall(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = found(v.search(df, ASKS, **more)), brute(rows, kind=np.float32)
    assert {i: len(r) for i, r in got.items()} == {i: len(x[0]) for i, x in want.items()}
    return np.mean([len({j for j, _ in got[i]} & {j for j, _ in x[0]}) / len(x[0]) for i, x in want.items()])


def test_recall_where_leaves_are_left_out(spark, monkeypatch):
    monkeypatch.setattr(v, "LEAF_ROWS", 20)
    chosen = []
    real = v.calibrated
    monkeypatch.setattr(v, "calibrated", lambda trees, *a: chosen.append((real(trees, *a), {d: int((t.leaf >= 0).sum()) for d, t in trees.items()})) or chosen[-1][0])
    rand = np.random.default_rng(8)
    assert recall(spark, list(enumerate(clustered(rand, 2000)))) >= 0.9
    assert recall(spark, list(enumerate(rand.normal(size=(2000, 16)).tolist())), sample=500) >= 0.9  # fitted on a part
    assert chosen[0][0][16] < chosen[0][1][16] / 2 and chosen[1][0][16] < chosen[1][1][16]  # clusters, and none


def test_query_against_brute_force(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got, want = found(v.query(spark, sf)), brute(rows, kind=np.float32)
    assert got.keys() == want.keys()
    hits = [len({j for j, _ in got[i]} & {j for j, _ in x[0]}) / 20 for i, x in want.items()]
    assert np.mean(hits) >= 0.9
    scores = {(i, j): s for i, x in want.items() for j, s in x[0]}
    assert all(s == scores.get((i, j), s) for i, r in got.items() for j, s in r)
