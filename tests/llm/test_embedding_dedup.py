import math

import duckdb
import numpy as np

from panelforge.llm import components as c
from panelforge.llm import embedding_dedup as e


def brute(rows):
    good = lambda v, lab: lab is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, v, lab) in enumerate(rows):
        for k in range(i):
            w, other = rows[k][1], rows[k][2]
            if good(v, lab) and good(w, other) and lab == other and len(v) == len(w):
                x, y = (np.array(np.float32(z), np.float64) for z in (v, w))
                if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                    links[i] += 1
                    links[k] += 1
                    root[max(top(i), top(k))] = min(top(i), top(k))
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return [(r[0], links[i], least.get(top(i))) for i, r in enumerate(rows)]


def test_edge_rows_and_groups_against_brute_force(spark, monkeypatch):
    rand = np.random.default_rng(6)
    rows = []
    for g in range(12):
        center = rand.normal(size=64)
        for _ in range(25):
            rows.append((len(rows), [float(x) for x in center + rand.normal(size=64) * 0.12 * rand.random()], g % 3))
    v = rows[0][1]
    bad = [None, [], [0.0] * 64, [float("nan"), *v[1:]], [float("inf"), *v[1:]], [None, *v[1:]]]
    rows += [(1000 + i, b, 0) for i, b in enumerate(bad)]
    rows += [(2000, v, 0), (2001, [3 * x for x in v], 0), (2002, v, None), (2003, v, 5), (0, v, 0), (None, v, 0)]
    rows += [(3000, [1.0, 0.0], 0), (3001, [1.0, 0.05], 0), (3002, [1.0], 0), (3003, [2.0], 0), (3004, [-2.0], 0)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, cid string")
    want = sorted(brute(rows), key=str)
    for cell, group in ((256, 4000), (1, 4000), (3, 9)):  # one cell; many cells; many cells, cut into blocks
        monkeypatch.setattr(e, "CELL_ROWS", cell)
        monkeypatch.setattr(e, "GROUP_ROWS", group)
        got = e.near_duplicates(df).collect()
        assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == want
    assert e.near_duplicates(df.limit(0)).count() == 0


def test_labels_of_any_type_and_extreme_norms(spark):
    v = [0.3, -0.2, 0.9, 0.1]
    rows = [(1, v, "a"), (2, [x * 1e200 for x in v], "a"), (3, [x * 1e-200 for x in v], "a"), (4, v, "b"), (5, [0.3, -0.2, 0.9, 0.11], "a")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in e.near_duplicates(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (0, 4), 5: (3, 1)}


def test_cells_lose_no_pair_and_leave_most_out():
    rand = np.random.default_rng(12)
    unit = rand.normal(size=(4000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    part, share = unit[:, :8], 0.04 / 8
    edges = np.quantile(part, np.arange(1, 8) / 8, axis=0).T
    for halvings in (0, 5, 8, 12):
        rows, code, home = e.cells(part, edges, e.splits(8, halvings), share)
        assert sorted(rows[home].tolist()) == list(range(len(part)))
        own = np.empty(len(part), np.int64)
        own[rows[home]] = code[home]
        asked = set(zip(rows.tolist(), code.tolist()))
        d = (part[:600, None] - part[None]) ** 2
        i, j = np.nonzero(d.sum(axis=2) <= share)
        assert all((a, own[b]) in asked for a, b in zip(i.tolist(), j.tolist()))
    homes = np.bincount(own, minlength=1 << 12)
    assert homes[code].sum() < 0.03 * len(part) ** 2


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(map(tuple, e.query(spark, sf).collect())) == sorted(con.execute(e.ORACLE_SQL).fetchall())


def test_components(spark):
    rand = np.random.default_rng(9)
    pairs = [(int(a), int(b)) for a, b in rand.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    pairs += [(2000, 2000 + i) for i in range(1, 50)] + [(None, 3), (5, None), (7, 7)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in c.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: top(x) for x in list(root)}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0
