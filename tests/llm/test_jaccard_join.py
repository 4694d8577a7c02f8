import random
from collections import Counter, defaultdict
from math import comb

import numpy as np

from panelforge.llm import jaccard_join as j


def brute(rows):
    """Rows of (doc_id, text) by comparing all: (n_links, component) of each, by position."""
    sets = [set(s.tolist()) for s in j.shingle_sets([t for _, t in rows])]
    places = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            places[x].append(i)
    links, root = [0] * len(rows), list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for k, n in Counter(k for x in s for k in places[x] if k > i).items():
            if n >= 0.8 * (len(s) + len(sets[k]) - n) - 1e-9:
                links[i] += 1
                links[k] += 1
                root[max(top(i), top(k))] = min(top(i), top(k))
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(i)
    least = {t: min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for t, g in groups.items()}
    return [(links[i], least[top(i)]) for i in range(len(rows))]


def near_copies(rand, n, length, edits):
    words = [f"v{i}" for i in range(500)]
    base = [rand.choice(words) for _ in range(length)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rand.randint(0, edits)):
            text[rand.randrange(length)] = rand.choice(words)
        out.append(" ".join(text))
    return out


def test_posterior_bound():
    for k, least in zip(range(j.STEP, j.HASHES + 1, j.STEP), j.least_matches()):
        tail = lambda m: sum(comb(k + 1, i) * 0.8**i * 0.2 ** (k + 1 - i) for i in range(m + 1))
        grid = np.linspace(0.8, 1, 20001)
        beta = lambda m: (k + 1) * comb(k, m) * np.trapezoid(grid**m * (1 - grid) ** (k - m), grid)
        assert abs(tail(least) - beta(least)) < 1e-6
        assert tail(least) >= j.TOLERANCE and (least == 0 or tail(least - 1) < j.TOLERANCE)


def test_edge_rows_and_groups_against_brute_force(spark, monkeypatch):
    rand = random.Random(8)
    texts = near_copies(rand, 60, 120, 6) + near_copies(rand, 30, 60, 3) + near_copies(rand, 10, 400, 30)
    texts += [None, "", "...", "one", "One!", "one two three four", "one two three four", "one two three four five"]
    texts += [texts[0]] * 5 + ["long " * 30000, "a b c d e f g " * 6000]
    rows = [(100 - i, t) for i, t in enumerate(texts)] + [(None, texts[1]), (None, "only here is this text at all"), (7, texts[3]), (7, texts[3])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, cid int")
    want = Counter((r[0], *x) for r, x in zip(rows, brute(rows)))
    wordless = {i for i, s in enumerate(j.shingle_sets(texts)) if not len(s)}
    assert len(wordless) == 3
    for bucket, group in ((4000, 1500), (7, 11)):  # the second cuts every group into blocks
        monkeypatch.setattr(j, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(j, "GROUP_ROWS", group)
        got = j.classes_and_links(docs).collect()
        assert Counter((r.doc_id, r.n_links, r.component_id) for r in got) == want
    kept = j.keep_one(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} >= {100 - i for i in wordless}
    assert j.classes_and_links(docs.limit(0)).count() == 0


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_links, r.component_id) for r in j.query(spark, sf).collect()}
    assert got == {r[0]: x for r, x in zip(rows, brute(rows))}


def test_words_of_any_script(spark):
    texts = ["one—two “three” four\u3000five six", "ONE two three. four five: six", "光合作用的主要产物是氧气", "光合作用的主要产物是氧气。", "क्षत्रिय और वैश्य"]
    sets = j.shingle_sets(texts)
    assert [len(s) for s in sets] == [2, 2, 8, 8, 1]
    assert set(sets[0].tolist()) == set(sets[1].tolist()) and set(sets[2].tolist()) == set(sets[3].tolist())


def test_repeated_and_missing_ids_stay(spark):
    text = "a text that has more than five words in all"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (3, None), (3, None)]
    kept = j.keep_one(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 1, 3, 3]


def test_band_mates_are_those_that_share_a_band():
    rand = np.random.default_rng(3)
    sigs = rand.integers(0, 3, (60, j.HASHES)).astype(np.uint16)
    mates, bands = j.BandMates(sigs), np.ascontiguousarray(sigs).view(np.int64)
    for i in range(60):
        assert mates.of(i).tolist() == [k for k in range(60) if (bands[k] == bands[i]).any()]
