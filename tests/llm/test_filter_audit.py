import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import filter_audit as a


def fails(text):
    words = (text or "").encode().split()
    text = text or ""
    return (
        len(words) < 200,
        100 * len(set(words)) < 50 * len(words),
        100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        bool(re.search("[#$%&*|]", text)),
    )


def brute(rows, labels):
    """The audit by removing documents one by one, in every order."""
    of = {}
    for doc, quality, toxic in labels:
        good, bad = of.get(doc, (False, False))
        of[doc] = good or quality == 1, bad or toxic == 1
    failed = []
    for doc, text, _ in rows:
        late = doc is not None and any(d is not None and d < doc and (t or "") == (text or "") for d, t, _ in rows)
        failed.append(dict(zip("ABCDE", (*fails(text), late))))
    out, shapley = {}, {}
    for order in map("".join, permutations("ABCDE")):
        for part in {r[2] or "" for r in rows}:
            left, gone = [i for i, r in enumerate(rows) if (r[2] or "") == part], []
            for step, x in enumerate(order, 1):
                removed = [i for i in left if failed[i][x]]
                redundant = sum(failed[i][x] for i in gone)
                left = [i for i in left if not failed[i][x]]
                alone = sum(f[x] and sum(f.values()) == 1 for i, f in enumerate(failed) if (rows[i][2] or "") == part)
                marks = [of.get(rows[i][0], (False, False)) if rows[i][0] is not None else (False, False) for i in removed]
                out[part, order, step] = [len(left), len(removed), redundant, alone, sum(m[0] for m in marks), sum(m[1] for m in marks)]
                shapley[part, x] = shapley.get((part, x), 0) + len(removed)
                gone += removed
    return sorted((*key, *value, shapley[key[0], key[1][key[2] - 1]]) for key, value in out.items())


COLUMNS = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab AB\n\té日\x1c#x𝄞", max_size=40), max_size=6))
def test_counts_in_buffers_equal_plain_ones(texts):
    column = pa.array(["left out", *texts], pa.string()).slice(1)
    data, edges = a.buffers(column)
    words, distinct = a.distinct_words(data, edges)
    assert words.tolist() == [len(t.encode().split()) for t in texts]
    assert distinct.tolist() == [len(set(t.encode().split())) for t in texts]
    assert a.masks(column).tolist() == [sum(f << k for k, f in enumerate(fails(t))) for t in texts]


def test_equal_hashes_are_verified(monkeypatch):
    texts = ["aa bb aa cc", "aa aa", "dd aa dd", "longer-than-eight longer-than-eighs longer-than-eight x"]
    real = a.word_hashes

    def colliding(*args):
        hashes, first, starts = real(*args)
        return hashes % np.uint64(2), first, starts

    for fake in (colliding, lambda *args: (np.zeros_like(real(*args)[0]), *real(*args)[1:])):
        monkeypatch.setattr(a, "word_hashes", fake)
        assert a.distinct_words(*a.buffers(pa.array(texts)))[1].tolist() == [3, 1, 2, 3]
    monkeypatch.setattr(a, "mixed", lambda h: h * np.uint64(0))  # texts collide too
    assert a.distinct_words(*a.buffers(pa.array(texts)))[1].tolist() == [3, 1, 2, 3]


def test_edge_rows_against_brute_force(spark):
    rand = random.Random(13)
    words = [f"w{i}" for i in range(300)] + ["Big", "LOUD", "a#b", "100%", "é"]
    texts = [None, "", " \n", "A", "é" * 33 + "A", "é" * 32 + "A"]
    texts += [" ".join(rand.choice(words[: rand.choice([20, 100, 305])]) for _ in range(rand.choice([5, 199, 200, 350]))) for _ in range(40)]
    rows = [(i * 2, t, rand.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(300 + i, rand.choice(texts[:12]), rand.choice(["en", None])) for i in range(20)]
    rows += [rows[7], rows[7], (None, texts[8], "en"), (None, "new", "fr"), (-5, texts[9], "en"), (7, "", "en")]
    labels = [(r[0], rand.choice([0, 1, None]), rand.choice([0, 1, None])) for r in rows[:50]]
    labels += [(2, 1, 0), (2, 0, 1), (None, 1, 1), (9999, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, mask int, digest string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in a.audit(docs, known).collect())
    assert got == brute(rows, labels)
    assert a.audit(docs.limit(0), known).count() == 0
    assert a.audit(docs, known.limit(0)).where("good_lost + toxic_lost > 0").count() == 0


def test_query_equals_its_sql_and_brute_force(spark, sf):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = sorted(tuple(r[c] for c in COLUMNS) for r in a.query(spark, sf).collect())
    want = con.execute(a.ORACLE_SQL)
    assert [c[0] for c in want.description] == COLUMNS
    assert got == sorted(want.fetchall())
    tables = (con.execute(x).fetchall() for x in ("SELECT doc_id, text, lang FROM documents", "SELECT * FROM labels"))
    assert got == brute(*tables)
