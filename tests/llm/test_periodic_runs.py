import hashlib
import random
import zlib

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import periodic_runs as p


def brute(words, exponent=4, shortest=6):
    """Runs by trying every period and every stretch of words that far apart and equal."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            length = i - start + q
            if length >= max(shortest, exponent * q):
                found.setdefault((start, length), q)
    return sorted((s, length, q) for (s, length), q in found.items())


def collapsed(words, found):
    return " ".join(w for i, w in enumerate(words) if not any(s + q <= i < s + n for s, n, q in found))


def earlier(words, start, length):
    return any(words[j : j + length] == words[start : start + length] for j in range(start))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=40))
def test_factors_are_the_longest_earlier_stretches(words):
    at = 0
    for start, length, source in p.factors(words):
        assert start == at
        at += length
        if source is None:
            assert length == 1 and not earlier(words, start, 1)
        else:
            assert source < start and words[source : source + length] == words[start:at]
            assert at == len(words) or not earlier(words, start, length + 1)
    assert at == len(words)


pieces = st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 7), st.integers(0, 4))
texts = st.lists(pieces, max_size=6).map(lambda x: [w for word, times, more in x for w in (word * (times + 1))[: len(word) * times + more]])


@settings(max_examples=1500, deadline=None)
@given(texts, st.sampled_from([(4, 6), (4, 1), (2, 1), (3, 4)]))
def test_runs_equal_brute_force(words, least):
    assert p.runs(words, *least) == brute(words, *least)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=60))
def test_runs_of_two_words_equal_brute_force(words):
    assert p.runs(words, 2, 1) == brute(words, 2, 1)
    assert p.runs(words) == brute(words)


def test_copied_runs_at_the_ends_of_factors():
    one = [0, 1] * 5
    for words in ([*one, 7, *one, 8, *one], [7, *one, 8, 7, *one, 9, *one], [*one, 2, *one, 2, *one, 2, *one, 2, *one], [5] * 40, [*[5] * 9, 6] * 6):
        assert p.runs(words) == brute(words)


def many(rand):
    vocabulary = [f"w{i}" for i in range(60)] + ["é", "日本"]
    draw = lambda n: [rand.choice(vocabulary) for _ in range(n)]
    rows = [(1, None), (2, ""), (3, " \t\n\r "), (4, "a\x0ba\x0ca a a\x1fa a"), (5, "x " * 5), (6, "x " * 6), (7, "x " * 3000), (None, "y " * 9)]
    for i in range(60):
        words = []
        for _ in range(rand.randint(1, 6)):
            part = draw(rand.randint(1, 30))
            words += part * rand.randint(1, 7) + part[: rand.randint(0, len(part))] + draw(rand.randint(0, 20))
        rows.append((100 + i, rand.choice([" ", "\n", "  ", "\x1c ", "  "]).join(words)))
    return rows + rows[10:13]


def test_edge_rows_against_brute_force(spark):
    rows = many(random.Random(11))
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, runs int, collapsed int")
    for least in ((4, 6), (3, 5)):
        want = []
        for doc, text in rows:
            words = [w.decode() for w in (text or "").encode().split()]
            found = brute(words, *least)
            want.append((doc, len(words), [tuple(x) for x in found], collapsed(words, found)))
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in p.find_runs(docs, exponent=least[0], shortest=least[1]).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert p.find_runs(docs.limit(0)).count() == 0


def test_query_equals_brute_force_and_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = []
    for doc, text in con.execute("SELECT doc_id, text FROM documents").fetchall():
        words = [w.decode() for w in (text or "").encode().split()]
        h, n = zlib.crc32(str(doc).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            step = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % step] if i >= a else w for i, w in enumerate(words)]
        found = brute(words)
        top = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in sorted(found, key=lambda r: (r[0], r[2])))
        tail = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (listed, collapsed(words, found))]
        want.append((doc, len(found), *tail, *digests))
    got = sorted(map(tuple, p.query(spark, sf).collect()))
    assert got == sorted(want)
    assert sum(r[1] > 0 for r in got) >= 10
    assert got == sorted(con.execute(p.ORACLE_SQL).fetchall())
