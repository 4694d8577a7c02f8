import hashlib
import random

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from panelforge.llm import substring_dedup as s


def brute(rows):
    """Rows of (doc_id, text) by comparing all windows: (n_words, n_removed, digest) of each."""
    words = [(t or "").encode().split() for _, t in rows]
    first: dict[tuple, int] = {}
    for (doc, _), ws in zip(rows, words):
        for i in range(len(ws) - 49):
            if doc is not None:
                key = tuple(ws[i : i + 50])
                first[key] = min(first.get(key, doc), doc)
    out = []
    for (doc, _), ws in zip(rows, words):
        gone = {
            j for i in range(len(ws) - 49) if doc is not None and first[tuple(ws[i : i + 50])] < doc for j in range(i, i + 50)
        }
        kept = b" ".join(w for i, w in enumerate(ws) if i not in gone)
        out.append((len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab", min_size=1, max_size=25), min_size=1, max_size=5), st.text(alphabet="ab", max_size=30))
def test_automaton_finds_the_first_owner_of_every_window(texts, query):
    automaton, width = s.SuffixAutomaton(), 3
    for i, text in enumerate(texts):
        automaton.add([c.encode() for c in text], i)
    want = [
        next((i for i, t in enumerate(texts) if query[p : p + width] in t), None) for p in range(max(0, len(query) - width + 1))
    ]
    assert automaton.first_owners([c.encode() for c in query], width) == want


def test_edge_rows_against_brute_force(spark, monkeypatch):
    rand = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    draw = lambda n: [rand.choice(words) for _ in range(n)]
    passage, line = draw(70), draw(20)
    rows = [(5, None), (6, ""), (7, " \t\n\r "), (8, "x\x0by\x0cz\x1fq r")]
    for i in range(20):
        text = draw(rand.randint(0, 120))
        at = rand.randint(0, len(text))
        text[at:at] = passage[rand.randint(0, 10) : 70 - rand.randint(0, 10)] if i % 2 else line
        rows.append((10 + i, rand.choice([" ", "\n", "  "]).join(text)))
    rows += [rows[5], rows[5], (3, rows[7][1]), (99, rows[7][1]), (None, rows[7][1]), (50, "same " * 300), (51, "same " * 300)]
    rows += [(60, " ".join(passage[:50])), (61, " ".join(passage[:49]))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, words int")
    for shard in (512, 3):  # the second cuts the passage's anchors into pairs of shards
        monkeypatch.setattr(s, "SHARD_TEXTS", shard)
        got = sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in s.remove_repeats(docs).collect()), key=str)
        assert got == sorted(((d, *x) for (d, _), x in zip(rows, brute(rows))), key=str)
    assert s.remove_repeats(docs.limit(0)).count() == 0


def test_query_equals_its_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = s.query(spark, sf)
    assert sorted(map(tuple, df.collect())) == sorted(con.execute(s.ORACLE_SQL).fetchall())
