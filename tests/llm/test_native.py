"""Chat formatting, URL filters and line dedup: hand-made cases, and the SQL oracles on a small table."""

import duckdb
import pytest

from panelforge.llm import chat_format, line_templates, url_filter


def sql_rows(sf, sql, names):
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    got = con.execute(sql)
    columns = [c[0] for c in got.description]
    return columns, sorted(got.fetchall(), key=str)


@pytest.mark.parametrize(
    ("module", "names"),
    [(chat_format, ["conversations"]), (url_filter, ["pages"]), (line_templates, ["documents"])],
)
def test_query_equals_its_sql(spark, sf, module, names):
    df = module.query(spark, sf)
    columns, want = sql_rows(sf, module.ORACLE_SQL, names)
    assert df.columns == columns
    assert sorted((tuple(r) for r in df.collect()), key=str) == want
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def turns(*rows):
    return [(c, t, r, x, "extra") for c, t, r, x in rows]


def test_common_prefix_and_spans(spark):
    rows = turns(
        (0, 0, "user", "Hi"), (0, 1, "assistant", "Hello"), (0, 2, "user", "Why?"), (0, 3, "assistant", "So."), (0, 4, "user", "ok"),
        (1, 0, "user", "x"), (1, 1, "assistant", "Other"),
        (2, 0, None, None), (2, 1, "assistant", None), (2, 1, "assistant", None),
        (3, 0, "assistant", "y"),
        (4, 0, "user", "alone"), (5, 0, "user", "alone"),
        (None, 0, "user", "lost"),
    )
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat_format.format_pairs(chat_format.pairs_of(df)).collect()}
    assert sorted(got) == [0, 1]
    first = got[0]
    assert first.n_common == 3
    assert first.prompt == (
        "<|im_start|>user\nHi<|im_end|>\n<|im_start|>assistant\nHello<|im_end|>\n<|im_start|>user\nWhy?<|im_end|>\n"
    )
    assert first.chosen_text == "<|im_start|>assistant\nSo.<|im_end|>\n<|im_start|>user\nok<|im_end|>\n"
    assert [first.chosen_text[s.start : s.stop] for s in first.chosen_spans] == ["So.<|im_end|>\n"]
    assert [first.rejected_text[s.start : s.stop] for s in first.rejected_spans] == ["Other<|im_end|>\n"]
    assert got[1].n_common == 1 and got[1].prompt == "<|im_start|>user\n<|im_end|>\n"
    assert chat_format.format_pairs(chat_format.pairs_of(df.limit(0))).count() == 0


def test_equal_conversations_leave_empty_completions(spark):
    ddl = "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    same = [("user", "a"), ("assistant", "b")]
    df = spark.createDataFrame([(same, same), ([], []), (same, same[:1])], ddl)
    got = chat_format.format_pairs(df).collect()
    assert [(r.n_common, r.chosen_text, r.rejected_text) for r in got[:2]] == [(2, "", ""), (0, "", "")]
    assert got[2].n_common == 1 and got[2].rejected_text == "" and len(got[2].chosen_spans) == 1


def test_as_of_join(spark):
    changes = spark.createDataFrame(
        [
            ("Bad.org", "spam", "block", "add", "2024-01-10"), ("bad.org", "spam", "block", "remove", "2024-02-01"),
            ("bad.org", "spam", "block", "add", "2024-03-01"), ("ok.bad.org", "review", "allow", "add", "2024-01-01"),
            ("twice.org", "a", "block", "add", "2024-01-01"), ("twice.org", "b", "block", "add", "2024-01-01"),
            ("same.org", "x", "block", "add", "2024-01-05"), ("same.org", "x", "block", "remove", "2024-01-05"),
            (None, "x", "block", "add", "2024-01-05"), ("null.org", "x", "block", "add", None),
        ],
        url_filter.DDL,
    )
    cases = [
        ("http://bad.org/x", "2024-01-09", "none"), ("http://bad.org/x", "2024-01-10", "block"),
        ("https://u:p@WWW.bad.org.:8080?q", "2024-01-31", "block"), ("http://bad.org", "2024-02-01", "none"),
        ("http://bad.org", "2030-01-01", "block"), ("http://a.ok.bad.org/", "2024-03-05", "allow"),
        ("http://notbad.org/", "2024-03-05", "none"), ("http://twice.org/", "2024-03-05", "block"),
        ("http://same.org/", "2024-03-05", "none"), ("no url", "2024-03-05", "none"), (None, "2024-03-05", "none"),
        ("http://bad.org/x", None, "none"), ("http://bad.org/x", "2024-01-10", "block"),
    ]
    captures = spark.createDataFrame([(*c, i) for i, c in enumerate(cases)], "url string, fetched_on string, pattern string, n int")
    got = {r.n: r for r in url_filter.judge(captures, changes).collect()}
    assert len(got) == len(cases)
    assert {i: r.decision for i, r in got.items()} == {i: c[2] for i, c in enumerate(cases)}
    assert got[7].category == "a" and got[2].host == "www.bad.org"
    assert url_filter.judge(captures.limit(0), changes).count() == 0
    assert url_filter.judge(captures, changes.limit(0)).where("decision <> 'none'").count() == 0


def test_a_line_of_two_texts_is_recurring(spark):
    long = " ".join(f"word{'abcdefghij'[i % 10] * (1 + i // 10)}" for i in range(60))
    rows = [(1, f"first own words\n{long}"), (2, f"quite other\n{long}\nand an end"), (3, "nothing is shared"), (4, f"first own words\n{long}")]
    got = {r.doc_id: r.text for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "quite other\nand an end", 3: rows[2][1], 4: "first own words"}


def test_recurring_templates_are_dropped_but_from_the_first_document(spark):
    rows = [(i, f"own words of text number {'abcdefghij'[i]}\nLicensed to user{i} under terms of {2000 + i} now\n\nend{'x' * i} of it", "k") for i in range(10)]
    rows += [(20, rows[3][1], "copy"), (20, rows[3][1], "copy"), (30, None, "n"), (31, "", "n"), (None, "Licensed to user77 under terms of 1 now", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, dropped string")
    got = line_templates.drop_lines(docs, min_docs=5)
    assert got.columns == ["doc_id", "text", "dropped", "_lines", "_dropped"]
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert by[0].text == rows[0][1] and "Licensed" not in by[5].text and by[5].text.count("\n") == 1
    assert by[5].text == "\nendxxxxx of it"  # its first line shares the leaf's template, but for the last token
    assert by[None].text == "" and by[None]._dropped == 1
    assert by[30].text is None and by[31].text == ""
    assert line_templates.drop_lines(docs.limit(0)).count() == 0
    assert line_templates.drop_lines(docs, min_docs=50).where("_dropped > 0").count() == 0


def test_a_leaf_of_several_templates(spark):
    names = [a + b for a in "abcdefgh" for b in "klmnopqr"]
    ends = ["wrote this on Monday", "has sent a photo", "left our group today"]
    rows = [(i, f"text {name} has its words\nPosted by user {name} {ends[i % 3 if i < 45 else 0]}") for i, name in enumerate(names)]
    rows += [(100, "once\nPosted by user someone quite other words here"), (101, "twice\nPosted by user nobody in these few lines")]
    docs = spark.createDataFrame([(i, r.replace("text ", f"text{'x' * (i % 7)} own ")) for i, r in rows], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_templates.drop_lines(docs).collect()}
    kept = {i for i, text in got.items() if "Posted" in text}
    assert kept == {0, 1, 2, 100, 101}


def test_two_lines_that_share_less_than_a_template_stay(spark):
    rows = [(1, "we all know a b c d e f"), (2, "we all know g h i d j k"), (3, "they went by a b c d e f"), (4, "they went by a b c d z f")]
    got = {r.doc_id: r.text for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: rows[2][1], 4: ""}


def test_lines_kept_do_not_depend_on_the_bits_that_are_broadcast(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = []
    for words in (1, 7, line_templates.WORDS):
        monkeypatch.setattr(line_templates, "WORDS", words)
        got.append(sorted(map(tuple, line_templates.dropped_lines(docs).selectExpr("doc", "content", "sort_array(dropped)").collect())))
    assert got[0] and got[0] == got[1] == got[2]


def test_rows_of_numbers_are_no_template(spark):
    rows = [(1, "a table of ours\n17\n1 2\n1 2 3 4"), (2, "other figures\n2024\n33 4.5\n1 2 3 5"), (3, "the last one of all\n99\n7 9\n1 2 3 4\n17")]
    rows += [(4, "x1 y2 z3 is it\npage 3 of 9"), (5, "x4 y5 z6 fell down\npage 7 of 8")]
    got = {r.doc_id: r.text for r in line_templates.drop_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: "the last one of all\n99\n7 9", 4: rows[3][1], 5: "x4 y5 z6 fell down"}


def test_callers_columns_with_clashing_names(spark):
    docs = spark.createDataFrame(
        [(1, "own words here\nshared line of five words", 1, 2, 3, 4), (2, "others\nshared line of five words", 5, 6, 7, 8)],
        "doc_id long, text string, _lines int, _doc int, dropped int, content int",
    )
    got = line_templates.keep_new_lines(spark, docs, "").orderBy("doc_id").collect()
    assert [tuple(r)[2:] for r in got] == [(1, 2, 3, 4), (5, 6, 7, 8)] and got[1].text == "others"
    pairs = spark.createDataFrame(
        [([("user", "a")], [("user", "b")], "kept", 5, "old")],
        "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, a string, _prefix int, prompt string",
    )
    row = chat_format.format_pairs(pairs).first()
    assert (row.a, row._prefix, row.prompt) == ("kept", 5, "")
    captures = spark.createDataFrame([("http://x.org/", "2024-01-01", 1, "d")], "url string, fetched_on string, _on int, day string")
    row = url_filter.judge(captures, spark.createDataFrame(url_filter.CHANGES, url_filter.DDL)).first()
    assert (row._on, row.day, row.host) == (1, "d", "x.org")


def test_nulls_inside_given_conversations(spark):
    ddl = "chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>"
    rows = [([("user", "q"), ("assistant", None), (None, "x"), ("assistant", "end")], [("user", "q")]), (None, [("assistant", "b")]), ([None], None)]
    got = chat_format.format_pairs(spark.createDataFrame(rows, ddl)).collect()
    first = got[0]
    assert first.n_common == 1
    assert first.chosen_text == (
        "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user\nx<|im_end|>\n<|im_start|>assistant\nend<|im_end|>\n"
    )
    assert [first.chosen_text[s.start : s.stop] for s in first.chosen_spans] == ["<|im_end|>\n", "end<|im_end|>\n"]
    assert (got[1].prompt, got[1].chosen_text, got[1].chosen_spans) == ("", "", [])
    assert (got[2].chosen_text, got[2].rejected_text) == ("<|im_start|>user\n<|im_end|>\n", "")


def test_leaves_are_made_once_a_line(spark):
    """No filter makes a leaf before the one that is used; blanks of any kind part tokens, other spaces do not."""
    import duckdb

    texts = ["\t a  b\r\rc 1 \n\n \r\n7 \t 8\nx  9\u0085\n \n5 ", "a b c 2\n7 8\nx  3\u0085\n ", "7  9\n  \na\tb c 44\n5 \t", "a b c d", "", " ", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = line_templates._lines(docs)
    plan = line_templates._perhaps_of(lines, lines.select("leaf"))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Filter" in line and "xxhash64" in line]
    got = {r.doc_id: (r._lines, r._dropped) for r in line_templates.drop_lines(docs).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    want = {i: (n, gone) for i, n, gone, _ in con.execute(line_templates.ORACLE_SQL).fetchall()}
    assert got == want and sum(gone for _, gone in want.values()) > 3
