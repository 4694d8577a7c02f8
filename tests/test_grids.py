"""Printed layouts: small pages whose rows are known."""

from panelforge.operators import grids, pictures


def words(spark, *lines, page=0):
    """Words (text, x) of lines (top, words) of one page."""
    rows = [("d", p, text, float(x), float(x + 4 * len(text)), float(top)) for p, top, line in ((x if len(x) == 3 else (page, *x)) for x in lines) for text, x in line]
    return spark.createDataFrame(rows, "doc string, page int, text string, x0 double, x1 double, top double")


def test_rolling_matrix_renames_what_was_read(spark):
    head = (0, 50, [("Skole", 40), ("Nivå", 170), ("Programområde", 200), ("2020", 360), ("2021", 440)])
    page = words(
        spark, head,
        (0, 100, [("Nord", 40), ("1", 172), ("Idrettsfag", 202), ("40,5", 360), ("Ledige", 440), ("plasser", 465)]),
        (0, 112, [("videregående", 40)]),
        (0, 124, [("Elektrofag", 202), ("fortrinn", 362)]),
        (0, 136, [("skole", 40)]),
        (1, 100, [("2", 172), ("Naturbruk", 202), ("12,0", 442)]),  # the next page has no header
        (1, 112, [("Nord", 40), ("Idrettsfag", 202), ("39,0", 440)]),  # cut off: the only longer name is meant
    )
    got = sorted((r.school, r.program, r.level, r.year, r.status, r.points) for r in grids.rolling_matrix(page).collect())
    full = "Nord videregående skole"
    assert got == [
        (full, "Elektrofag", "Vg1", 2020, "F", None), (full, "Idrettsfag", "Vg1", 2020, "points", 40.5), (full, "Idrettsfag", "Vg1", 2021, "open", None),
        (full, "Idrettsfag", "Vg2", 2021, "points", 39.0), (full, "Naturbruk", "Vg2", 2021, "points", 12.0),
    ]
    assert grids.rolling_matrix(page.limit(0)).count() == 0


def test_list_takes_the_value_from_the_right(spark):
    page = words(
        spark,
        (40, [("Skule", 40), ("Programområde", 200), ("Nivå", 400), ("Nedre", 423)]),
        (60, [("Vg2", 40)]),
        (72, [("Nord", 40), ("Idrettsfag", 200), ("3", 404), ("38,5", 415)]),
        (84, [("Nord", 40), ("Naturbruk", 200), ("Ingen", 410), ("ventelis", 430)]),
        (96, [("Nord", 40), ("Idrettsfag", 200), ("3", 404), ("39,0", 415)]),
    )
    got = sorted((r.layout, r.school, r.program, r.level, r.status, r.points) for r in grids.listed_thresholds(page).collect())
    assert got == [("level", "Nord", "Idrettsfag", "Vg3", "points", 39.0), ("level", "Nord", "Naturbruk", "Vg2", "open", None)]


def test_words_at_two_tolerances(spark):
    glyphs = [("d", 0, c, x, x + 4.0, 10.0, 0) for c, x in zip("12ab", (0.0, 4.0, 10.0, 14.0))]
    frame = spark.createDataFrame(glyphs, "doc string, page int, text string, x0 double, x1 double, top double, line int")
    got = sorted((r.attempt, r.text) for r in grids.words_at(frame, (3.0, 1.5)).collect())
    assert got == [(0, "12ab"), (1, "12"), (1, "ab")]


def test_pictures_of_a_page(spark):
    html = """<head><meta property='og:image' content="/a/skolen.jpg?x=1&amp;y=2"></head><!-- <img src="/fasade.jpg"> --><img src=data:x>
      <img src="/logo.png"><IMG alt='x > y' data-src="bygg.jpg"><img src="/a/skolen.jpg?x=1&amp;y=2"><img src="//c.org/k.svg"><img>"""
    rows = [(1, "https://a.org/om/oss?b", html, ["bygg"]), (2, "https://a.org", None, ["x"]), (3, "https://a.org", "<p>none</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, tokens array<string>")
    got = [tuple(r) for r in pictures.picture_candidates(pages, "page_id").orderBy("place").collect()]
    assert [x[:4] for x in got] == [(1, 1, "https://a.org/a/skolen.jpg?x=1&y=2", "og:image"), (1, 2, "https://a.org/om/bygg.jpg", "img")]
    assert got[1][5] == "x > y"


def test_list_blocks_go_on_over_pages_and_texts_are_understood_once(spark, monkeypatch):
    """Through a document's window go its pages and not its lines; a text that many lines end with is classified once."""
    head = [("Skule", 40), ("Programområde", 200), ("Nedre", 423)]
    line = lambda n, p, v: [(n, 40), (p, 200), (v, 415)]
    page = words(
        spark, (1, 40, head), (1, 52, line("Nord", "Idrettsfag", "31,0")), (1, 64, [("Vg2", 40)]), (1, 76, line("Nord", "Idrettsfag", "32,0")), (1, 88, [("Vg3", 40)]),
        (2, 52, line("Nord", "Idrettsfag", "33,0")), (4, 52, line("Sør", "Idrettsfag", "33,0")), (4, 64, [("vg 2", 40)]), (4, 76, line("Sør", "Idrettsfag", "Ledige")),
        (0, 52, line("Øst", "Idrettsfag", "30,0")), *[(5, 52 + 12 * i, line(f"S{i}", "Naturbruk", "33,0")) for i in range(20)],
    )
    plans, found, store = {}, {}, grids.stored

    def kept(rows, name):
        plans[name] = rows._jdf.queryExecution().optimizedPlan().toString()
        found[name] = store(rows, name)
        return found[name]

    monkeypatch.setattr(grids, "stored", kept)
    read = grids.listed_thresholds(page)
    got = sorted((r.school, r.program, r.level, r.status, r.points) for r in read.collect())
    assert got == sorted([
        ("Nord", "Idrettsfag", "Vg1", "points", 31.0), ("Nord", "Idrettsfag", "Vg2", "points", 32.0), ("Nord", "Idrettsfag", "Vg3", "points", 33.0),
        ("Sør", "Idrettsfag", "Vg3", "points", 33.0), ("Sør", "Idrettsfag", "Vg2", "open", None), *[(f"S{i}", "Naturbruk", "Vg2", "points", 33.0) for i in range(20)],
    ])
    assert found["meanings"].count() == found["meanings"].select("text").distinct().count() and found["meanings"].where("text = '33,0'").count() == 1
    assert found["programs"].count() == 2
    last = read._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(doc" in last and not any("line" in x.split("], [")[0] for x in last.splitlines() if "Window [" in x)
    assert "regexp_extract" not in plans["rows"]
