from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.functions import cells, stats, text


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first().y


CASES = [
    (" ", 8.0, False, None), ("-", 8.0, False, None), ("–", 8.0, False, None), ("..", 8.0, False, None), ("ikke aktuelt", 8.0, False, None),
    ("**", 8.0, False, None), ("38,8", 8.0, False, 38.8), ("38.8", 8.0, False, 38.8), ("38,8*", 8.0, False, 38.8), ("65", 8.0, False, 65.0),
    ("66,0", 8.0, False, None), ("4,0", 8.0, False, None), ("4,0", 0.0, False, 4.0), ("0,0", 0.0, False, 0.0),
    ("Ingen venteliste", 8.0, False, "open"), ("Ingen ventesliste", 8.0, False, "open"), ("Ledige plasser", 8.0, False, "open"),
    ("Alle som søkte, fikk tilbud", 8.0, False, "open"), ("Fortrinnsrett", 8.0, False, "F"), ("Fortinnsrett", 8.0, False, "F"),
    ("Fortsatt usikkert", 8.0, False, None), ("Utgår", 8.0, False, "U"), ("Lagt ned", 8.0, False, "U"), ("Dokumentasjon", 8.0, False, "D"),
    ("Intervju", 8.0, False, "D"), ("Inntak etter en kombinasjon av karakterer", 8.0, False, "D"),
    ("35,0 (+ tilleggspoeng) musikk", 0.0, False, None), ("35,0 (+ tilleggspoeng) musikk", 0.0, True, 35.0), ("123,4", 0.0, True, None),
    ("38,123", 0.0, False, None), ("38,123", 0.0, True, 38.0), (None, 8.0, False, None), ("Ledige  plasser", 8.0, False, "open"),
]


def test_cells(spark):
    for least, loose in {(c[1], c[2]) for c in CASES}:
        picked = [(c[0], c[3]) for c in CASES if (c[1], c[2]) == (least, loose)]
        rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(picked)], "i int, x string")
        got = rows.select("i", cells.classified(F.col("x"), least, loose).alias("c")).orderBy("i").collect()
        assert [r.c.points if r.c.status == "points" else r.c.status for r in got] == [w for _, w in picked]
    assert one(spark, lambda x: cells.classified_older(x)["status"], "Fortsatt usikkert") == "F"


def test_program_names(spark):
    for raw, want in {
        "Kunst,design": "Kunst, design", "Bygg og anlegg": "Bygg- og anleggsteknikk", "Idrettsfag vg1": "Idrettsfag",
        "Studiespesialisering .": "Studiespesialisering", "Helse og oppvekstfag, YSK 4år": "Helse- og oppvekstfag, YSK 4 år",
        "FBIE": "Frisør, blomster, interiør og eksponeringsdesign", "Elektro, SK 3år": "Elektro, SK 3 år",
    }.items():
        assert one(spark, cells.program_name, raw) == want
    assert [one(spark, cells.level_of, p) for p in ("Idrettsfag", "Påbygg til generell studiekompetanse", "Kokk")] == ["Vg1", "Vg3", "Vg2/Vg3"]


def test_texts(spark):
    assert one(spark, text.school_key, "Bryne videregående skole") == "bryne"
    assert one(spark, text.school_key, "St. Olav vgs") == one(spark, text.school_key, "St.Olav videregående skole") == "st olav"
    assert one(spark, lambda x: F.length(text.title(x)), "a" * 20_000) == 20_000
    assert one(spark, text.title, "art of the ICT and design") == "Art of the ICT and Design"
    a = one(spark, text.address, "Kabelgata 10-12, 3629, NORE")
    assert (a.street, a.number, a.postcode, a.place) == ("Kabelgata", "10", "3629", "NORE")
    assert one(spark, text.site_url, "a@b.no") is None and one(spark, text.site_url, "//x.no") == "https://x.no"
    assert one(spark, text.larger, "http://x/a?width=600&h=2") == "http://x/a?width=1600&h=2"
    assert one(spark, lambda x: text.picture_score(x, F.lit(None).cast("string"), F.array(F.lit("bryne"))), "http://x/Bryne-fasade.jpg") == 7
    assert one(spark, lambda x: text.picture_score(x, F.lit("logo"), F.array(F.lit("bryne"))), "http://x/a.jpg") == -10
    assert one(spark, lambda x: text.right_anchored(x, lambda t: F.nullif(F.regexp_extract(t, "^([0-9]+ ?[0-9]*)$", 1), F.lit(""))), "ab 12 34") == "12 34"
    assert one(spark, text.nfkc, "ﬁ①") == "fi1" and one(spark, text.nfkc, None) is None
    assert one(spark, text.paragraphs if False else lambda x: text.paragraphs(x, 50), "a  b\r\n\r\n\r\n\r\nc ") == "a b\n\nc"
    assert one(spark, lambda x: text.denoised(text.label(x)), "Elektro, SK 3 år, landslinje") == "elektro"


def test_message_clean_digests_whole_texts(spark, tmp_path):
    from hashlib import md5

    from panelforge.queries.texts import message_clean

    long = " ".join(f"word{i}" for i in range(1500))
    rows = [(1, f" {long}\r\nend  a"), (2, f" {long}\r\nend  b")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: [md5(f"{long}{gap}end {x}".encode()).hexdigest() for gap in " \n"] for i, x in ((1, "a"), (2, "b"))}
    assert {r.doc_id: [r.line, r.message] for r in message_clean(spark, str(tmp_path)).collect()} == want


def test_chances(spark):
    table = F.array(*[F.lit(-2 + 0.1 * k) for k in range(41)])
    grid = spark.createDataFrame([(z,) for z in (0.0, 0.05, -3.0, 2.0, -2.0)], "z double")
    got = [r.p for r in grid.select(stats.empirical_cdf(F.col("z"), table).alias("p")).collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, (0.5, 0.5125, 0.005, 0.995, 0.005)))
    m, s, fill, x = F.lit(40.0), F.lit(4.0), F.lit(0.8), F.lit(44.0)
    row = spark.range(1).select(
        stats.chance(x, m, s, fill, table).alias("a"), stats.final_chance(x, m, s, fill, table, F.lit(0.32), F.lit(-3.2)).alias("b"),
        stats.band(stats.chance(x, m, s, fill, table)).alias("c"), stats.normal_cdf(F.lit(1.0)).alias("d"),
        stats.empirical_cdf(F.lit(1.0), F.array(*[F.lit(v) for v in [0.0] + [1.0] * 20 + [2.0] * 20])).alias("flat"),
        *[stats.history_bucket(F.lit(h)).alias(f"h{h}") for h in (0, 1, 2, 3, 4, 99, 100)],
        *[stats.decile(F.lit(p)).alias(f"p{i}") for i, p in enumerate((0.05, 0.15, 0.95, 1.0))],
    ).first()
    assert abs(row.a - 0.8) < 1e-9 and abs(row.b - 0.9728) < 1e-9 and row.c == "likely" and abs(row.d - 0.8413447) < 1e-6
    assert abs(row.flat - 0.5) < 1e-9
    assert [row[f"h{h}"] for h in (0, 1, 2, 3, 4, 99, 100)] == [0, 1, 2, 2, 3, 3, 3] and [row[f"p{i}"] for i in range(4)] == [0, 1, 9, 9]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(max_size=20), min_size=1, max_size=20))
def test_any_text_has_a_class(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select(cells.classified(F.col("x"), 0.0, True).alias("c")).collect()
    assert all((r.c.status == "points") == (r.c.points is not None) for r in rows)


def test_norm_is_the_compatibility_form_of_every_character(spark):
    import unicodedata

    chars = [chr(c) for c in (*range(1, 0x250), 0x0301, 0x2010, 0x2126, 0xFB01, 0xFF21, 0x1D400)]
    texts = [f"x{c}\u00e5y" for c in chars] + ["e\u0301", "", "plain", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.n for r in df.select("i", text.norm(F.col("t")).alias("n")).collect()}
    for i, t in enumerate(texts):
        want = unicodedata.normalize("NFKC", t or "").replace("\u00a0", " ").replace("\u2010", "-").strip(" ")
        assert got[i] == want, repr(t)
