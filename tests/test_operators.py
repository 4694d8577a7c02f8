import numpy as np
import pandas as pd

from panelforge.operators import layout, match, merge, model
from panelforge.operators.baselines import round_bridge
from panelforge.schemas import SOURCE_ROWS
from panelforge.sources.html import read_cells


def merged(spark, *rows):
    """Rows (source, school, level, {year: cell}); the earlier source is the newer one."""
    flat = [
        ("X", s, "AB".index(s), pos, school, "Prog", level, y, *(("points", float(v)) if not isinstance(v, str) else (v, None)))
        for pos, (s, school, level, values) in enumerate(rows)
        for y, v in values.items()
    ]
    series, drift = merge.merge_sources(spark.createDataFrame(flat, SOURCE_ROWS))
    out: dict = {}
    for r in series.collect():
        out.setdefault((r.school, r.level, r.occurrence), {})[r.year] = r.points
    return out, [(r.year, r.kept_points, r.kept_from, r.ignored_points, r.ignored_from) for r in drift.collect()]


def test_merge_cases(spark):
    s = "Skole"
    assert merged(spark, ("A", s, "Vg1", {2024: 38.8}), ("B", s, "Vg1", {2024: 39.0, 2023: 36.5})) == (
        {(s, "Vg1", 0): {2024: 38.8, 2023: 36.5}}, [(2024, 38.8, "A", 39.0, "B")])
    assert merged(spark, ("A", s, "Vg1", {2024: 38.8}), ("A", s, "Vg1", {2024: 38.8, 2023: 36.0})) == ({(s, "Vg1", 0): {2024: 38.8, 2023: 36.0}}, [])
    got = merged(spark, ("A", s, "Vg1", {2024: 38.8}), ("A", s, "Vg1", {2024: 40.0}))
    assert got == ({(s, "Vg1", 0): {2024: 38.8}}, [(2024, 38.8, "A", 40.0, "A")])
    assert merged(spark, ("A", s, "Vg2/Vg3", {2025: 41}), ("B", s, "Vg2", {2024: 40})) == ({(s, "Vg2", 0): {2025: 41, 2024: 40}}, [])
    got, log = merged(spark, ("A", s, "Vg2/Vg3", {2025: 41}), ("B", s, "Vg2", {2024: 40}), ("B", s, "Vg3", {2024: 37}))
    assert set(got) == {(s, "Vg2/Vg3", 0), (s, "Vg2", 0), (s, "Vg3", 0)} and not log
    got, log = merged(spark, ("A", s, "Vg2/Vg3", {2025: 41}), ("A", s, "Vg2/Vg3", {2025: 43}))
    assert set(got) == {(s, "Vg2/Vg3", 0), (s, "Vg2/Vg3", 1)} and not log
    got, _ = merged(spark, ("A", "Bergen Maritime", "Vg1", {2024: 30}), ("B", "Bergen maritime", "Vg1", {2023: 31}))
    assert got == {("Bergen Maritime", "Vg1", 0): {2024: 30, 2023: 31}}
    got = merged(spark, ("A", s, "Vg1", {2024: 38.8}), ("B", s, "Vg1", {2024: 38.8}), ("B", s, "Vg1", {2024: 37.0}))
    assert got == ({(s, "Vg1", 0): {2024: 38.8}}, [(2024, 38.8, "A", 37.0, "B")])


def test_round_bridge(spark):
    rows = [("X", "ST", "2", "1", 30.0, "num", 34.0, "num"), ("X", "ST", "2", "1", None, "open", 28.0, "num"), ("X", "ST", "2", "1", 20.0, "num", 0.0, "zero")]
    ddl = "county string, category string, main_round string, alt_round string, vm double, main_state string, va double, alt_state string"
    for r in round_bridge(spark.createDataFrame(rows, ddl)).collect():
        assert (r.from_round, r.to_round, r.n_pairs, r.mean, r.sd, r.n_had_queue, r.n_vanished) == ("1", "2", 1, -4.0, 0.0, 3, 1)
        assert abs(r.share_vanished - 1 / 3) < 1e-6


def test_islands_are_chained(spark):
    rows = spark.createDataFrame([(1, t) for t in (0.0, 1.5, 3.0, 5.5)], "page int, top double")
    assert [r.island for r in layout.islands(rows, ["page"], "top", 2.0).orderBy("top").collect()] == [0, 0, 0, 1]


def test_year_repair(spark):
    cases = {(2023, 2023, 2025): [2023, 2024, 2025], (2023, 2023, 2023): [2023, 2024, 2025], (2023, 2023, 2026): [2023, 2023, 2026], (2019, 2020): [2019, 2020]}
    for years, want in cases.items():
        df = spark.createDataFrame([(list(years),)], "y array<int>")
        assert df.select(layout.repaired_years(df["y"]).alias("r")).first().r == want


def test_matrix_of_words(spark):
    words = [("d", 1, t, x, x + 10, top, top + 8, "f") for t, x, top in (
        ("Fag", 0, 10), ("2023", 100, 10), ("2023", 150, 10), ("2025", 200, 11),
        ("Bygg", 0, 30), ("og", 12, 30), ("38,8", 102, 31), ("open", 149, 30), ("41,0", 205, 30), ("37,1", 101, 50))]
    got = layout.matrix_rows(spark.createDataFrame(words, "doc string, page int, text string, x0 double, x1 double, top double, bottom double, fontname string"
                                                   .replace("x0 double", "x0 int").replace("x1 double", "x1 int").replace("top double", "top int").replace("bottom double", "bottom int")))
    assert sorted((r.row_label, r.year, r.text) for r in got.collect()) == [
        ("Bygg og", 2023, "37,1"), ("Bygg og", 2023, "38,8"), ("Bygg og", 2024, "open"), ("Bygg og", 2025, "41,0")]


def test_html_cells():
    html = "<h2>Top</h2><table><tr><th>A<td>1&amp;2</tr><tr><td> x <b>y</b></td></tr></table><p>no</p><table><caption>C</caption><tr><td>z</table>"
    assert read_cells(html) == [(0, 0, 0, "A", "Top"), (0, 0, 1, "1&2", "Top"), (0, 1, 0, "x y", "Top"), (1, 0, 0, "z", "C")]
    assert read_cells(None) == [] and read_cells("<table><tr>") == []


def test_match_within_county(spark):
    schools = spark.createDataFrame([("Bryne vgs", "R"), ("Olav", "R"), ("None", "S"), ("Hand", "S")], "school string, county string")
    register = spark.createDataFrame(
        [("1", "Bryne videregående skole", "R", 1), ("2", "St. Olav avd sentrum", "R", 0), ("3", "Bryne", "S", 2)], "orgnr string, navn string, fylke string, pos int"
    )
    manual = spark.createDataFrame([("Hand", "S", "9")], "school string, county string, orgnr string")
    got = {r.school: (r.tier, r.orgnr) for r in match.cascade(schools, register, manual).collect()}
    assert got == {"Bryne vgs": (1, "1"), "Olav": (3, "2"), "None": (9, None), "Hand": (0, "9")}


def panel_frame(n=400, seed=3):
    rand = np.random.default_rng(seed)
    return pd.DataFrame({
        "county": rand.choice(["A", "B"], n), "school": rand.choice([f"s{i}" for i in range(6)], n), "program": rand.choice(["p", "q", "r"], n),
        "category": "c", "year": rand.integers(1995, 2001, n), "state": rand.choice(["num", "num", "open"], n), "v": rand.normal(30, 5, n),
    })


def test_elimination_solves_the_whole_system():
    frame = panel_frame()
    keys, taus = model.keys_of(frame), {n: t for n, (_, t) in model.EFFECTS.items() if t}
    system, w, z = model.System(keys), np.linspace(0.5, 1, len(frame)), frame["v"].to_numpy()
    coef = system.solve(w, z, taus)
    names = list(model.EFFECTS)
    x = np.concatenate([np.eye(len(system.levels[n]))[system.codes[n]] for n in names], axis=1)
    p = np.zeros((x.shape[1], x.shape[1]))
    at = 0
    for n in names:
        size = len(system.levels[n])
        p[at : at + size, at : at + size] = model._penalty(n, system.levels[n], taus.get(n))
        at += size
    want = np.linalg.solve(x.T @ (w[:, None] * x) + p, x.T @ (w * z))
    assert np.abs(np.concatenate([coef[n] for n in names]) - want).max() < 1e-4


def test_fill_fit_is_at_its_optimum():
    frame = panel_frame()
    y, w = (frame["state"] != "open").to_numpy(float), np.ones(len(frame))
    fit = model.fit_fill(model.keys_of(frame), y, w)
    eta = sum(fit.coef[n][fit.codes[n]] for n in model.EFFECTS)
    p = 1 / (1 + np.exp(-eta))
    assert abs((y - p).sum()) < 1e-3  # the free mean balances
    assert all(t >= model.LEAST_TAU for t in fit.taus.values())
    a, b = model.platt(p, y)
    assert abs(a) < 2 and b > 0


def test_sources_merged_takes_every_year(spark, sf):
    from panelforge.plans.panel import panel
    from panelforge.queries.merging import sources_merged

    of = lambda rows: {(r.county, r.school.lower(), r.program.lower(), r.year) for r in rows}
    got = sources_merged(spark, sf).select("county", "school", "program", "year").distinct().collect()
    want = panel(spark, sf).select("county", "school", "program", "year").distinct().collect()
    assert of(got) == of(want) and {r.year for r in got} > {1995, 1996, 1997}


def test_merge_equals_brute_force(spark):
    """One level and no repeats within a source: the newest source's cell stays, and what differs from it is logged."""
    rand = np.random.default_rng(5)
    rows = [
        (c, s, "AB".index(s), p, "Skole" if s == "A" else "SKOLE", f"Prog {p}", "Vg1", y, "points", float(rand.integers(30, 33)))
        for c in "XY" for s in "AB" for p in range(4) for y in range(1995, 2002) if rand.random() < 0.7
    ]
    kept, lost = {}, []
    for c, s, rank, p, _, program, _, y, _, v in sorted(rows, key=lambda r: r[2]):
        first = kept.setdefault((c, program, y), (v, s))
        if first[0] != v:
            lost.append((c, program, y, *first, v, s))
    series, drift = merge.merge_sources(spark.createDataFrame(rows, SOURCE_ROWS))
    assert {(r.county, r.program, r.year): (r.points, r.source) for r in series.collect()} == kept and series.count() == len(kept)
    assert sorted((r.county, r.program, r.year, r.kept_points, r.kept_from, r.ignored_points, r.ignored_from) for r in drift.collect()) == sorted(lost)


def test_covariate_and_offsets_enter_the_fit():
    frame = panel_frame()
    rand = np.random.default_rng(4)
    keys, alpha = model.keys_of(frame), rand.normal(size=len(frame))
    system, w, z = model.System(keys, alpha), np.linspace(0.5, 1, len(frame)), rand.normal(size=len(frame))
    taus = {n: t for n, (_, t) in model.EFFECTS.items() if t}
    coef = system.solve(w, z, taus)
    names = [*model.EFFECTS, "alpha"]
    x = np.concatenate([np.eye(len(system.levels[n]))[system.codes[n]] for n in model.EFFECTS] + [alpha[:, None]], axis=1)
    sizes = np.cumsum([0] + [len(system.levels[n]) for n in names])
    p = np.zeros((x.shape[1], x.shape[1]))
    for n, a, b in zip(names, sizes[:-1], sizes[1:]):
        p[a:b, a:b] = model._penalty(n, system.levels[n], taus.get(n))
    want = np.linalg.solve(x.T @ (w[:, None] * x) + p, x.T @ (w * z))
    got = np.concatenate([coef[n] for n in names])
    assert np.abs(x @ got - x @ want).max() < 1e-4 and abs(got[-1] - want[-1]) < 1e-4
    late = frame.assign(late=frame["year"] == frame["year"].max(), offset=-3.0)
    moved = late.assign(v=late["v"] + np.where(late["late"], -3.0, 0.0))
    plain = model.fit_both(frame.assign(late=False, offset=-3.0), None)[0]
    assert np.allclose(model.fit_both(moved, None)[0].coef["school"], plain.coef["school"])


def test_recalibration_of_a_table_equals_that_of_arrays(spark):
    rand = np.random.default_rng(8)
    pi = rand.uniform(0.02, 0.98, 500)
    y = (rand.random(500) < 1 / (1 + np.exp(-(0.3 + 0.5 * np.log(pi / (1 - pi)))))).astype(float)
    table = spark.createDataFrame([(float(p), "num" if k else "open") for p, k in zip(pi, y)], "pi double, state string")
    got, want = model.platt_table(table), model.platt(pi, y)
    assert np.allclose(got, want, atol=1e-6) and model.fill_loss(table, *got) < model.fill_loss(table, 0.0, 1.0)


def test_closest_and_contained_names_against_difflib(spark):
    import difflib
    import random

    from panelforge.operators import taxonomy

    rand = random.Random(6)
    entries = ["".join(rand.choice("abcde ") for _ in range(rand.randint(3, 16))).strip() or "x" for _ in range(120)]
    entries = sorted(set(entries))
    labels = []
    for _ in range(80):
        word = list(rand.choice(entries))
        for _ in range(rand.randint(0, 2)):
            word[rand.randrange(len(word))] = rand.choice("abcde")
        labels.append("".join(word) + (rand.choice(entries) if rand.random() < 0.3 else ""))
    labels = sorted({x for x in labels if x.strip()})
    left = spark.createDataFrame([(x, x) for x in labels], "wanted string, base string")
    index = spark.createDataFrame([(e, e.upper(), i) for i, e in enumerate(entries)], "entry string, entry_code string, pos int")
    close = {r.wanted: r.close_code for r in taxonomy.closest(left, index).collect()}
    inside = {r.wanted: r.inside_code for r in taxonomy.longest_inside(left, index).collect()}
    for x in labels:
        want = difflib.get_close_matches(x, entries, n=1, cutoff=taxonomy.CLOSE)
        assert close.get(x) == (want[0].upper() if want else None)
        held = [e for e in entries if len(e) > 7 and e in x]
        assert inside.get(x) == (max(held, key=len).upper() if held else None)


def test_near_points_against_all_pairs(spark):
    import math
    import random

    from panelforge.operators import match

    rand = random.Random(3)
    near = [(59.9, 10.7), (89.99, 10.0), (89.99, -170.0), (-89.98, 0.0), (0.1, 179.9), (-0.1, -179.9), (60.0, 180.0), (60.0, -180.0)]
    points = [(i, *at) for i, at in enumerate(near + [(rand.uniform(-90, 90), rand.uniform(-180, 180)) for _ in range(150)])]
    points += [(500, None, 5.0), (501, 5.0, None), (502, 59.9, 10.7)]
    df = spark.createDataFrame(points, "id int, lat double, lon double")

    def km(a, b):
        p, q = math.radians(a[1]), math.radians(b[1])
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[2] - a[2]) / 2) ** 2
        return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))

    whole = [x for x in points if None not in x]
    for limit in (0.0, 60.0, 900.0, 25000.0):
        got = sorted((r.id_a, r.id_b) for r in match.within_km(df, df, limit).collect())
        assert got == sorted((a[0], b[0]) for a in whole for b in whole if km(a, b) <= limit)


def test_a_very_long_label_holds_an_entry(spark):
    from panelforge.operators import taxonomy

    label = "abcdefghij" * 2000
    left = spark.createDataFrame([("long", label + "kokkefaget" + label), ("none", label), ("short", "kokk")], "wanted string, base string")
    index = spark.createDataFrame([("kokkefaget", "K", 1), ("kokkefag", "S", 0), ("kokk", "N", 2)], "entry string, entry_code string, pos int")
    assert [tuple(r) for r in taxonomy.longest_inside(left, index).collect()] == [("long", "K")]
    assert taxonomy.longest_inside(left, index.limit(0)).count() == 0


def test_resolve_with_columns_of_clashing_names(spark):
    from panelforge.operators import taxonomy
    from panelforge.schemas import REGISTER

    register = spark.createDataFrame([("TPTIP1----", "Teknologi- og industrifag", None, None)], REGISTER)
    names = spark.createDataFrame([("Teknologi- og industrifag", 1), ("Teknoloﬁ", 2), (None, 3)], "name string, code int")
    got = {r.name: r.how for r in taxonomy.resolve(names, register, "name").collect()}
    assert got["Teknologi- og industrifag"] == "exact" and len(got) == 3


def test_years_are_written_by_the_writer(spark, tmp_path):
    from panelforge.sinks import nested

    rows = spark.createDataFrame([(1995 + i % 3, i) for i in range(30)], "year int, n int")
    nested.write_tables({"samples": rows, "flat": rows.select("n")}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "samples")).count() == spark.read.parquet(str(tmp_path / "flat")).count() == 30
    nested.write_csv(rows, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 30
    nested.write_model({"halflife": 4.0}, rows, str(tmp_path / "model"))
    assert spark.read.text(str(tmp_path / "model")).count() == 31
