"""The fit by passes over schools against the fit of one frame."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelforge.operators import fits, model


@pytest.fixture(scope="module")
def frame():
    rand, n = np.random.default_rng(7), 700
    found = pd.DataFrame({
        "county": rand.choice(["A", "B"], n, p=[0.7, 0.3]), "school": rand.choice([f"s{i}" for i in range(14)], n), "program": rand.choice(["p", "q", "r", "t"], n),
        "year": rand.integers(1995, 2001, n), "state": rand.choice(["num", "num", "zero", "open"], n), "late": rand.random(n) < 0.2,
    })
    found = found.drop_duplicates(["county", "school", "program", "year"], ignore_index=True)
    found["category"] = np.where(found["program"] < "r", "c", "d")
    found["v"] = np.where(found["state"] == "num", rand.normal(30, 5, len(found)) + found["school"].str[1:].astype(int), np.where(found["state"] == "zero", 0.0, np.nan))
    found["offset"] = np.where(found["late"], -3.0, 0.0)
    return found[~((found["school"] == "s3") & (found["state"] == "num"))].reset_index(drop=True)[model.INPUT]


@pytest.fixture(scope="module")
def rows(spark, frame):
    data = frame.astype(object).where(frame.notna(), None)
    return spark.createDataFrame(data.values.tolist(), "county string, school string, program string, category string, year int, state string, v double, late boolean, offset double")


def test_passes_give_the_estimates_of_one_frame(spark, frame, rows, monkeypatch):
    monkeypatch.setattr(fits, "ROWS", 40)
    want = model.fit_both(frame.sort_values([*model.SERIES, "year"], ignore_index=True), 2.5, True)
    got = {(r.part, r.effect, r.level): (r.value, r.tau) for r in model.effects(rows, 2.5, True).collect()}
    keys = set()
    for part, fit in zip(("level", "fill"), want):
        for name in fit.levels:
            for level, b in zip(fit.levels[name], fit.coef[name]):
                keys.add((part, name, str(level)))
                value, tau = got[part, name, str(level)]
                assert abs(value - b) < 1e-4, (part, name, level, value, b)
                assert tau == pytest.approx(fit.taus.get(name), abs=1e-5) if name in fit.taus else tau is None
    assert keys == set(got)


@pytest.mark.parametrize("couple", [False, True])
def test_each_fold_predicts_what_a_fit_of_its_years_does(frame, rows, couple):
    got = model.walk_forward(rows, (2.5, None), couple).toPandas()
    frame = frame.sort_values([*model.SERIES, "year"], ignore_index=True)
    n = 0
    for t in range(1996, 2001):
        for halflife in (2.5, None):
            train, test = frame[frame["year"] < t], frame[(frame["year"] == t) & ~frame["late"]]
            fit = model.fit_both(train, halflife, couple)
            m, pi = model.predict(fit, test, t)
            mine = got[(got["T"] == t) & (got["halflife"].isna() if halflife is None else got["halflife"] == halflife)]
            both = test.assign(m=m, pi=pi).merge(mine, on=model.SERIES)
            n += len(both)
            assert len(both) == len(test) == len(mine)
            assert np.abs(both["m_x"] - both["m_y"]).max() < 1e-4 and np.abs(both["pi_x"] - both["pi_y"]).max() < 1e-5
            assert np.abs(both["sigma"] - fit[0].sigma).max() < 1e-5
            hist = train[train["state"] == "num"].groupby(model.SERIES).size().rename("n").reset_index()
            assert (both.merge(hist, "left", on=model.SERIES)["n"].fillna(0) == both["hist"]).all()
    assert n == len(got)


def test_no_task_holds_all_observations(rows):
    panel = fits.packed(rows)
    assert panel.rows.count() == rows.select("county", "school").distinct().count()
    assert panel.rows.agg(F.sum(F.size("cells"))).first()[0] == rows.count()
    assert panel.space.p < 30


def test_cells_of_a_series_may_share_a_year_and_differ_in_category(spark, frame):
    """Planes hold a cell a series: repeated cells, early and late ones and other categories of a year have planes of their own."""
    other = frame.sample(frac=0.4, random_state=1).assign(category="e", late=lambda f: ~f["late"], offset=lambda f: np.where(f["late"], -3.0, 0.0))
    more = pd.concat([frame, frame.iloc[::5], other], ignore_index=True).sort_values([*model.SERIES, "year"], ignore_index=True)
    rows = spark.createDataFrame(more.astype(object).where(more.notna(), None).values.tolist(), "county string, school string, program string, category string, year int, state string, v double, late boolean, offset double")
    want = model.fit_both(more, None, True)
    got = {(r.part, r.effect, r.level): (r.value, r.tau) for r in model.effects(rows, None, True).collect()}
    for part, fit in zip(("level", "fill"), want):
        for name in fit.levels:
            for level, b in zip(fit.levels[name], fit.coef[name]):
                value, tau = got[part, name, str(level)]
                assert abs(value - b) < 1e-4 and (tau is None or abs(tau - fit.taus[name]) < 1e-5), (part, name, level, value, b)
    assert len(got) == sum(len(fit.levels[name]) for fit in want for name in fit.levels)


def test_a_choice_fits_only_what_it_compares(rows, monkeypatch):
    """The half-life is chosen by the level of the calibration years; the fill part is fitted for the chosen one, the level once."""
    fits_of, one_pass = [], fits._pass

    def counted(panel, folds):
        fits_of.append([(fold.until, fold.halflife, fold.couple, which) for fold, which in folds.values()])
        return one_pass(panel, folds)

    monkeypatch.setattr(fits, "_pass", counted)
    panel = fits.packed(rows)
    choice = model.choose(panel, (1998, 1999))
    years = set(range(1996, 2001))
    level = {(u, h) for work in fits_of for u, h, _, which in work if which == "level"}
    assert level == {(u, h) for u in (1998, 1999) for h in model.HALFLIVES} | {(u, choice.halflife) for u in years}
    assert {x[:3] for work in fits_of for x in work if x[3] == "fill"} == {(u, choice.halflife, c) for u in years for c in (False, True)}
    for work in fits_of:
        levels = [x[:2] for x in work if x[3] == "level"]
        assert len(levels) == len(set(levels))
    monkeypatch.undo()
    grid = model.walk_forward(panel, model.HALFLIVES).cache()
    best = model.best_halflife(grid.where(F.col("T").isin(1998, 1999))).collect()
    errors = model.halflife_errors(panel, (1998, 1999))[0].collect()
    assert [(r.halflife, r.n) for r in errors] == [(r.halflife, r.n) for r in best] and choice.halflife == best[0].halflife
    assert all(abs(a.rmse - b.rmse) < 1e-6 for a, b in zip(errors, best))
    own = grid.where(F.col("halflife").eqNullSafe(F.lit(choice.halflife)))
    plain = model.fill_loss(own.where(F.col("T").isin(1998, 1999)), *model.platt_table(own.where(F.col("T").isin(1998, 1999))))
    assert abs(plain - choice.losses[0]) < 1e-7 and choice.preds.count() == own.count()


def test_a_pass_does_not_depend_on_where_schools_lie(rows, monkeypatch):
    """Sums are the same whether a task works on all schools of a county at once or on one at a time."""
    panel = fits.packed(rows)
    fold = fits.fitted(panel, [(1999, 2.5, True)])[0]
    batches = panel.rows.orderBy("county", "school").toArrow().to_batches()

    def sums(at_once: int) -> dict:
        monkeypatch.setattr(fits, "ROWS", at_once)
        found, n = {}, 0
        for chunk in (c for batch in batches for c in fits.chunks(panel.space, batch)):
            n += 1
            for which in ("level", "fill"):
                into = found.setdefault((chunk.county, which), fits.Sums(panel.space, fold, which))
                (chunk.level_sums if which == "level" else chunk.fill_sums)(fold, into)
        return {k: into.flat(k[0]) for k, into in found.items()}, n

    (one, n), (all_, m) = sums(1), sums(20_000)
    assert n > m and one.keys() == all_.keys() and len(one) == 4
    assert all(np.allclose(one[k], all_[k], rtol=1e-6, atol=1e-6) for k in one)


def test_forecasts_are_those_of_a_fit_of_all_years(frame, rows):
    """Series with a cell in the last two years are forecast, each from its own cells."""
    got = model.forecasts(rows, model.QUICK).toPandas()
    frame = frame.sort_values([*model.SERIES, "year"], ignore_index=True)
    last = frame.groupby([*model.SERIES, "category"])["year"].max().reset_index()
    last = last[last["year"] >= frame.groupby("county")["year"].max()[last["county"]].to_numpy() - 1].reset_index(drop=True)
    fit = model.fit_both(frame, model.QUICK.halflife, True)
    m, pi = model.predict(fit, last, 2001)
    both = last.assign(m=m, pi=pi).merge(got, on=[*model.SERIES, "category"])
    assert len(both) == len(last) == len(got)
    assert np.abs(both["m_x"] - both["m_y"]).max() < 1e-4 and np.abs(both["pi_x"] - both["pi_y"]).max() < 1e-5
    hist = frame[frame["state"] == "num"].groupby(model.SERIES).size().rename("n").reset_index()
    assert (both.merge(hist, "left", on=model.SERIES)["n"].fillna(0) == both["hist"]).all()
