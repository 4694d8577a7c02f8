"""Effects by sweeps against a dense solution; predictions by joins, cell by cell."""

import itertools
import math

import numpy as np
import pytest

from panelforge.operators import sweeps

OBS = "county string, school string, program string, category string, year int, state string, v double, w double"
COEFS = "effect string, county string, level string, year int, m double, eta double"


def test_sweeps_come_to_the_penalised_solution(spark):
    draw = np.random.default_rng(5)
    rows = [
        (f"c{s % 2}", f"s{s}", f"p{p}", f"k{p % 2}", y, float(draw.normal(40, 6)), float(draw.uniform(0.3, 1)))
        for s, p, y in itertools.product(range(4), range(3), range(2019, 2022)) if draw.random() < 0.8
    ]
    given = spark.createDataFrame(rows, "county string, school string, program string, category string, year int, z double, w double").coalesce(1)
    mu, _, fitted = sweeps.swept(given, sweeps=7)
    place = dict(zip("county school program category year".split(), range(5)))
    codes, shrinks = [], []
    for keys, shrink in sweeps.EFFECTS.values():
        of = [tuple(r[place[k]] for k in keys) for r in rows]
        names = sorted(set(of))
        codes.append(np.array([[o == n for n in names] for o in of], float))
        shrinks += [shrink] * len(names)
    x, w, z = np.hstack(codes), np.array([r[6] for r in rows]), np.array([r[5] for r in rows])
    assert mu == pytest.approx((w * z).sum() / w.sum())
    # categories are free and programmes lie within them, so the fit is compared where it is unique: in what it predicts
    b = np.linalg.lstsq(x.T @ (w[:, None] * x) + np.diag(shrinks), x.T @ (w * (z - mu)), rcond=None)[0]
    got = np.zeros(len(rows))
    for name, (keys, _) in sweeps.EFFECTS.items():
        table = {tuple(r[k] for k in keys): r.b for r in fitted[name].collect()}
        got += [table[tuple(r[place[k]] for k in keys)] for r in rows]
    assert np.abs(got - x @ b).max() < 0.05


def test_predictions_by_joins(spark):
    coefs = spark.createDataFrame(
        [
            ("mu", None, None, None, 40.0, 1.0), ("late", None, None, None, None, 0.25), ("alpha", None, None, None, None, 0.5),
            ("cat", None, "k", None, 1.0, -1.0), ("school", "c", "s", None, 2.0, None), ("prog", None, "p", None, None, 0.5),
            ("series", "c", "s|p", None, 0.25, 0.125), ("cy", "c", None, 2020, 3.0, 1.0), ("cy", "c", None, 2022, None, 2.0),
            ("cy", "d", None, 2021, 5.0, 5.0),
        ],
        COEFS,
    )
    asked = [("c", "s", "p", "k", 2019), ("c", "s", "p", "k", 2021), ("c", "s", "p", "k", 2030), ("d", "s", "p", None, 2021), (None, "s", "p", "k", 2021)]
    got = sweeps.predicted(spark.createDataFrame(asked, "county string, school string, program string, category string, year int"), coefs)
    by = {(r.county, r.year): r for r in got.collect()}
    base, eta = 40 + 1 + 2 + 0.25, 1 + 0.25 - 1 + 0.5 + 0.125 + 0.5 * 2
    want = {
        ("c", 2019): (base, eta), ("c", 2021): (base + 3, eta + 1), ("c", 2030): (base + 3, eta + 2),  # an empty newer year hides no older one
        ("d", 2021): (45.0, 1 + 0.25 + 0.5 + 5.0), (None, 2021): (41.0, 1 + 0.25 - 1 + 0.5),
    }
    assert set(by) == set(want)
    for key, (m, e) in want.items():
        assert by[key].m == pytest.approx(m) and by[key].pi == pytest.approx(1 / (1 + math.exp(-e))), key


def test_nothing_observed(spark):
    found = sweeps.coefficients(spark.createDataFrame([], OBS), sweeps=1).collect()
    assert [(r.effect, r.m, r.eta) for r in found] == [("mu", 0.0, 0.0)]
