"""The two-part forecast: a penalised linear model of thresholds and a penalised logistic one of filling up.

Effects: a mean, categories (free), schools, programmes and series (ridge), county-years (random walk). For given spreads
the coefficients solve a linear system, the spreads follow by expectation-maximisation, three rounds of each. Every
observation has exactly one series, so series are eliminated first (by the few effects that each meets, never as a full
matrix) and the system that is solved holds the other effects only. ``fit_both`` and what it calls fit a frame; tables are
fitted by ``fits``, to the same estimates.

Cells of a later round than usual carry an offset, the round bridge's mean, in the first part and an effect of their own in
the second; they are learned from but never predicted. The second part may be coupled to the first by the school's effect as
a covariate. ``choose`` decides on the half-life and the coupling by the backtest and recalibrates the fill probability.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions.stats import expit, history_bucket, logit
from panelforge.operators import fits
from panelforge.operators.rules import offsets
from panelforge.plans.panel import SERIES
from panelforge.plans.stored import stored

#: Kind and first spread of each effect; the years of half-life that are tried.
EFFECTS = {"mu": ("fixed", None), "school": ("ridge", 4.0), "cat": ("fixed", None), "prog": ("ridge", 3.0), "series": ("ridge", 3.0), "cy": ("walk", 1.0)}
HALFLIVES = (1.5, 2.5, 4.0, None)
FREE, ROUNDS, LEAST_TAU = 1e-6, 3, 0.3


@dataclass
class Fit:
    levels: dict[str, list]
    coef: dict[str, np.ndarray]
    taus: dict[str, float]
    sigma: float = 1.0
    codes: dict[str, np.ndarray] = field(default_factory=dict)

    def effect(self, name: str, keys: pd.Series) -> np.ndarray:
        """Effects by key; what was not seen has none."""
        table = dict(zip(self.levels[name], self.coef[name]))
        return keys.map(lambda k: table.get(k, 0.0)).to_numpy(float)

    def county_effect(self, counties: pd.Series, year: int) -> np.ndarray:
        """The newest fitted year of the county up to ``year``."""
        newest: dict = {}
        for (county, y), b in sorted(zip(self.levels["cy"], self.coef["cy"])):
            if y <= year:
                newest[county] = b
        return counties.map(lambda c: newest.get(c, 0.0)).to_numpy(float)


def keys_of(frame: pd.DataFrame) -> dict[str, pd.Series]:
    school = frame["county"] + "|" + frame["school"]
    return {
        "mu": pd.Series(0, frame.index), "school": school, "cat": frame["category"], "prog": frame["program"],
        "series": school + "|" + frame["program"], "cy": pd.Series(list(zip(frame["county"], frame["year"])), frame.index),
    }


def _penalty(name: str, levels: list, tau: float | None) -> np.ndarray:
    kind, n = EFFECTS.get(name, ("fixed", None))[0], len(levels)
    if kind == "fixed":
        return np.eye(n) * FREE
    if kind == "ridge":
        return np.eye(n) / tau**2
    steps = [i for i in range(1, n) if levels[i][0] == levels[i - 1][0]]
    d = np.zeros((len(steps), n))
    for row, i in enumerate(steps):
        d[row, i], d[row, i - 1] = 1.0, -1.0
    return d.T @ d / tau**2 + np.eye(n) * 1e-4


class System:
    """Solves (X'WX + P) b = X'Wz with the series eliminated. ``alpha`` is a free covariate, a number for each row."""

    def __init__(self, keys: dict[str, pd.Series], alpha: np.ndarray | None = None):
        coded = {name: pd.factorize(k, sort=True) for name, k in keys.items()}
        self.codes = {name: c for name, (c, _) in coded.items()}
        self.levels = {name: list(u) for name, (_, u) in coded.items()}
        self.small = [n for n in keys if n != "series"]
        if alpha is not None:
            self.codes["alpha"], self.levels["alpha"] = np.zeros(len(alpha), np.int64), [0]
            self.small.append("alpha")
        starts = np.cumsum([0] + [len(self.levels[n]) for n in self.small])
        self.slices = {n: slice(a, b) for n, a, b in zip(self.small, starts[:-1], starts[1:])}
        self.places = np.stack([self.codes[n] + self.slices[n].start for n in self.small], axis=1)
        self.values = np.ones(self.places.shape)
        if alpha is not None:
            self.values[:, -1] = alpha
        self.p, self.rows = int(starts[-1]), len(self.places)
        # the effects that each series meets: row s of met holds their places, in as many columns as it takes
        pairs, self.pair = np.unique(self.codes["series"][:, None] * self.p + self.places, return_inverse=True)
        self.owner, place = pairs // self.p, pairs % self.p
        self.column = np.arange(len(pairs)) - np.searchsorted(self.owner, self.owner)
        self.met = np.zeros((len(self.levels["series"]), int(self.column.max()) + 1), np.int64)
        self.met[self.owner, self.column] = place

    def solve(self, w: np.ndarray, z: np.ndarray, taus: dict[str, float]) -> dict[str, np.ndarray]:
        series, n = self.codes["series"], len(self.levels["series"])
        d = np.bincount(series, w, n) + 1.0 / taus["series"] ** 2
        own = np.bincount(series, w * z, n)
        weighted = w[:, None] * self.values
        cross = np.zeros(self.met.shape)
        cross[self.owner, self.column] = np.bincount(self.pair.ravel(), weighted.ravel(), len(self.owner))
        b, rhs = np.zeros((self.p, self.p)), np.zeros(self.p)
        for i in range(self.places.shape[1]):
            np.add.at(rhs, self.places[:, i], weighted[:, i] * z)
            for j in range(self.places.shape[1]):
                np.add.at(b, (self.places[:, i], self.places[:, j]), weighted[:, i] * self.values[:, j])
        for name in self.small:
            s = self.slices[name]
            b[s, s] += _penalty(name, self.levels[name], taus.get(name))
        for i in range(self.met.shape[1]):
            np.add.at(rhs, self.met[:, i], -cross[:, i] * own / d)
            for j in range(self.met.shape[1]):
                np.add.at(b, (self.met[:, i], self.met[:, j]), -cross[:, i] * cross[:, j] / d)
        small = np.linalg.solve(b, rhs)
        out = {name: small[self.slices[name]] for name in self.small}
        return out | {"series": (own - (cross * small[self.met]).sum(axis=1)) / d}

    def fitted(self, coef: dict[str, np.ndarray]) -> np.ndarray:
        parts = [coef[name][self.codes[name]] * self.values[:, k] for k, name in enumerate(self.small)]
        return sum(parts) + coef["series"][self.codes["series"]]

    def new_taus(self, coef: dict[str, np.ndarray], info: np.ndarray, taus: dict[str, float]) -> dict[str, float]:
        """Mean squared effect (or step) plus its posterior variance."""
        out = {}
        for name, tau in taus.items():
            levels, eff = self.levels[name], coef[name]
            post = 1.0 / (np.bincount(self.codes[name], info, len(levels)) + 1.0 / tau**2)
            if EFFECTS[name][0] == "ridge":
                out[name] = max(LEAST_TAU, float(np.sqrt(np.mean(eff**2 + post))))
            else:
                steps = [i for i in range(1, len(levels)) if levels[i][0] == levels[i - 1][0]]
                d = [(eff[i] - eff[i - 1]) ** 2 + post[i] + post[i - 1] for i in steps]
                out[name] = max(LEAST_TAU, float(np.sqrt(np.mean(d)))) if d else tau
        return out


def fit_level(keys: dict[str, pd.Series], y: np.ndarray, w: np.ndarray) -> Fit:
    system, taus, sigma = System(keys), {n: t for n, (_, t) in EFFECTS.items() if t}, 5.0
    for _ in range(ROUNDS):
        for _ in range(20):
            coef = system.solve(w / sigma**2, y, taus)
            new = float(np.clip(np.sqrt((w * (y - system.fitted(coef)) ** 2).sum() / w.sum()), 0.5, 30.0))
            done, sigma = abs(new - sigma) < 1e-6, new
            if done:
                break
        taus = system.new_taus(coef, w / sigma**2, taus)
    return Fit(system.levels, coef, taus, sigma, system.codes)


def fit_fill(keys: dict[str, pd.Series], y: np.ndarray, w: np.ndarray, alpha: np.ndarray | None = None) -> Fit:
    system, taus = System(keys, alpha), {n: t for n, (_, t) in EFFECTS.items() if t}
    eta = np.zeros(len(y))
    for _ in range(ROUNDS):
        for _ in range(50):
            p = 1.0 / (1.0 + np.exp(-np.clip(eta, -30, 30)))
            h = np.maximum(p * (1 - p), 1e-6)
            coef = system.solve(w * h, eta + (y - p) / h, taus)
            new = np.clip(system.fitted(coef), -30, 30)
            done, eta = np.abs(new - eta).max() < 1e-8, new
            if done:
                break
        taus = system.new_taus(coef, w * h, taus)
    return Fit(system.levels, coef, taus, 1.0, system.codes)


def fill_keys(frame: pd.DataFrame) -> dict[str, pd.Series]:
    return keys_of(frame) | {"late": frame["late"].astype(bool)}


def fit_both(train: pd.DataFrame, halflife: float | None, couple: bool = False) -> tuple[Fit, Fit]:
    newest = train.groupby("county")["year"].transform("max")
    w = np.ones(len(train)) if halflife is None or np.isnan(halflife) else 0.5 ** ((newest - train["year"]) / halflife).to_numpy(float)
    num, keys = (train["state"] == "num").to_numpy(), fill_keys(train)
    moved = np.where(train["late"], train["offset"], 0.0).astype(float)
    level = fit_level(keys_of(train[num]), train.loc[num, "v"].to_numpy(float) - moved[num], w[num])
    alpha = level.effect("school", keys["school"]) if couple else None
    return level, fit_fill(keys, (train["state"] != "open").to_numpy(float), w, alpha)


def predict(fits: tuple[Fit, Fit], rows: pd.DataFrame, year: int) -> tuple[np.ndarray, np.ndarray]:
    """Threshold and fill probability of the usual round; effects that were not seen are 0."""
    keys, out = keys_of(rows), []
    for fit in fits:
        parts = [fit.effect(n, keys[n]) for n in ("mu", "school", "cat", "prog", "series")]
        out.append(sum(parts) + fit.county_effect(rows["county"], year))
    level, fill = fits
    if "late" in fill.levels:
        out[1] = out[1] + fill.effect("late", pd.Series(False, rows.index))
    if "alpha" in fill.levels:
        out[1] = out[1] + fill.coef["alpha"][0] * level.effect("school", keys["school"])
    return out[0], 1.0 / (1.0 + np.exp(-out[1]))


INPUT = [*SERIES, "category", "year", "state", "v", "late", "offset"]


def model_rows(obs: DataFrame, bridge: DataFrame, usual: str = "1") -> DataFrame:
    """``obs`` with ``late`` (its round is not the usual one) and the ``offset`` that the bridge gives such cells."""
    late = F.coalesce(F.col("round") != F.lit(usual), F.lit(False))
    return offsets(obs.withColumn("late", late), bridge).select(*INPUT)


PREDS = (
    "T int, halflife double, county string, school string, program string, category string, state string, v double, m double, pi double, "
    "hist int, sigma double"
)


def walk_forward(rows: DataFrame | fits.Packed, halflives: tuple[float | None, ...] = (4.0,), couple: bool = False) -> DataFrame:
    """Predictions of each year from everything before it, for each half-life; ``rows`` as ``model_rows`` gives them.

    Cells of a later round are not predicted.
    """
    panel = rows if isinstance(rows, fits.Packed) else fits.packed(rows)
    asked = [(t, h, couple) for t in _tested(panel) for h in halflives]
    made = [(t, h, fold) for (t, h, _), fold in zip(asked, fits.fitted(panel, asked)) if fold]

    def fold_rows(chunk: fits.Chunk):
        for t, halflife, fold in made:
            at = np.flatnonzero((chunk.year == t) & ~chunk.late)
            if not len(at):
                continue
            kind, series = chunk.kind[at], chunk.series[at]
            m, pi = fits.predicted(chunk, fold, kind, series, t)
            yield fits.named(chunk, series, kind) | _tried(chunk, fold, at, t) | {"halflife": np.full(len(at), np.nan if halflife is None else halflife), "m": m, "pi": pi}

    return fits.emitted(panel, PREDS, fold_rows)


def _tested(panel: fits.Packed) -> list[int]:
    """The years that are predicted: those of cells of the usual round, but the first of all."""
    tested = sorted(panel.counts.loc[~panel.counts["late"], "year"].unique())
    return [int(y) for y in tested if y > panel.counts["year"].min()]


def _tried(chunk: fits.Chunk, fold: fits.Fold, at: np.ndarray, year: int) -> dict:
    """What is known of the cells that are predicted, and the residual's spread."""
    hist = np.bincount(chunk.series[(chunk.state == 0) & (chunk.year < year)], minlength=chunk.nt)[chunk.series[at]]
    state = fits.words(chunk.state[at], list(fits.STATES))
    return {"T": np.full(len(at), year), "state": state, "v": chunk.z[at], "hist": hist, "sigma": np.full(len(at), fold.level.residual)}


def halflife_errors(rows: DataFrame | fits.Packed, years: tuple[int, ...], halflives: tuple[float | None, ...] = HALFLIVES) -> tuple[DataFrame, list]:
    """(halflife, rmse, n) over the predictions of ``years``, the best first, and the folds; only the level is fitted for it.

    Squared errors are summed where the cells lie, so no prediction is written.
    """
    panel = rows if isinstance(rows, fits.Packed) else fits.packed(rows)
    asked = [(t, h, False) for t in _tested(panel) if t in years for h in halflives]
    folds = fits.fitted(panel, asked, fill=False)
    made = [(t, h, fold) for (t, h, _), fold in zip(asked, folds) if fold]

    def errors(chunk: fits.Chunk):
        for t, halflife, fold in made:
            at = np.flatnonzero((chunk.year == t) & ~chunk.late & (chunk.state == 0))
            if len(at):
                e = chunk.z[at] - fits.expected(chunk, fold, chunk.kind[at], chunk.series[at], t)
                yield {"halflife": [halflife], "squares": [e @ e], "n": [len(at)]}

    sums = fits.emitted(panel, "halflife double, squares double, n long", errors).groupBy("halflife")
    return _best_first(sums.agg(F.sqrt(F.sum("squares") / F.sum("n")).alias("rmse"), F.sum("n").alias("n"))), folds


def _best_first(found: DataFrame) -> DataFrame:
    """Of equals the one tried first."""
    return found.orderBy(F.round("rmse", 6), F.coalesce(F.col("halflife"), F.lit(1e9)))


def best_halflife(preds: DataFrame) -> DataFrame:
    """One row for each half-life with its error, the best first; of equals the one tried first."""
    e = F.col("v") - F.col("m")
    return _best_first(preds.where("state = 'num'").groupBy("halflife").agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n")))


def newton(sums, rounds: int = 50) -> tuple[float, float]:
    """(a, b) at which the log-loss of a + b x is least; ``sums(a, b)`` gives the sums of y - p, x (y - p), q, q x, q x x
    with q = p (1 - p)."""
    ab = np.array([0.0, 1.0])
    for _ in range(rounds):
        g0, g1, h0, h1, h2 = sums(*ab)
        step = np.linalg.solve(np.array([[h0, h1], [h1, h2]]) + 1e-9 * np.eye(2), np.array([g0, g1]))
        ab = ab + step
        if np.abs(step).max() < 1e-8:
            break
    return float(ab[0]), float(ab[1])


def platt(pi: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) of logit p' = a + b logit p."""
    x = np.log(np.maximum(pi, 1e-6) / np.maximum(1 - pi, 1e-6))

    def sums(a: float, b: float) -> tuple:
        p = 1.0 / (1.0 + np.exp(-(a + b * x)))
        q = p * (1 - p)
        return (y - p).sum(), (x * (y - p)).sum(), q.sum(), (q * x).sum(), (q * x * x).sum()

    return newton(sums)


def platt_table(preds: DataFrame) -> tuple[float, float]:
    """The same over a table with pi and state: each step is one aggregation."""
    rows = preds.select(logit(F.col("pi")).alias("x"), (F.col("state") != "open").cast("double").alias("y"))

    def sums(a: float, b: float) -> tuple:
        p = expit(F.lit(float(a)) + F.lit(float(b)) * F.col("x"))
        terms = rows.select("x", (F.col("y") - p).alias("g"), (p * (1 - p)).alias("q"))
        return tuple(x or 0.0 for x in terms.agg(*[F.sum(F.expr(e)) for e in ("g", "x * g", "q", "q * x", "q * x * x")]).first())

    return newton(sums)


def recalibrated(pi: Column, a: float, b: float) -> Column:
    return expit(F.lit(a) + F.lit(b) * logit(pi))


def fill_loss(preds: DataFrame, a: float, b: float) -> float:
    y, q = (F.col("state") != "open").cast("double"), F.least(F.greatest(recalibrated(F.col("pi"), a, b), F.lit(1e-6)), F.lit(1 - 1e-6))
    return preds.agg(-F.avg(y * F.ln(q) + (1 - y) * F.ln(1 - q))).first()[0]


@dataclass
class Choice:
    """What the backtest decides: half-life, coupling, recalibration, and the predictions it was decided on (without names)."""

    halflife: float | None
    couple: bool
    a: float
    b: float
    preds: DataFrame | None
    losses: tuple[float, float] | None = None


#: What the quick path takes without a backtest; its spreads are 1.25 times the residual's.
QUICK = Choice(2.5, True, 0.0, 1.0, None)
QUICK_SPREAD = 1.25


BOTH = "T int, state string, v double, m double, pi double, coupled double, hist int, sigma double"


def choose(rows: DataFrame | fits.Packed, calibration: tuple[int, ...]) -> Choice:
    """The half-life with the least error on the calibration years; coupled if that lowers their recalibrated log-loss.

    The half-life is chosen by the level alone; the fill part is fitted for the chosen one, with and without coupling, which
    share the level and their predictions' rows.
    """
    within = F.col("T").isin(*calibration)
    panel = rows if isinstance(rows, fits.Packed) else fits.packed(rows)
    errors, known = halflife_errors(panel, calibration)
    best = errors.first()
    halflife = best["halflife"] if best else 4.0
    years = _tested(panel)
    folds = fits.fitted(panel, [(t, halflife, couple) for couple in (False, True) for t in years], known=known)
    made = [(t, *pair) for t, *pair in zip(years, folds[: len(years)], folds[len(years) :]) if pair[0]]

    def both(chunk: fits.Chunk):
        for t, plain, coupled in made:
            at = np.flatnonzero((chunk.year == t) & ~chunk.late)
            if len(at):
                kind, series = chunk.kind[at], chunk.series[at]
                m, pi = fits.predicted(chunk, plain, kind, series, t)
                yield _tried(chunk, plain, at, t) | {"m": m, "pi": pi, "coupled": fits.predicted(chunk, coupled, kind, series, t)[1]}

    found = stored(fits.emitted(panel, BOTH, both), "walk-forward").withColumn("halflife", F.lit(halflife).cast("double"))
    preds = [found.drop("coupled"), found.withColumn("pi", F.col("coupled")).drop("coupled")]
    lines = [platt_table(p.where(within)) for p in preds]
    losses = tuple(fill_loss(p.where(within), *ab) for p, ab in zip(preds, lines))
    use = None not in losses and losses[1] < losses[0]
    return Choice(halflife, use, *lines[use], preds[use], losses)


EFFECT_ROWS = "part string, effect string, level string, value double, tau double"


def effects(obs: DataFrame, halflife: float | None = 4.0, couple: bool = False) -> DataFrame:
    """The coefficients of a fit on all years."""

    panel = fits.packed(obs)
    space, (fold,) = panel.space, fits.fitted(panel, [(None, halflife, couple)])
    names = {"mu": ["0"], "cat": space.cats, "prog": space.progs, "late": ["False", "True"], "alpha": ["0"]}
    names["cy"] = [str((c, y)) for c in space.counties for y in space.years]
    shared = []
    for label, part in (("level", fold.level), ("fill", fold.fill)):
        for name, s in space.slices.items():
            for level, b, seen in zip(names[name], part.b[s], part.seen[s]):
                if seen:
                    shared.append((label, name, level, float(b), part.out.get(name)))

    def own(chunk: fits.Chunk):
        full = [space.counties[chunk.county] + "|" + s for s in chunk.schools]
        series = [full[o] + "|" + space.progs[p] for o, p in zip(chunk.owner, chunk.series_prog)]
        learned = np.unique(chunk.series[chunk.state == 0])
        for label, part, (school, one), met in (
            ("level", fold.level, chunk.level_effects(fold), learned),
            ("fill", fold.fill, chunk.fill_effects(fold, chunk.alpha(fold))[:2], np.arange(chunk.nt)),
        ):
            held = np.unique(chunk.owner[met])
            for name, at, levels, value in (("school", held, full, school), ("series", met, series, one)):
                same = {c: fits.words(np.zeros(len(at)), [x]) for c, x in (("part", label), ("effect", name))}
                yield same | {"level": fits.words(at, levels), "value": value[at], "tau": np.full(len(at), part.out[name])}

    return obs.sparkSession.createDataFrame(shared, EFFECT_ROWS).unionByName(fits.emitted(panel, EFFECT_ROWS, own))


FORECASTS = "county string, school string, program string, category string, year int, m double, pi double, hist int, sigma double"


def forecasts(rows: DataFrame | fits.Packed, choice: Choice, spread: DataFrame | None = None) -> DataFrame:
    """Next year's threshold and fill probability of every series that is still alive, with the spread of its bucket.

    Without ``spread`` (the quick path) it is 1.25 times the residual's.
    """
    halflife, couple = choice.halflife, choice.couple

    panel = rows if isinstance(rows, fits.Packed) else fits.packed(rows)
    (fold,) = fits.fitted(panel, [(None, halflife, couple)])

    def ahead(chunk: fits.Chunk):
        # a series' cells of a category are a stretch, as kinds are numbered by programme and category
        category = chunk.space.kinds[chunk.kind, 0]
        key = np.stack([chunk.series, category])
        at = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(axis=0)])
        last, hist = np.maximum.reduceat(chunk.year, at), np.add.reduceat((chunk.state == 0).astype(int), at)
        next_year = int(fold.newest[chunk.county]) + 1
        alive = last >= next_year - 2
        kind, series = chunk.kind[at[alive]], chunk.series[at[alive]]
        m, pi = fits.predicted(chunk, fold, kind, series, next_year)
        same = {"year": np.full(len(kind), next_year), "sigma": np.full(len(kind), fold.level.residual)}
        yield fits.named(chunk, series, kind) | same | {"m": m, "pi": pi, "hist": hist[alive]}

    made = fits.emitted(panel, FORECASTS, ahead)
    made = made.withColumn("pi", recalibrated(F.col("pi"), choice.a, choice.b))
    if spread is None:
        return made.withColumn("s", F.col("sigma") * QUICK_SPREAD).drop("sigma")
    spread = spread.select(F.col("bucket").alias("of"), "s")
    return made.join(spread, history_bucket(F.col("hist")) == F.col("of")).drop("of", "sigma")
