"""The two-part model's fit over panels of any size, the same estimates as ``model.fit_both`` gives.

Every series belongs to one school and every school to one county, so series and then schools are eliminated where their
observations lie. What is left is a system of the mean, categories, programmes and county-years, which has a few dozen
unknowns whatever the number of schools. The panel is written once with one row a school (``packed``); a pass over it gives
each fold's system as a sum over schools, which Spark adds up by (fold, county), and the driver solves. All folds and
half-lives share a pass, and folds that differ in the coupling only share the fit of the level. The sums are quadratic forms of
the solution, so one pass also gives the residual and the squared effects that the spreads follow from.

A series meets one programme, so its products are taken over years and the like only, summed by programme, and spread over the
shared levels once a task. Cells lie in planes of one year each, a number a series, so no row is looked up in a pass.

In the fill part, schools and series are brought to their optimum for the given other effects within a pass, so that a step
of the others is a Newton step of the whole and no state of a school is kept between passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.plans.stored import stored

ROWS = 20_000  # of observations that are worked on at once
STATES = ("num", "zero", "open")
FREE, ROUNDS, LEAST_TAU = 1e-6, 3, 0.3
FIRST = {"school": 4.0, "prog": 3.0, "series": 3.0, "cy": 1.0}


@dataclass
class Space:
    """The levels that all schools share, and each kind of cell (category, programme, county, year, late) in them.

    A county's vector is mu, categories, programmes, its years, the usual round and the late one, alpha; the whole one has the
    years of every county.
    """

    cats: list
    progs: list
    counties: list
    years: list
    kinds: np.ndarray  # the five codes of each kind

    def __post_init__(self):
        nc, np_, ny = len(self.cats), len(self.progs), len(self.years)
        self.g, self.p = 1 + nc + np_ + ny + 3, 1 + nc + np_ + ny * len(self.counties) + 3
        c, k = self.kinds, 1 + nc + np_
        self.columns = np.stack([np.zeros(len(c), int), 1 + c[:, 0], 1 + nc + c[:, 1], k + c[:, 3], k + ny + c[:, 4]], axis=1)
        self.year_of, self.late_of = np.array(self.years)[c[:, 3]], c[:, 4].astype(bool)
        cy = slice(k, k + ny * len(self.counties))
        self.slices = {"mu": slice(0, 1), "cat": slice(1, 1 + nc), "prog": slice(1 + nc, k), "cy": cy, "late": slice(cy.stop, cy.stop + 2)}
        self.slices["alpha"] = slice(cy.stop + 2, cy.stop + 3)
        # each programme's categories, numbered within it: place of a kind's category, and a table of them for each place
        met = np.unique(c[:, [1, 0]], axis=0)
        place = np.arange(len(met)) - np.searchsorted(met[:, 0], met[:, 0])
        found = np.searchsorted(met[:, 0] * nc + met[:, 1], c[:, 1] * nc + c[:, 0])
        self.place = place[found] if len(c) else np.zeros(0, int)
        self.cat_of = np.zeros((int(place.max(initial=0)) + 1, np_, nc))
        self.cat_of[place, met[:, 0], met[:, 1]] = 1.0

    def years_before(self, until: int | None) -> int:
        return len(self.years) if until is None else int(np.searchsorted(self.years, until))

    def spread(self, until: int | None, which: str, couple: bool) -> np.ndarray:
        """Of each programme, what a series' own columns are among a county's: categories' weights, years, (late,) (alpha,) value."""
        n, ny, fill = len(self.cat_of), self.years_before(until), which == "fill"
        k = 1 + len(self.cats) + len(self.progs)
        out = np.zeros((len(self.progs), n + ny + fill + couple * fill + 1, self.g + 1))
        for i in range(n):
            out[:, i, 0] = 1.0
            out[:, i, 1 : 1 + len(self.cats)] = self.cat_of[i]
            out[:, i, 1 + len(self.cats) : k] = np.eye(len(self.progs))
            out[:, i, k + len(self.years)] = fill
        out[:, np.arange(n, n + ny), k + np.arange(ny)] = 1.0
        if fill:
            out[:, n + ny, k + len(self.years) : k + len(self.years) + 2] = -1.0, 1.0
        if fill and couple:
            out[:, n + ny + 1, self.g - 1] = 1.0
        out[:, -1, self.g] = 1.0
        return out

    def whole(self, county: int) -> np.ndarray:
        """The place of each entry of a county's vector in the whole one."""
        cy, ny = self.slices["cy"], len(self.years)
        return np.r_[0 : cy.start, cy.start + county * ny : cy.start + (county + 1) * ny, cy.stop : self.p]


@dataclass
class Part:
    """Where the fit of a part stands; ``b`` belongs to ``sigma`` and ``taus``, ``out`` are the spreads that follow from it."""

    b: np.ndarray
    taus: dict
    sigma: float = 1.0
    seen: np.ndarray | None = None
    round: int = 0
    turn: int = 0
    done: bool = False
    out: dict = field(default_factory=dict)
    residual: float = 1.0
    last: tuple | None = None  # the spread before and the residual it gave, and how steeply residuals follow spreads
    slope: float | None = None


@dataclass
class Fold:
    """A fit on all years before ``until`` (all, if null)."""

    until: int | None
    halflife: float | None
    couple: bool
    newest: np.ndarray  # the last year of each county that it learns from
    level: Part
    fill: Part

    def effect(self, part: Part, space: Space, year: int) -> np.ndarray:
        """Each county's newest fitted year up to ``year``."""
        cy, ny = space.slices["cy"], len(space.years)
        out = np.zeros(len(space.counties))
        for c in range(len(out)):
            for i, y in enumerate(space.years):
                if y <= year and part.seen[cy.start + c * ny + i]:
                    out[c] = part.b[cy.start + c * ny + i]
        return out


@dataclass
class Packed:
    rows: DataFrame
    space: Space
    counts: pd.DataFrame  # of each kind: county, year, late, n, n_num, and its numbers' sum and sum of squares


def packed(rows: DataFrame) -> Packed:
    """``rows`` (as ``model.model_rows`` gives them) with one row a school; the kinds, programmes times county-years, are collected."""
    keys = ["program", "category", "county", "year", "late"]
    late = F.coalesce(F.col("late").cast("boolean"), F.lit(False))
    moved = F.col("v").cast("double") - F.when(late, F.col("offset").cast("double")).otherwise(0.0)
    rows = rows.withColumns({"late": late, "z": moved})
    is_num = F.col("state") == "num"
    sums = [F.count(F.lit(1)).alias("n"), F.count_if(is_num).alias("n_num")]
    sums += [F.coalesce(F.sum(F.when(is_num, x)), F.lit(0.0)).alias(name) for name, x in (("sum", F.col("z")), ("squares", F.col("z") * F.col("z")))]
    kinds = rows.groupBy(*keys).agg(*sums).toPandas().sort_values(keys, ignore_index=True)
    levels = {c: sorted(kinds[c].unique()) for c in ("category", "program", "county", "year")}
    codes = [np.searchsorted(np.array(levels[c], dtype=object), kinds[c].to_numpy(object)) for c in ("category", "program", "county", "year")]
    space = Space(*[[x.item() if hasattr(x, "item") else x for x in levels[c]] for c in levels], np.stack([*codes, kinds["late"].to_numpy(int)], axis=1).astype(int))
    spark = rows.sparkSession
    known = spark.createDataFrame(kinds[keys].assign(kind=np.arange(len(kinds))).astype({"year": int}), "program string, category string, county string, year int, late boolean, kind int")
    state = F.when(is_num, 0).when(F.col("state") == "zero", 1).otherwise(2)
    cell = F.struct("kind", state.cast("int").alias("state"), "z")
    n = int(kinds["n"].sum())
    tasks = max(1, min(n // 50_000 + 1, 4 * spark.sparkContext.defaultParallelism))
    # kinds are numbered by programme, so a school's series are stretches of its sorted cells
    schools = rows.join(F.broadcast(known), keys).groupBy("county", "school").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return Packed(stored(schools.repartitionByRange(tasks, "county", "school"), "packed"), space, kinds.assign(county=codes[2]))


class Chunk:
    """The cells of some schools of one county, by school and series; series are in the order of programmes and schools."""

    def __init__(self, space: Space, county: int, schools: list, sizes: np.ndarray, kind: np.ndarray, state: np.ndarray, z: np.ndarray):
        self.space, self.county, self.schools, self.kind, self.state, self.z = space, county, schools, kind, state, z
        school, n = np.repeat(np.arange(len(sizes)), sizes), len(space.progs)
        pair = school * n + space.kinds[kind, 1]
        new = np.r_[True, pair[1:] != pair[:-1]]
        keys = pair[new]
        order = np.argsort(keys % n, kind="stable")
        place = np.empty(len(order), int)
        place[order] = np.arange(len(order))
        self.series = place[np.cumsum(new) - 1]
        self.owner, self.series_prog = (keys // n)[order], (keys % n)[order]
        self.nt, self.ns = len(keys), len(sizes)
        self.year, self.late = space.year_of[kind], space.late_of[kind]
        self.cut = np.searchsorted(self.series_prog, np.arange(n + 1))
        self.full = self.nt == self.ns * np.count_nonzero(np.diff(self.cut))
        # cells: what a series has of a kind; planes: each has at most one cell a series, all of one year
        at = np.flatnonzero(new | np.r_[True, kind[1:] != kind[:-1]])
        sums = [np.add.reduceat(x, at) for x in ((state == 0).astype(float), np.where(state == 0, z, 0.0), (state != 2).astype(float), np.ones(len(kind)))]
        series, kinds = self.series[at], kind[at]
        key = series * len(space.years) + space.kinds[kinds, 3]
        turn = np.zeros(len(at), int)
        if np.bincount(key).max() > 1:
            order = np.argsort(key, kind="stable")
            turn[order] = np.arange(len(at)) - np.searchsorted(key[order], key[order])
        turns = int(turn.max()) + 1
        slots, plane = np.unique(space.kinds[kinds, 3] * turns + turn, return_inverse=True)
        self.plane_year = slots // turns
        places, shape = plane * self.nt + series, (len(slots), self.nt)

        def laid(x: np.ndarray) -> np.ndarray:
            out = np.zeros(shape, x.dtype)
            out.ravel()[places] = x
            return out

        self.kinds, (self.nums, self.sum, self.filled, self.all) = laid(kinds), map(laid, sums)
        self.is_late = laid(space.late_of[kinds].astype(float))
        self.near = None

    def weights(self, fold: Fold) -> np.ndarray:
        """Of the planes that a fold learns from."""
        years = np.array(self.space.years)[self.plane_year[: np.searchsorted(self.plane_year, self.space.years_before(fold.until))]]
        return np.ones(len(years)) if fold.halflife is None else 0.5 ** ((fold.newest[self.county] - years) / fold.halflife)

    def shared(self, part: Part, late: bool) -> np.ndarray:
        """What the other effects give for each kind (of this county; 0 of the others)."""
        b, mine = part.b[self.space.whole(self.county)], self.space.kinds[:, 2] == self.county
        return np.where(mine, b[self.space.columns[:, : 5 if late else 4]].sum(axis=1), 0.0)

    def by_school(self, x: np.ndarray) -> np.ndarray:
        if self.full:
            return x.reshape(*x.shape[:-1], -1, self.ns).sum(axis=-2)
        return np.bincount(self.owner, x, self.ns) if x.ndim == 1 else np.stack([np.bincount(self.owner, y, self.ns) for y in x])

    def level_effects(self, fold: Fold) -> tuple[np.ndarray, np.ndarray]:
        """Of schools and series, given the other effects; 0 of those without a number."""
        w = self.weights(fold) / fold.level.sigma**2
        n, taus = len(w), fold.level.taus
        q = w @ (self.sum[:n] - self.nums[:n] * self.shared(fold.level, False)[self.kinds[:n]])
        weight = w @ self.nums[:n]
        d = weight + 1 / taus["series"] ** 2
        left = 1 - weight / d
        school = self.by_school(q * left) / (self.by_school(weight * left) + 1 / taus["school"] ** 2)
        return school, (q - weight * school[self.owner]) / d

    def alpha(self, fold: Fold) -> np.ndarray:
        return self.level_effects(fold)[0] if fold.couple else np.zeros(self.ns)

    def fill_effects(self, fold: Fold, alpha: np.ndarray) -> tuple:
        """Schools and series at their optimum given the other effects; weights and weighted working responses there.

        A step that changes no logit by more than 1.5 never makes the loss larger, whatever the weights (its third derivative
        is at most the second), so longer steps are cut to that.
        """
        w, part = self.weights(fold), fold.fill
        n, owner = len(w), self.owner
        a, b = 1 / part.taus["school"] ** 2, 1 / part.taus["series"] ** 2
        fixed = self.shared(part, True)[self.kinds[:n]]
        own = part.b[-1] * alpha[owner] if fold.couple else 0.0
        odds, most = np.exp(-fixed), np.abs(fixed).max(initial=0)
        weight, filled = w[:, None] * self.all[:n], w @ self.filled[:n]
        school, series = self.near or (np.zeros(self.ns), np.zeros(self.nt))
        p, wp, h = np.empty((3, n, self.nt))
        for turn in range(200):
            s = own + school[owner] + series
            np.multiply(odds, np.exp(-s), out=p)
            far = most + np.abs(s).max(initial=0)
            if far > 30:
                np.clip(p, np.exp(-30.0), np.exp(30.0), out=p)
            p += 1.0
            np.reciprocal(p, out=p)
            np.multiply(weight, p, out=wp)
            if far > 13:
                np.multiply(weight, np.maximum(p * (1 - p), 1e-6), out=h)
            else:
                np.multiply(wp, p, out=h)
                np.subtract(wp, h, out=h)
            info, pull = h.sum(axis=0), filled - wp.sum(axis=0)
            d, pulled = info + b, pull - b * series
            left = info / d
            move = (self.by_school(pull - left * pulled) - a * school) / (self.by_school(info - info * left) + a)
            push = (pulled - info * move[owner]) / d
            size = np.abs(move[owner] + push)
            if size.max(initial=0) > 1.5:
                longest = np.ones(self.ns)
                np.maximum.at(longest, owner, size / 1.5)
                move, push = move / longest, push / longest[owner]
            school, series = school + move, series + push
            if max(np.abs(move).max(initial=0), np.abs(push).max(initial=0)) < 1e-6:
                break
        self.near = school, series
        eta = fixed + s
        if far > 30:
            np.clip(eta, -30, 30, out=eta)
        return school, series, h, h * eta + w[:, None] * self.filled[:n] - wp

    def own_columns(self, fold: Fold, x: np.ndarray, *others: np.ndarray) -> np.ndarray:
        """Of each series the weights of its categories and its years, from those of its planes, and ``others``."""
        n, ny = len(self.space.cat_of), self.space.years_before(fold.until)
        out = np.zeros((n + ny + len(others), self.nt))
        if n == 1:
            x.sum(axis=0, out=out[0])
        else:
            place = self.space.place[self.kinds[: len(x)]]
            for i in range(n):
                out[i] = np.where(place == i, x, 0.0).sum(axis=0)
        for plane, year in zip(x, self.plane_year):
            out[n + year] += plane
        for i, other in enumerate(others):
            out[n + ny + i] = other
        return out

    def level_sums(self, fold: Fold, into: Sums) -> None:
        w = self.weights(fold) / fold.level.sigma**2
        x = w[:, None] * self.nums[: len(w)]
        self.eliminated(self.own_columns(fold, x, w @ self.sum[: len(w)]), x.sum(axis=0), fold.level, into)

    def fill_sums(self, fold: Fold, into: Sums) -> None:
        alpha = self.alpha(fold)
        _, _, x, z = self.fill_effects(fold, alpha)
        kinds, n = self.kinds[: len(x)].ravel(), len(self.space.kinds)
        into.kinds[0] += np.bincount(kinds, x.ravel(), n)
        into.kinds[1] += np.bincount(kinds, z.ravel(), n)
        weight, value = x.sum(axis=0), z.sum(axis=0)
        others = [(x * self.is_late[: len(x)]).sum(axis=0)]
        if fold.couple:
            others.append(alpha[self.owner] * weight)
            into.kinds[2] += np.bincount(kinds, (x * alpha[self.owner]).ravel(), n)
            into.covariate += (alpha[self.owner] ** 2 * weight).sum(), (alpha[self.owner] * value).sum()
            into.post[4] = max(into.post[4], np.abs(alpha).max(initial=0))
        self.eliminated(self.own_columns(fold, x, *others, value), weight, fold.fill, into)

    def eliminated(self, v: np.ndarray, weight: np.ndarray, part: Part, into: Sums) -> None:
        """Series, then schools: what they take of the system, the residual, squared effects of series and of schools."""
        inv = 1 / (weight + 1 / part.taus["series"] ** 2)
        left = 1 - weight * inv
        by = [inv, inv**2] + ([weight * inv**2 - 2 * inv] if into.level else [])
        scaled = v * np.stack(by)[:, None, :]
        for p, (i, j) in enumerate(zip(self.cut[:-1], self.cut[1:])):
            if i < j:
                into.own[p] += scaled[:, :, i:j] @ v[:, i:j].T
        n_s, o_s, held, ds = self.by_school(np.stack([weight * left**2, (weight * inv) ** 2, weight, weight * left]))
        ds = 1 / (ds + 1 / part.taus["school"] ** 2)[:, None]
        e, share = self.met(v, left, into), self.met(v, weight * inv**2, into)
        into.schools[0] += e.T @ (e * ds)
        into.schools[1] += e.T @ (e * (o_s[:, None] * ds**2) - 2 * share * ds)
        into.schools[-1] += e.T @ (e * ds**2)
        if into.level:
            into.schools[2] += e.T @ (e * (n_s[:, None] * ds**2 - 2 * ds) + 2 * self.met(v, weight * left * inv, into) * ds)
        met, seen = weight > 0, held > 0
        into.post[:4] += seen.sum(), (1 / (held[seen] + 1 / part.taus["school"] ** 2)).sum(), met.sum(), inv[met].sum()

    def met(self, v: np.ndarray, by: np.ndarray, into: Sums) -> np.ndarray:
        """The columns of each school, its series' ones times ``by``."""
        n, progs = len(self.space.cat_of), len(self.space.progs)
        v = v * by
        first = np.zeros((n, self.ns, progs))
        first[:, self.owner, self.series_prog] = v[:n]
        return sum(x @ t for x, t in zip(first, into.first)) + self.by_school(v[n:]).T @ into.rest


class Sums:
    """What a task adds up of a fold in a county: forms in a series' own columns by programme, and forms of schools."""

    def __init__(self, space: Space, fold: Fold, which: str):
        self.space, self.level = space, which == "level"
        self.to = space.spread(fold.until, which, fold.couple)
        n, m, g = len(space.cat_of), self.to.shape[1], space.g + 1
        self.first, self.rest = [self.to[:, i] for i in range(n)], self.to[0, n:]
        self.own, self.schools = np.zeros((len(space.progs), 2 + self.level, m, m)), np.zeros((3 + self.level, g, g))
        self.kinds, self.covariate, self.post = np.zeros((3, len(space.kinds))), np.zeros(2), np.zeros(5)

    def flat(self, county: int) -> np.ndarray:
        """The forms of what is taken, of series, (of the residual,) of schools; the kinds' sums; the covariate's; the counts."""
        forms = self.schools
        to = self.to[:, None]
        forms[:-1] += (to.swapaxes(2, 3) @ self.own @ to).sum(axis=0)
        kinds = self.kinds[:, self.space.kinds[:, 2] == county]
        return np.concatenate([forms.ravel(), kinds.ravel(), self.covariate, self.post])


def chunks(space: Space, batch: pa.RecordBatch):
    county, school, cells = batch.column("county").to_pylist(), batch.column("school").to_pylist(), batch.column("cells")
    at = cells.offsets.to_numpy().astype(np.int64)
    flat = cells.values
    kind, state = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "state"))
    z = flat.field("z").to_numpy(zero_copy_only=False).astype(float)
    i = 0
    while i < len(county):
        j = i + 1
        while j < len(county) and county[j] == county[i] and at[j + 1] - at[i] <= ROWS:
            j += 1
        s = slice(at[i], at[j])
        yield Chunk(space, space.counties.index(county[i]), school[i:j], np.diff(at[i : j + 1]), kind[s], state[s], z[s])
        i = j


SUMS = "fold int, county int, sums binary"


def _pass(panel: Packed, folds: dict[int, tuple[Fold, str]]) -> dict[int, tuple]:
    """Of each fold the forms over the whole vector, and the counts."""
    space = panel.space

    def task(batches):
        found: dict[tuple[int, int], Sums] = {}
        for batch in batches:
            for chunk in chunks(space, batch):
                for k, (fold, which) in folds.items():
                    into = found.get((k, chunk.county))
                    if into is None:
                        into = found[k, chunk.county] = Sums(space, fold, which)
                    (chunk.level_sums if which == "level" else chunk.fill_sums)(fold, into)
        keys = list(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([found[k].flat(k[1]).tobytes() for k in keys], pa.binary())],
            ["fold", "county", "sums"],
        )

    def total(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(s) for s in frame["sums"]]
        out = sum(parts)
        out[-1] = max(p[-1] for p in parts)
        return pd.DataFrame({"fold": frame["fold"].iloc[:1], "county": frame["county"].iloc[:1], "sums": [out.tobytes()]})

    g1, p1 = space.g + 1, space.p + 1
    found = {k: (np.zeros((3 + (which == "level"), p1, p1)), np.zeros((3, len(space.kinds))), np.zeros(2), np.zeros(5)) for k, (_, which) in folds.items()}
    for row in panel.rows.mapInArrow(task, SUMS).groupBy("fold", "county").applyInPandas(total, SUMS).collect():
        got, (forms, kinds, covariate, post) = np.frombuffer(row.sums), found[row.fold]
        at, n = np.r_[space.whole(row.county), space.p], len(forms) * g1 * g1
        forms[:, at[:, None], at] += got[:n].reshape(-1, g1, g1)
        kinds[:, space.kinds[:, 2] == row.county] += got[n:-7].reshape(3, -1)
        covariate += got[-7:-5]
        post[:4] += got[-5:-1]
        post[4] = max(post[4], got[-1])
    out = {}
    for k, (fold, which) in folds.items():
        forms, kinds, covariate, post = found[k]
        whole = _whole(panel, fold, which, kinds, covariate)
        taken, series, *residual, schools = forms
        out[k] = (whole, whole - taken, whole + residual[0] if residual else None, schools, series), post
    return out


def _cells(space: Space, late: bool) -> np.ndarray:
    """The columns of each kind in the whole vector, but alpha."""
    x = np.zeros((len(space.kinds), space.p))
    np.put_along_axis(x, np.stack([space.whole(c)[row] for c, row in zip(space.kinds[:, 2], space.columns[:, : 5 if late else 4])]), 1.0, axis=1)
    return x


def _whole(panel: Packed, fold: Fold, which: str, kinds: np.ndarray, covariate: np.ndarray) -> np.ndarray:
    """The system before anything is eliminated, with the response last; that of the level follows from counts and sums of kinds."""
    space, p = panel.space, panel.space.p
    if which == "level":
        year = space.year_of
        w = np.ones(len(year)) if fold.halflife is None else 0.5 ** ((fold.newest[space.kinds[:, 2]] - year) / fold.halflife)
        w = np.where(year < fold.until, w, 0.0) if fold.until is not None else w
        n, value, squares = (panel.counts[c].to_numpy(float) * w / fold.level.sigma**2 for c in ("n_num", "sum", "squares"))
        last = squares.sum()
    else:
        (n, value, _), last = kinds, 0.0  # the last is not asked for
    x, out = _cells(space, which != "level"), np.zeros((p + 1, p + 1))
    out[:p, :p] = x.T @ (n[:, None] * x)
    out[:p, p] = out[p, :p] = x.T @ value
    out[p, p] = last
    if which != "level" and fold.couple:
        out[:p, p - 1] += x.T @ kinds[2]
        out[p - 1, :p] = out[:p, p - 1]
        out[p - 1, p - 1] = covariate[0]
        out[p, p - 1] = out[p - 1, p] = covariate[1]
    return out


def _penalty(space: Space, seen: np.ndarray, taus: dict) -> np.ndarray:
    out, cy = np.diag(np.full(space.p, FREE)), space.slices["cy"]
    out[space.slices["prog"], space.slices["prog"]] = np.eye(len(space.progs)) / taus["prog"] ** 2
    out[cy, cy] = np.eye(cy.stop - cy.start) * 1e-4
    for i, j in _steps(space, seen):
        out[[i, j], [i, j]] += 1 / taus["cy"] ** 2
        out[[i, j], [j, i]] -= 1 / taus["cy"] ** 2
    return out


def _steps(space: Space, seen: np.ndarray) -> list[tuple[int, int]]:
    """Neighbouring fitted years of a county."""
    start, ny = space.slices["cy"].start, len(space.years)
    found = []
    for c in range(len(space.counties)):
        fitted = [i for i in range(start + c * ny, start + (c + 1) * ny) if seen[i]]
        found += zip(fitted[:-1], fitted[1:])
    return found


def _advance(space: Space, part: Part, which: str, forms: np.ndarray, post: np.ndarray) -> None:
    """Solve the system of a pass and say what the next one is to be made with."""
    whole, reduced, rss, schools, series = forms
    part.seen = seen = np.diag(whole)[:-1] > 0
    at = np.flatnonzero(seen)
    system = reduced[:-1, :-1] + _penalty(space, seen, part.taus)
    b = np.zeros(space.p)
    b[at] = np.linalg.solve(system[np.ix_(at, at)], reduced[at, -1])
    part.turn += 1
    if which == "level":
        v = np.r_[-b, 1]
        new = float(np.clip(np.sqrt(max(v @ rss @ v, 0) / whole[0, 0]), 0.5, 30.0))
        settled, limit = abs(new - part.sigma) < 1e-6, 20
        if part.last and abs(part.sigma - part.last[0]) > 1e-9:
            part.slope = (new - part.last[1]) / (part.sigma - part.last[0])
        part.b, part.residual, part.last = b, new, (part.sigma, new)
    else:
        step = b - part.b
        x = _cells(space, True)
        x = x[(x[:, ~seen] == 0).all(axis=1)]
        most = np.abs(x @ step).max(initial=0) + abs(step[-1]) * post[4]
        settled, limit = most < 1e-5, 50  # after a Newton step this small, the next one would be of its square
        part.b = part.b + step * min(1.0, 5 / max(most, 1e-9))
    if not (settled or part.turn >= limit):
        if which == "level":
            # where residuals follow spreads slowly, straight to where they meet; 20 plain turns would end there, too
            gain = 1 / (1 - part.slope) if part.slope is not None and 0 <= part.slope <= 0.4 else 1.0
            part.sigma = float(np.clip(part.sigma + (part.residual - part.sigma) * gain, 0.5, 30.0))
        return
    v, info, out = np.r_[-part.b, 1], np.diag(whole), {}
    for name, form, n, var in (("school", schools, *post[:2]), ("series", series, *post[2:4])):
        out[name] = max(LEAST_TAU, float(np.sqrt((v @ form @ v + var) / n)))
    var = {n: 1 / (info[:-1] + 1 / part.taus[n] ** 2) for n in ("prog", "cy")}
    prog = [i for i in range(*space.slices["prog"].indices(space.p)) if seen[i]]
    out["prog"] = max(LEAST_TAU, float(np.sqrt(np.mean(part.b[prog] ** 2 + var["prog"][prog]))))
    moves = [(part.b[j] - part.b[i]) ** 2 + var["cy"][i] + var["cy"][j] for i, j in _steps(space, seen)]
    out["cy"] = max(LEAST_TAU, float(np.sqrt(np.mean(moves)))) if moves else part.taus["cy"]
    part.round, part.turn, part.out, part.last = part.round + 1, 0, out, None
    part.done = part.round == ROUNDS
    if not part.done:
        part.taus = out
        if which == "level":
            part.sigma = part.residual


def fitted(panel: Packed, asked: list[tuple[int | None, float | None, bool]], fill: bool = True, known: list[Fold | None] = ()) -> list[Fold | None]:
    """A fit for each (until, half-life, couple); null where no number is before ``until``.

    Without ``fill`` only the level is fitted; levels that ``known`` folds have are taken from them.
    """
    space, folds = panel.space, []
    levels = {(f.until, f.halflife): f.level for f in known if f}
    for until, halflife, couple in asked:
        train = panel.counts if until is None else panel.counts[panel.counts["year"] < until]
        newest = train.groupby("county")["year"].max().reindex(range(len(space.counties)), fill_value=0).to_numpy()
        start = lambda sigma: Part(np.zeros(space.p), dict(FIRST), sigma)
        halflife = None if halflife is None or np.isnan(halflife) else float(halflife)
        level = levels.setdefault((until, halflife), start(5.0))
        folds.append(Fold(until, halflife, couple, newest, level, start(1.0)) if train["n_num"].sum() else None)
    while True:
        work: dict[int, tuple[Fold, str]] = {}
        for k, fold in enumerate(folds):
            if fold and not fold.level.done:
                if all(other.level is not fold.level for other, _ in work.values()):
                    work[k] = fold, "level"
            elif fold and fill and not fold.fill.done:
                work[k] = fold, "fill"
        if not work:
            return folds
        for k, (forms, post) in _pass(panel, work).items():
            fold, which = work[k]
            _advance(space, getattr(fold, which), which, forms, post)


def emitted(panel: Packed, schema: str, make) -> DataFrame:
    """``make(chunk)``, lists of a table's columns by name, of all chunks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    space, want = panel.space, to_arrow_schema(StructType.fromDDL(schema))

    def task(batches):
        for batch in batches:
            for chunk in chunks(space, batch):
                for made in make(chunk):
                    columns = [made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name], f.type, from_pandas=True) for f in want]
                    yield pa.RecordBatch.from_arrays(columns, schema=want)

    return panel.rows.mapInArrow(task, schema)


def expected(chunk: Chunk, fold: Fold, kind: np.ndarray, series: np.ndarray, year: int) -> np.ndarray:
    """Threshold of series with a kind each; county-years as of ``year``."""
    school, own = chunk.level_effects(fold)
    return _predicted(chunk, fold, fold.level, school, own, kind, series, year)


def _predicted(chunk: Chunk, fold: Fold, part: Part, school: np.ndarray, own: np.ndarray, kind: np.ndarray, series: np.ndarray, year: int) -> np.ndarray:
    b = part.b[chunk.space.whole(chunk.county)][chunk.space.columns[kind, :3]].sum(axis=1)
    return b + school[chunk.owner[series]] + own[series] + fold.effect(part, chunk.space, year)[chunk.county]


def predicted(chunk: Chunk, fold: Fold, kind: np.ndarray, series: np.ndarray, year: int) -> tuple[np.ndarray, np.ndarray]:
    """Threshold and fill probability of the usual round, of series with a kind each; county-years as of ``year``."""
    alpha = chunk.alpha(fold)
    school, own = chunk.fill_effects(fold, alpha)[:2]
    eta = _predicted(chunk, fold, fold.fill, school, own, kind, series, year)
    eta += fold.fill.b[chunk.space.slices["late"].start] + fold.fill.b[-1] * alpha[chunk.owner[series]]
    return expected(chunk, fold, kind, series, year), 1 / (1 + np.exp(-eta))


def words(codes: np.ndarray, of: list) -> pa.Array:
    return pa.DictionaryArray.from_arrays(pa.array(codes, pa.int32()), pa.array(of, pa.string())).cast(pa.string())


def named(chunk: Chunk, series: np.ndarray, kind: np.ndarray) -> dict:
    space = chunk.space
    return {
        "county": words(np.full(len(series), chunk.county), space.counties), "school": words(chunk.owner[series], chunk.schools),
        "program": words(space.kinds[kind, 1], space.progs), "category": words(space.kinds[kind, 0], space.cats),
    }
