"""The two-part forecast on panels of any size: effects fitted by sweeps of aggregations, predictions as joins.

A sweep visits the effects in turn. Each visit takes what the other effects leave of every observation and sets an effect's
levels to its shrunken mean, sum / (n + shrink): the exact solution of the penalised least squares in that block, so sweeps
come closer to the joint solution one by one. No system is held anywhere. The fill part is the first step of the logistic
fit from the overall rate. County-years are shrunken here, not a walk. Both parts are swept at once.

Observations move once, into a row for each series with its sums. Effects of schools and series, which are many, are columns
of that table: a visit to them is a window over the series' rows. Categories, programmes and county-years are few: a visit to
them is one aggregation, combined before it is shuffled, and writes a table that is joined to the series' rows.

``coefficients`` is a table (effect, county, level, year, m, eta): a school's level is its name within the county, a series'
school and programme; ``mu`` and ``alpha`` have neither county nor level. ``m`` belongs to the threshold part, ``eta`` to the
fill part, null where that part has no such level. ``info`` is the weight of the threshold's observations of a level over the
residual variance, which gives a level's standard error, 1 / sqrt(info + 1 / tau^2).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.stats import expit
from panelforge.plans.stored import stored

#: Each effect with its key and its shrinkage, in the order in which a sweep visits them.
EFFECTS = {
    "cat": (["category"], 0.0),
    "school": (["county", "school"], 2.0),
    "prog": (["program"], 4.0),
    "series": (["county", "school", "program"], 4.0),
    "cy": (["county", "year"], 8.0),
}
LEVEL = {"cat": "category", "school": "school", "prog": "program", "series": "concat_ws('|', school, program)", "cy": "cast(null as string)"}


#: A row of the series' table; a series has a row for each of its categories.
ROW = ["county", "school", "program", "category"]
#: Effects whose levels are columns of the series' table; the others are tables of their own.
CARRIED = ("school", "series")


def _sums(rows: DataFrame, parts: tuple[str, ...]) -> DataFrame:
    """``rows`` (ROW, year and z, w of each part) by series: the observations, and the sums of w and w * z of each part."""
    cell = F.struct("year", *[f"{x}_{p}" for p in parts for x in "wz"])
    sums = [F.sum(F.expr(e)).alias(f"{name}_{p}") for p in parts for name, e in (("w", f"w_{p}"), ("wz", f"w_{p} * z_{p}"))]
    return rows.repartition(*ROW).groupBy(*ROW).agg(F.collect_list(cell).alias("cells"), *sums)


def _known(series: DataFrame, mu: dict[str, float], fitted: dict[str, DataFrame], own: str) -> DataFrame:
    """``series`` with ``known_``: the sum of the mean and the effects, but ``own`` and county-years, of each part.

    Keys that are null meet no level.
    """
    rows, others = series, [n for n in fitted if n not in (own, "cy")]
    for name in others:
        if name not in CARRIED:
            keys = EFFECTS[name][0]
            rows = rows.join(fitted[name].select(*keys, *[F.col(f"b_{p}").alias(f"{name}_{p}") for p in mu]), keys, "left")
    met = lambda name: " AND ".join(f"{k} IS NOT NULL" for k in EFFECTS[name][0])
    level = lambda name, p: F.coalesce(F.when(F.expr(met(name)), F.col(f"{name}_{p}")), F.lit(0.0))
    known = {f"known_{p}": sum((level(n, p) for n in others), F.lit(m)) for p, m in mu.items()}
    return rows.select(*series.columns, *[c.alias(name) for name, c in known.items()])


def _observed(known: DataFrame, parts: dict[str, float], *more: str) -> DataFrame:
    """The observations of the series' rows, with ``left_``: what ``known_`` leaves of z, for each part."""
    rows = known.select(*more, *[f"known_{p}" for p in parts], F.inline("cells"))
    return rows.withColumns({f"left_{p}": F.expr(f"z_{p} - known_{p}") for p in parts})


def _years(series: DataFrame, cy: DataFrame, parts: dict[str, float]) -> DataFrame:
    """``series`` with ``years_``: the sum of w times the effect of the county-year, over a row's observations."""
    of_year = F.struct(*[f"b_{p}" for p in parts])
    by_county = cy.where("year is not null").groupBy("county").agg(F.map_from_entries(F.collect_list(F.struct("year", of_year))).alias("_cy"))
    add = lambda p: lambda acc, c: acc + F.coalesce(c[f"w_{p}"] * F.try_element_at("_cy", c["year"])[f"b_{p}"], F.lit(0.0))
    sums = {f"years_{p}": F.aggregate("cells", F.lit(0.0), add(p)) for p in parts}
    return series.join(by_county, "county", "left").withColumns(sums).drop("_cy")


def _swept(rows: DataFrame, parts: tuple[str, ...], sweeps: int) -> tuple[dict, dict, dict[str, DataFrame]]:
    """The mean and the residual variance of each part, and a table (key, b_, weight_ of each part) for each effect.

    ``rows`` has ROW, year and z_, w_ of each part, null where an observation is not of that part.
    """
    series = stored(_sums(rows, parts), "series")
    means = series.agg(*[F.try_divide(F.sum(f"wz_{p}"), F.sum(f"w_{p}")).alias(p) for p in parts]).first()
    mu = {p: means[p] or 0.0 for p in parts}
    fitted: dict[str, DataFrame] = {}
    series = series.withColumns({f"years_{p}": F.lit(0.0) for p in parts})
    for turn in range(sweeps):
        for name, (keys, shrink) in EFFECTS.items():
            left = _known(series, mu, fitted, name)
            mean = lambda p, of, over=lambda c: c: F.try_divide(over(F.sum(of)), over(F.sum(f"w_{p}")) + shrink)  # noqa: B023, E731
            rest = {p: F.expr(f"wz_{p} - w_{p} * known_{p} - years_{p}") for p in parts}
            if name in CARRIED:
                within = lambda c: c.over(Window.partitionBy(*keys))  # noqa: B023, E731
                found = left.withColumns({f"{name}_{p}": mean(p, rest[p], within) for p in parts}).drop(*[f"known_{p}" for p in parts])
                series = stored(found, f"series-{name}")
                fitted[name] = series.groupBy(*keys).agg(
                    *[F.max(f"{name}_{p}").alias(f"b_{p}") for p in parts], *[F.sum(f"w_{p}").alias(f"weight_{p}") for p in parts]
                )
                continue
            if name == "cy":
                left, rest = _observed(left, mu, "county"), {p: F.expr(f"w_{p} * left_{p}") for p in parts}
            visit = left.groupBy(*keys).agg(*[mean(p, rest[p]).alias(f"b_{p}") for p in parts], *[F.sum(f"w_{p}").alias(f"weight_{p}") for p in parts])
            fitted[name] = stored(visit, f"effect-{name}")
        if turn < sweeps - 1:
            series = stored(_years(series, fitted["cy"], mu), "series-years")
    every = _observed(_known(series, mu, fitted, ""), mu, "county")
    if "cy" in fitted:
        every = every.join(fitted["cy"].select("county", "year", *[f"b_{p}" for p in parts]), ["county", "year"], "left")
        every = every.withColumns({f"left_{p}": F.col(f"left_{p}") - F.coalesce(f"b_{p}", F.lit(0.0)) for p in parts})
    spread = [F.try_divide(F.sum(F.expr(f"w_{p} * left_{p} * left_{p}")), F.sum(f"w_{p}")).alias(p) for p in parts]
    return mu, every.agg(*spread).first().asDict(), fitted


def _part(z: Column, w: Column, part: str) -> list[Column]:
    return [z.alias(f"z_{part}"), F.when(z.isNotNull(), w).alias(f"w_{part}")]


def swept(rows: DataFrame, sweeps: int = 2) -> tuple[float, float | None, dict[str, DataFrame]]:
    """The mean, the residual variance and a table (key, b, weight) for each effect of ``rows`` (keys, z, w).

    ``rows`` is read once. Rows of weight 0 move no effect; a level whose weights and shrinkage are both 0 has no effect.
    Without rows the mean is 0 and the variance null.
    """
    mu, sigma2, fitted = _swept(rows.select(*ROW, "year", *_part(F.col("z"), F.col("w"), "z")), ("z",), sweeps)
    return mu["z"], sigma2["z"], {name: found.withColumnsRenamed({"b_z": "b", "weight_z": "weight"}) for name, found in fitted.items()}


def coefficients(obs: DataFrame, sweeps: int = 2) -> DataFrame:
    """The coefficients of both parts of ``obs`` (county, school, program, category, year, state, v, w).

    ``obs`` should be a stored table. Empty observations give the two means 0 and no level.
    """
    y, w = (F.col("state") != "open").cast("double"), F.col("w")
    rate = obs.agg(F.try_divide(F.sum(w * y), F.sum("w"))).first()[0]
    rate = min(max(0.5 if rate is None else rate, 1e-6), 1 - 1e-6)
    q = rate * (1 - rate)
    number = F.when(F.col("state") == "num", F.col("v").cast("double"))
    step = math.log(rate / (1 - rate)) + (y - rate) / q
    mu, sigma2, fitted = _swept(obs.select(*ROW, "year", *_part(number, w, "m"), *_part(step, w * q, "eta")), ("m", "eta"), sweeps)
    parts = [obs.sparkSession.createDataFrame([("mu", mu["m"], mu["eta"])], "effect string, m double, eta double")]
    for name, found in fitted.items():
        info = F.try_divide("weight_m", F.lit(sigma2["m"]).cast("double")).alias("info")
        level = found.select(*[k for k in EFFECTS[name][0] if k in ("county", "year")], F.expr(LEVEL[name]).alias("level"), F.col("b_m").alias("m"), F.col("b_eta").alias("eta"), info)
        parts.append(level.withColumn("effect", F.lit(name)))
    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return both.groupBy("effect", "county", "level", "year").agg(*[F.max(c).alias(c) for c in ("m", "eta", "info")])


def predicted(rows: DataFrame, coefs: DataFrame) -> DataFrame:
    """``rows`` (county, school, program, category, year, ...) with the threshold ``m`` and the fill probability ``pi``.

    Four joins find the levels, a fifth the newest fitted county-year up to the row's year; what was not fitted adds nothing.
    An ``alpha`` row couples the parts: its ``eta`` times the school's ``m`` enters the fill part; so does the ``eta`` of
    ``late`` for the usual round. Keys that are null meet no level.
    """
    def of(name: str) -> DataFrame:
        return coefs.where(F.col("effect") == name)

    def fixed(name: str, column: str) -> Column:
        return F.coalesce(of(name).agg(F.max(column)).scalar(), F.lit(0.0))

    out = rows
    for name in ("cat", "school", "prog", "series"):
        keys = EFFECTS[name][0]
        found = of(name).select(*(["county"] if "county" in keys else []), F.col("level").alias(f"_{name}"), F.col("m").alias(f"m_{name}"), F.col("eta").alias(f"eta_{name}"))
        out = out.withColumn(f"_{name}", F.expr(LEVEL[name])).join(found, [*(["county"] if "county" in keys else []), f"_{name}"], "left").drop(f"_{name}")
    # the as-of join goes over the (county, year) pairs alone, of which there are few
    known = of("cy").select("county", "year", "m", "eta")
    asked = rows.select("county", "year", F.lit(None).cast("double").alias("m"), F.lit(None).cast("double").alias("eta")).distinct()
    so_far = Window.partitionBy("county").orderBy("year").rangeBetween(Window.unboundedPreceding, 0)
    newest = known.unionByName(asked).select(
        "county", "year", F.last("m", ignorenulls=True).over(so_far).alias("m_cy"), F.last("eta", ignorenulls=True).over(so_far).alias("eta_cy")
    )
    newest = newest.groupBy("county", "year").agg(F.max("m_cy").alias("m_cy"), F.max("eta_cy").alias("eta_cy"))
    out = out.join(newest, ["county", "year"], "left")
    total = lambda part: sum((F.coalesce(f"{part}_{n}", F.lit(0.0)) for n in EFFECTS), fixed("mu", part))
    eta = total("eta") + fixed("late", "eta") + fixed("alpha", "eta") * F.coalesce("m_school", F.lit(0.0))
    return out.select(*rows.columns, total("m").alias("m"), expit(eta).alias("pi"))
