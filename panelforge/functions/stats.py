"""Forecast statistics as expressions: chances, buckets, empirical and normal distributions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Years of history a series had, as closed ranges.
BUCKETS = ((0, 0), (1, 1), (2, 3), (4, 99))
SCORES = (20, 25, 30, 35, 40, 45, 50, 55)
LIKELY, POSSIBLE = 0.70, 0.35
QUANTILES = [k / 40 for k in range(41)]
COVERAGE_80 = 1.2816


def history_bucket(history: Column) -> Column:
    out = F.lit(len(BUCKETS) - 1)
    for i, (lo, hi) in reversed(list(enumerate(BUCKETS))):
        out = F.when(history.between(lo, hi), i).otherwise(out)
    return out


def expit(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column, least: float = 1e-6) -> Column:
    return F.ln(F.greatest(p, F.lit(least)) / F.greatest(1.0 - p, F.lit(least)))


def softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def normal_cdf(z: Column) -> Column:
    """By the rational approximation 7.1.26 of Abramowitz and Stegun (error below 1.5e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    terms = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1.0 - terms * F.exp(-x * x)
    return 0.5 * (1.0 + F.when(z < 0, -erf).otherwise(erf))


def empirical_cdf(z: Column, table: Column) -> Column:
    """Linear interpolation in a table of 41 quantiles, kept within 0.005 and 0.995; at a flat stretch its upper end."""
    below = F.size(F.filter(table, lambda q: q <= z))
    lo, hi = F.get(table, below - 1), F.get(table, below)
    inside = (below - 1 + (z - lo) / (hi - lo)) / 40.0
    value = F.when(below == 0, 0.0).when(below >= 41, 1.0).otherwise(inside)
    return F.least(F.greatest(value, F.lit(0.005)), F.lit(0.995))


def with_cdf(rows: DataFrame, z: str, table: list[float] | None, name: str) -> DataFrame:
    """Add ``name``: ``empirical_cdf`` of the column ``z`` in a known table in order.

    How many quantiles are not above ``z`` is found by halving. Each step is a column, so that it is computed once a row and the
    code of a row stays small.
    """
    if table is None:
        return rows.withColumn(name, F.least(F.greatest(F.lit(None).cast("double"), F.lit(0.005)), F.lit(0.995)))
    n, half = len(table), 1 << (len(table).bit_length() - 1)
    ends = F.array(*[F.lit(float(q)) for q in table + [float("inf")] * (2 * half - 1 - n)])
    rows = rows.withColumn("_below", F.lit(0))
    while half:
        rows = rows.withColumn("_below", F.col("_below") + F.when(F.get(ends, F.col("_below") + (half - 1)) <= F.col(z), half).otherwise(0))
        half //= 2
    below, lo, hi = F.col("_below"), F.get(ends, F.col("_below") - 1), F.get(ends, F.col("_below"))
    value = F.when(below == 0, 0.0).when(below >= n, 1.0).otherwise((below - 1 + (F.col(z) - lo) / (hi - lo)) / (n - 1.0))
    return rows.withColumn(name, F.least(F.greatest(value, F.lit(0.005)), F.lit(0.995))).drop("_below")


def chance(x: Column, m: Column, s: Column, fill: Column, table: Column | None = None) -> Column:
    """P(place) for x points: no queue, or a queue whose threshold is at most x."""
    z = (x - m) / s
    return (1.0 - fill) + fill * (normal_cdf(z) if table is None else empirical_cdf(z, table))


def final_chance(x: Column, m: Column, s: Column, fill: Column, table: Column, gone: Column, shift: Column) -> Column:
    """The chance after a later round: the queue may be gone, and the threshold moves by ``shift``."""
    return (1.0 - fill) + fill * (gone + (1.0 - gone) * empirical_cdf((x - m - shift) / s, table))


def band(p: Column) -> Column:
    return F.when(p >= LIKELY, "likely").when(p >= POSSIBLE, "possible").otherwise("unlikely")


def age_weight(newest: Column, year: Column, halflife: Column) -> Column:
    """0.5 for each half-life of age; no half-life means no decay."""
    return F.coalesce(F.pow(F.lit(0.5), (newest - year) / halflife), F.lit(1.0))


def decile(p: Column) -> Column:
    return F.least(F.greatest((p * 10).cast("int"), F.lit(0)), F.lit(9))


#: Upper edges of the map's colour steps.
EDGES = (30, 34, 38, 42)


def colour_step(v: Column) -> Column:
    out = F.lit(len(EDGES))
    for i, edge in reversed(list(enumerate(EDGES))):
        out = F.when(v < edge, i).otherwise(out)
    return out


#: Fixed value: the mean radius of the earth.
EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    h = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(h))


def mercator(lat: Column, lon: Column, zoom: int, tile: int = 512) -> Column:
    """struct(x, y) in pixels."""
    size, r = (1 << zoom) * tile, F.radians(lat)
    y = (1.0 - F.ln(F.tan(r) + 1.0 / F.cos(r)) / F.pi()) / 2.0 * size
    return F.struct(((lon + 180.0) / 360.0 * size).alias("x"), y.alias("y"))
