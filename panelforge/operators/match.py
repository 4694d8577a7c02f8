"""Entities matched by name and place, in tiers, most trustworthy first."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions.stats import EARTH_KM, haversine_km
from panelforge.functions.text import school_key


def cascade(schools: DataFrame, register: DataFrame, manual: DataFrame) -> DataFrame:
    """(school, county, tier, orgnr): a manual entry, else the register's exact name, a part of a name, a branch.

    Names are compared within a county only; ``pos`` is the register's order and settles ties.
    """
    pool = register.select("orgnr", F.col("fylke").alias("county"), "pos", school_key(F.col("navn")).alias("key"), F.lower("navn").alias("full"))
    named = schools.select("school", "county", school_key(F.col("school")).alias("own"))
    branch = F.contains("full", F.lit("avd"))
    tier = (
        F.when(F.col("key") == F.col("own"), 1)
        .when(~branch & (F.contains("own", F.col("key")) | F.contains("key", F.col("own"))), 2)
        .when(F.contains("key", F.col("own")), 3)
    )
    best = (
        named.join(pool, "county")
        .withColumn("tier", tier)
        .where("tier is not null")
        .groupBy("school", "county")
        .agg(F.min(F.struct("tier", "pos", "orgnr")).alias("best"))
    )
    return (
        schools.select("school", "county")
        .join(manual.select("school", "county", F.col("orgnr").alias("by_hand")), ["school", "county"], "left")
        .join(best, ["school", "county"], "left")
        .select(
            "school",
            "county",
            F.when(F.col("by_hand").isNotNull(), 0).otherwise(F.coalesce("best.tier", F.lit(9))).alias("tier"),
            F.coalesce("by_hand", "best.orgnr").alias("orgnr"),
        )
    )


def located(schools: DataFrame, register: DataFrame, manual: DataFrame, addresses: DataFrame, places: DataFrame, endings: list[str]) -> DataFrame:
    """``schools`` (county, school) with tier, lat and lon: where a school lies, by the first way that tells.

    In turn: by hand; the register's entry of that name; the address of an entry without coordinates; the place of the school's
    name, plain, with each of ``endings``, or as the register has it; else the tier is 'unmatched'. ``register`` is (county,
    navn, pos, lat, lon, adresse), ``addresses`` (county, adresse, lat, lon), ``places`` (county, name, lat, lon), ``manual``
    (county, school, lat, lon). Of several entries of a name the first by ``pos`` counts, of several others the least point.
    Each way is asked only for schools that are open still; joins are by equality within a county.
    """
    point = F.struct("lat", "lon")
    one = lambda df, keys: df.where("lat is not null and lon is not null").groupBy(*keys).agg(F.min(point).alias("at"))
    entry = F.min_by(F.struct("navn", "adresse", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), point).alias("at")), "pos")
    known = register.groupBy("county", school_key(F.col("navn")).alias("key")).agg(entry.alias("hit"))
    keyed = schools.select("county", "school").distinct().withColumn("key", school_key(F.col("school")))
    found = (
        keyed.join(one(manual, ["county", "school"]).withColumnRenamed("at", "by_hand"), ["county", "school"], "left")
        .join(known, ["county", "key"], "left")
        .withColumn("asks", F.when(F.col("by_hand").isNull() & F.col("hit.at").isNull(), F.col("hit.adresse")))
        .join(one(addresses.withColumnRenamed("adresse", "asks"), ["county", "asks"]).withColumnRenamed("at", "by_address"), ["county", "asks"], "left")
        .withColumn("at", F.coalesce("by_hand", "hit.at", "by_address"))
    )
    forms = F.array("school", *[F.concat("school", F.lit(" " + e)) for e in endings], "hit.navn")
    asked = found.select("county", "school", F.posexplode(F.when(F.col("at").isNull(), forms)).alias("turn", "name")).where("name is not null")
    placed = asked.join(one(places, ["county", "name"]).withColumnRenamed("at", "place"), ["county", "name"]).groupBy("county", "school").agg(F.min_by("place", "turn").alias("place"))
    tier = (
        F.when(F.col("by_hand").isNotNull(), "manual").when(F.col("hit.at").isNotNull(), "register")
        .when(F.col("by_address").isNotNull(), "address").when(F.col("place").isNotNull(), "place").otherwise("unmatched")
    )
    out = found.join(placed, ["county", "school"], "left").withColumn("at", F.coalesce("at", "place"))
    return out.select("county", "school", tier.alias("tier"), "at.lat", "at.lon")


#: Points of a place that stand in one row; a pair of such rows is at most CAP * CAP pairs of points.
CAP = 256


def _places(points: DataFrame, side: str) -> DataFrame:
    """(lat, lon, ids) under names of ``side``: the points of each place, in rows of about ``CAP``."""
    place, own = ["lat", "lon"], points.select("lat", "lon", F.struct("id").alias("point"))
    many = own.groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / F.lit(CAP)).alias("rows")).where("rows > 1")
    row = F.coalesce(F.pmod(F.xxhash64("point"), "rows"), F.lit(0)).alias("row")
    dealt = own.join(many, place, "left").select(*place, "point", row).groupBy(*place, "row")
    return dealt.agg(F.collect_list("point").alias("ids")).select(*[F.col(c).alias(f"{c}_{side}") for c in (*place, "ids")])


def within_km(a: DataFrame, b: DataFrame, km: float, digits: int | None = None) -> DataFrame:
    """Pairs (id_a, id_b, km) of points at most ``km`` apart: a join on cells of space, then the exact distance.

    Points lie on the unit sphere in cubes as wide as the chord of the distance, so those that near are in the same cube or one
    that touches it, at the poles and across the date line too. Each place of ``a`` asks in these 27 cubes, of which the sphere
    meets few. Points without a latitude or longitude are near nothing.

    Distances are taken between places, once for all points of the same latitude and longitude, and rounded there to ``digits``
    if given. Places that are near are dealt to all tasks before their points are paired: few places may have many points.
    """
    width = max(2 * math.sin(min(km / (2 * EARTH_KM), math.pi / 2)) * (1 + 1e-9), 1e-9)
    spark = a.sparkSession

    def place(df: DataFrame, side: str) -> DataFrame:
        p, q = F.radians("lat"), F.radians("lon")
        axes = {"x": F.cos(p) * F.cos(q), "y": F.cos(p) * F.sin(q), "z": F.sin(p)}
        cubes = [F.floor(v / width).alias(axis) for axis, v in axes.items()]
        return df.select("lat", "lon").distinct().select(F.col("lat").alias(f"lat_{side}"), F.col("lon").alias(f"lon_{side}"), *cubes)

    a, b = (df.where("lat is not null and lon is not null") for df in (a, b))
    asked = place(a, "a")
    for axis in "xyz":
        asked = asked.withColumn(axis, F.explode(F.sequence(F.col(axis) - 1, F.col(axis) + 1)))
    far = haversine_km(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    near = asked.join(place(b, "b"), ["x", "y", "z"]).withColumn("km", far).where(F.col("km") <= km)
    if digits is not None:
        near = near.withColumn("km", F.round("km", digits))
    # the rows are small and the pairs they stand for many, so their number of tasks is not left to adaptive execution
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    rows = near.join(_places(a, "a"), ["lat_a", "lon_a"]).join(_places(b, "b"), ["lat_b", "lon_b"]).select("km", "ids_a", "ids_b").repartition(tasks)
    for side in "ab":
        rows = rows.select("*", F.explode(f"ids_{side}").alias(f"point_{side}")).drop(f"ids_{side}")
    return rows.select(F.col("point_a.id").alias("id_a"), F.col("point_b.id").alias("id_b"), "km")
