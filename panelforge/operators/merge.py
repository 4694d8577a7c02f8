"""Merging of sources, newest first, with a log of every disagreement."""

from __future__ import annotations

from functools import reduce
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def priority_merge(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key by ``order``: one window over the key, which drops all but the first row as it goes."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_k", first).where("_k = 1").drop("_k")


def drift(rows: DataFrame, keys: list[str], order: list[Column], value: str, source: str) -> DataFrame:
    """Values that lost to a different one of the same key: kept, kept_from, ignored, ignored_from."""
    w = Window.partitionBy(*keys).orderBy(*order)
    head = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        rows.withColumns(
            {"kept": F.first(value).over(head), "kept_from": F.first(source).over(head), "_k": F.row_number().over(w)}
        )
        .where((F.col("_k") > 1) & ~F.col("kept").eqNullSafe(F.col(value)))
        .select(*keys, "kept", "kept_from", F.col(value).alias("ignored"), F.col(source).alias("ignored_from"))
    )


def one_spelling(rows: DataFrame, keys: list[str], name: str, order: list[Column]) -> DataFrame:
    """Names that differ in case only are one entity, published as first spelled."""
    w = Window.partitionBy(*keys, F.lower(name)).orderBy(*order)
    return rows.withColumn("published", F.first(name).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


MERGED = (
    "county string, school string, program string, level string, occurrence int, year int, status string, points double, "
    "source string"
)
DRIFT = (
    "county string, school string, program string, level string, year int, kept_status string, kept_points double, "
    "kept_from string, ignored_status string, ignored_points double, ignored_from string"
)


#: A cell within its group, in the order in which cells are merged.
CELL = ["source_rank", "row_pos", "year", "level", "school", "program", "status", "points", "source"]


def _fold(county: str, cells: list[tuple]) -> tuple[list[dict], list[dict]]:
    """Merge all cells (``CELL``, sorted) of one programme of one school; their order and earlier merges decide, so it is a fold.

    A repeat of a row within one source is a series of its own only if it disagrees with the series as merged so far.
    At the end, a placeholder level joins the only other level there is, and repeats join the first series.
    """
    rows: dict[tuple, dict[int, tuple]] = {}
    spelled, log = {}, []
    def put(into: dict[int, tuple], year: int, cell: tuple, source: str, level: str) -> None:
        if year not in into:
            into[year] = (cell, source)
        elif into[year][0] != cell:
            log.append({"level": level, "year": year, "kept": into[year], "ignored": (cell, source)})

    for (rank, _), row in groupby(cells, key=itemgetter(0, 1)):
        row = list(row)
        _, _, _, level, school, program, _, _, source = row[0]
        spelled.setdefault("school", school)
        spelled.setdefault("program", program)
        used = spelled.setdefault(("used", rank, level), [0])
        new = {c[2]: (c[6], None if c[7] is None or c[7] != c[7] else c[7]) for c in row}
        place = 0
        if used[0]:
            clash = any(rows.get((level, 0), {}).get(y, (c,))[0] != c for y, c in new.items())
            place = used[0] if clash else 0
        used[0] += 1
        into = rows.setdefault((level, place), {})
        for year, cell in new.items():
            put(into, year, cell, source, level)

    for key in sorted(rows, key=lambda k: (k[1], k[0])):
        level, place = key
        siblings = {lev for lev, _ in rows if lev != "Vg2/Vg3"}
        if level == "Vg2/Vg3":
            target = (next(iter(siblings)), 0) if len(siblings) == 1 else None
        else:
            target = (level, 0) if place else None
        if target and target != key:
            into = rows.setdefault(target, {})
            for year, (cell, source) in rows.pop(key).items():
                put(into, year, cell, source, target[0])
    out = [
        {"level": lev, "occurrence": occ, "year": y, "status": c[0], "points": c[1], "source": src}
        for (lev, occ), cells_ in rows.items()
        for y, (c, src) in cells_.items()
    ]
    for x in (*out, *log):
        x |= {"school": spelled["school"], "program": spelled["program"], "county": county}
    return out, log


def merge_sources(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(series, drift) of source rows. A group is one programme of one school, so it is small by nature.

    There are as many groups as series, so a group is a row with an array, and a task folds the groups of a batch one by one.
    """
    keys = ["county", F.lower("school"), F.lower("program")]
    groups = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*CELL))).alias("cells")).select("county", "cells")

    def folded(pick, schema: str) -> DataFrame:
        columns = [c.split()[0] for c in schema.split(", ")]
        want = to_arrow_schema(StructType.fromDDL(schema))

        def task(batches):
            for batch in batches:
                cells, at = batch.column("cells"), batch.column("cells").offsets.to_pylist()
                flat = list(zip(*[cells.values.field(c).to_pylist() for c in CELL]))
                made = [x for i, county in enumerate(batch.column("county").to_pylist()) for x in pick(*_fold(county, flat[at[i] : at[i + 1]]))]
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in made], want.field(c).type) for c in columns], schema=want)

        return groups.mapInArrow(task, schema)

    def differing(_, log: list[dict]) -> list[dict]:
        return [
            {c: x[c] for c in ("county", "school", "program", "level", "year")}
            | {f"{side}_{n}": v for side in ("kept", "ignored") for n, v in zip(("status", "points", "from"), (*x[side][0], x[side][1]))}
            for x in log
        ]

    return folded(lambda out, _: out, MERGED), folded(differing, DRIFT)


def overlaid(base: DataFrame, over: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Base with overrides. ``over`` holds maps ``fields``: an entry replaces, a null entry deletes, no entry keeps."""
    joined = base.join(over.select(F.col(key).alias("_key"), "fields"), F.col(key).eqNullSafe(F.col("_key")), "left")
    has = lambda c: F.coalesce(F.map_contains_key("fields", F.lit(c)), F.lit(False))
    return joined.select(
        *[F.when(has(c), F.try_element_at("fields", F.lit(c))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in base.columns]
    )


def superseded(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All entries of ``new``, and those of ``old`` whose key ``new`` lacks: entries are replaced whole, never column by column.

    A null key is a key like any other; a column that one side lacks is null there.
    """
    fresh = new.select(*keys).distinct().toDF(*[f"_new_{k}" for k in keys])
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_new_{k}")) for k in keys])
    return new.unionByName(old.join(fresh, same, "left_anti"), allowMissingColumns=True)


def carried_over(new: DataFrame, old: DataFrame, keep: list[str]) -> DataFrame:
    """Fill columns from the former data set by (county, name), else by name alone where the old row has no county."""
    exact = old.where("county is not null").select(F.col("county"), "name", *[F.col(c).alias(f"_a_{c}") for c in keep])
    loose = old.where("county is null").select("name", *[F.col(c).alias(f"_b_{c}") for c in keep])
    joined = new.join(exact, ["county", "name"], "left").join(loose, "name", "left")
    return joined.select(
        *[F.coalesce(F.col(c), F.col(f"_a_{c}"), F.col(f"_b_{c}")).alias(c) if c in keep else F.col(c) for c in new.columns]
    )


def prefix_renamed(names: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """A name that begins exactly one longer name (followed by a space) is that name; names meet within the same ``keys``.

    Longer names are cut at their spaces and joined by equality, so names are never compared pair by pair.
    """
    keys = keys or []
    distinct = names.select(*keys, F.col(name).alias("long")).distinct()
    words = F.split("long", " ")
    heads = distinct.select(
        *keys, "long", F.explode(F.transform(F.sequence(F.lit(1), F.size(words)), lambda n: F.array_join(F.slice(words, 1, n), " "))).alias("short")
    ).where("short <> long")
    unique = heads.groupBy(*keys, "short").agg(F.count(F.lit(1)).alias("n"), F.min("long").alias("long")).where("n = 1")
    return names.join(unique.select(*keys, F.col("short").alias(name), "long"), [*keys, name], "left").withColumn(
        "renamed", F.coalesce("long", name)
    ).drop("long")
