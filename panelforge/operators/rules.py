"""Small relational rules of a panel: maps, identities, rounds, enrichment tiers. All are DataFrame operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.text import looked_up

#: Kinds of a message, the last being the default.
KINDS = ("feil", "forslag", "bilde", "annet")
#: The offset where no bridge is known.
DEFAULT_OFFSET = -3.0
#: Names of codes that the register lacks.
EXTRA_CODES = {
    "MDMDD1--1-": "Musikk, dans og drama, musikk",
    "MDMDD1--4-": "Musikk, dans og drama, dans",
    "MDMDD1--6-": "Musikk, dans og drama, drama",
    "HSHSF1N---": "Helse- og oppvekstfag, SK 3 år",
    "STUSP1--EP": "Studiespesialisering, entreprenørskap",
}


def kind(text: Column) -> Column:
    """A message's kind; anything else, null included, is the default."""
    return F.when(text.isin(*KINDS), text).otherwise(F.lit(KINDS[-1]))


def only_if_false(flag: Column, value: Column) -> Column:
    """``value`` where the flag is false; where it is true or unknown, null."""
    return F.when(flag.eqNullSafe(F.lit(False)), value)


def located(lat: Column, lon: Column) -> Column:
    """Whether coordinates are there and not the zero that stands for none."""
    return F.coalesce((F.abs(lat) > 1) & (F.abs(lon) > 1) & lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def in_box(lat: Column, lon: Column, south: float = 57.5, north: float = 71.5, west: float = 4.0, east: float = 31.5) -> Column:
    return F.coalesce(lat.between(south, north) & lon.between(west, east), F.lit(False))


def merged_maps(first: Column, second: Column) -> Column:
    """Both maps; an entry of the first stays."""
    return F.map_zip_with(first, second, lambda k, a, b: F.coalesce(a, b))


def exploded(rows: DataFrame, values: str, key: str = "year", value: str = "value") -> DataFrame:
    """A row for each entry of a map; rows without entries have none."""
    kept = [c for c in rows.columns if c != values]
    return rows.select(*kept, F.explode(values).alias(key, value))


def code_titles(codes: DataFrame, register: DataFrame) -> DataFrame:
    """``codes`` (code, ...) with ``title``: a local name first, then the register's; one row for each row."""
    titles = register.groupBy("code").agg(F.min("nob").alias("registered"))
    local = looked_up(F.col("code"), EXTRA_CODES)
    return codes.join(titles, "code", "left").withColumn("title", F.coalesce(local, "registered")).drop("registered")


def offsets(rows: DataFrame, bridge: DataFrame) -> DataFrame:
    """``rows`` (county, category, ...) with ``offset``: the bridge's mean of the category, else of the county, else the default."""
    kinds = bridge.where("category is not null").select("county", "category", F.col("mean").alias("of_kind"))
    counties = bridge.where("category is null").select("county", F.col("mean").alias("of_county"))
    return (
        rows.join(kinds, ["county", "category"], "left")
        .join(counties, "county", "left")
        .withColumn("offset", F.coalesce("of_kind", "of_county", F.lit(DEFAULT_OFFSET)))
        .drop("of_kind", "of_county")
    )


def round_choice(rows: DataFrame, keys: list[str], rounds: tuple[str, ...] = ("1", "3")) -> DataFrame:
    """One row a key: the value of the first round of ``rounds`` that was published, with the other rounds' values as a map."""
    rank = F.array_position(F.array(*map(F.lit, rounds)), F.col("round"))
    best = F.min(F.when(rank > 0, F.struct(rank.alias("rank"), "round", "value")))
    every = F.map_from_entries(F.array_sort(F.collect_set(F.struct("round", "value"))))
    chosen = rows.groupBy(*keys).agg(best.alias("best"), every.alias("every")).where("best is not null")
    return chosen.select(*keys, "best.round", "best.value", F.map_filter("every", lambda r, v: r != F.col("best.round")).alias("others"))


def tiers(found: list[DataFrame], key: str, last: DataFrame | None = None) -> DataFrame:
    """Candidates of all tiers with ``tier`` from 1; those of ``last`` only for keys that no tier before has."""
    rows = [part.withColumn("tier", F.lit(i)) for i, part in enumerate(found, 1)]
    every = reduce(lambda a, b: a.unionByName(b), rows)
    if last is None:
        return every
    return every.unionByName(last.join(every.select(key).distinct(), key, "left_anti").withColumn("tier", F.lit(len(rows) + 1)))


def crawl_links(links: DataFrame, about: str, most: int = 8) -> DataFrame:
    """(page, link, place) of the first ``most`` links of a page that stay on its host and speak of the school itself."""
    host = lambda c: F.lower(F.try_parse_url(F.col(c), F.lit("HOST")))
    kept = links.where((host("page") == host("link")) & F.lower("link").rlike(about))
    first = kept.groupBy("page", "link").agg(F.min("pos").alias("pos"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("pos", "link"))
    return first.withColumn("place", place).where(F.col("place") <= most).select("page", "link", "place")


def credited(pictures: DataFrame, credits: DataFrame, key: str, marker: str = "Foto:") -> DataFrame:
    """``pictures`` whose credit does not begin with the marker take it from ``credits``, if that has one."""
    known = credits.where(F.col("credit").isNotNull()).select(F.col(key), F.col("credit").alias("found"))
    own = F.when(F.startswith("credit", F.lit(marker)), F.col("credit"))
    return pictures.join(known, key, "left").withColumn("credit", F.coalesce(own, "found", "credit")).drop("found")


def file_parts(name: Column) -> Column:
    """struct(year, round, region) that a file's name carries; null for what it does not say."""
    year = F.regexp_extract(name, "(20[0-9]{2})", 1).try_cast("int")
    turn = F.nullif(F.regexp_extract(F.lower(name), r"([1-3])\.?[-_ ]*inntak", 1), F.lit(""))
    region = F.nullif(F.regexp_extract(F.lower(name), r"inntak[-_ ]+([a-zæøå-]+?)[-_ ]*20[0-9]{2}", 1), F.lit(""))
    return F.struct(year.alias("year"), turn.alias("round"), region.alias("region"))


def two_year_lines(lines: DataFrame, key: str, text: str, year: int | Column) -> DataFrame:
    """(key, name, year, points) of lines "Name 41,3 (38,5)": this year's number and, in brackets, the year before's."""
    pattern = r"^(.*?\D)\s+([0-9]{1,2}[.,][0-9])\s*\(([0-9]{1,2}[.,][0-9])\)\s*$"
    number = lambda g: F.regexp_replace(F.regexp_extract(F.col(text), pattern, g), ",", ".").try_cast("double")
    year = F.lit(year) if isinstance(year, int) else year
    pair = F.array(F.struct(year.alias("year"), number(2).alias("points")), F.struct((year - 1).alias("year"), number(3).alias("points")))
    return lines.where(F.col(text).rlike(pattern)).select(
        key, F.trim(F.regexp_extract(F.col(text), pattern, 1)).alias("name"), F.inline(pair)
    )
