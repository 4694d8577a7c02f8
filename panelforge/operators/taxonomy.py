"""Programme names resolved against a register of codes, as staged joins over distinct names.

Steps, most trustworthy first: keyword, alias or exact name (as written, then without noise), the longest comma-separated
prefix that is known, the closest name, the longest register name inside the label. Each step only sees what the steps
before left over. Names are never compared with the whole register: close ones are joined on the lengths that leave the
ratio possible, contained ones on the label's own parts, so a register of any size will do. Tables may have any column names.
"""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelforge.functions.text import denoised, label, looked_up, nfkc, title

#: The categories in force, with their names.
CATEGORIES = {
    "ST": ("Studiespesialisering", "Specialization in General Studies"),
    "ID": ("Idrettsfag", "Sports and Physical Education"),
    "MD": ("Musikk, dans og drama", "Music, Dance and Drama"),
    "KD": ("Kunst, design og arkitektur", "Art, Design and Architecture"),
    "MK": ("Medier og kommunikasjon", "Media and Communication"),
    "BA": ("Bygg- og anleggsteknikk", "Building and Construction"),
    "EL": ("Elektro og datateknologi", "Electrical Engineering and Computer Technology"),
    "FD": ("Frisør, blomster, interiør og eksponeringsdesign", "Hairdressing, Floristry, Interior and Retail Design"),
    "HS": ("Helse- og oppvekstfag", "Healthcare, Childhood and Youth Development"),
    "DT": ("Håndverk, design og produktutvikling", "Handicrafts, Design and Product Development"),
    "IM": ("Informasjonsteknologi og medieproduksjon", "Information Technology and Media Production"),
    "NA": ("Naturbruk", "Agriculture, Fishing and Forestry"),
    "RM": ("Restaurant- og matfag", "Restaurant and Food Processing"),
    "SR": ("Salg, service og reiseliv", "Sales, Service, Travel and Tourism"),
    "TP": ("Teknologi- og industrifag", "Technical and Industrial Production"),
    "PB": ("Påbygging til generell studiekompetanse", "Supplementary year for general university admission"),
}
#: What discontinued codes became, by code and by programme.
SUCCESSOR_BY_CODE = {
    "SSISF2": "IM", "SSISF3": "IM", "SSIDT3": "IM", "SSITU3": "IM", "SSTRL2": "TP", "DHMDE3": "IM", "DHMED1": "IM",
    "DHMED2": "IM", "DHDTE2": "DT",
}
SUCCESSOR_BY_PROGRAM = {"SS": "SR", "ME": "MK", "DH": "FD"}
#: Names that the register does not know.
ALIASES = {
    "teknikk og industriell produksjon": "TP", "teknikk og industrifag": "TP", "elektrofag": "EL", "elektro": "EL",
    "elenergi": "EL", "data og elektronikk": "EL", "kulde varmepumpe vent tekn": "EL", "kulde varmepumpe vent teknologi": "EL",
    "helse og sosialfag": "HS", "helse oppvekst ambulanse": "HS", "service og sikkerhet og admin": "SR",
    "elektro og datatekn autom": "EL", "håndverk design og produktutv søm th": "DT", "studiespes business": "ST",
    "studiespes skiskyting": "ST", "språk samfunn og økonomi toppidrett": "ST", "international baccalaureate": "ST",
    "international baccalaureate ib": "ST", "naturbruk med anleggsgartnar": "NA",
}
CLOSE = 0.84


def _ratio(x: str | None, y: str | None, least: float) -> float | None:
    if x is None or y is None:
        return None
    matcher = difflib.SequenceMatcher(None, x, y)
    return matcher.ratio() if matcher.real_quick_ratio() >= least and matcher.quick_ratio() >= least else 0.0


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching characters (difflib), 0 to 1; null if either is null."""
    return pd.Series([_ratio(x, y, 0.0) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def close_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The same, but 0 where it cannot reach ``CLOSE``, which is found out without matching."""
    return pd.Series([_ratio(x, y, CLOSE) for x, y in zip(a, b)], dtype="float64")


def category_of(code: Column) -> Column:
    program = F.substring(code, 1, 2)
    live = F.when(program.isin(*CATEGORIES), program)
    return F.coalesce(live, looked_up(F.substring(code, 1, 6), SUCCESSOR_BY_CODE), looked_up(program, SUCCESSOR_BY_PROGRAM))


def category_or_other(category: Column) -> Column:
    """The filter key of a name: its category, ``annet`` if it has none."""
    return F.coalesce(category, F.lit("annet"))


def register_names(register: DataFrame) -> DataFrame:
    """(entry, entry_code, pos): each normalised name of the register with its best code (a live one before others) and the
    first place it has in the register, by column ``pos`` if there is one, else by code."""
    live = F.substring("code", 1, 2).isin(*CATEGORIES)
    place = F.col("pos").cast("string") if "pos" in register.columns else F.lit("")
    names = register.select(
        "code", F.struct(F.length(place), place, F.col("code")).alias("pos"), F.posexplode(F.array("nob", "nno")).alias("which", "title")
    )
    names = names.withColumn("title", nfkc(F.col("title"))).withColumn("entry", label(F.col("title")))
    return (
        names.where("entry <> ''")
        .groupBy("entry")
        .agg(F.min(F.struct(~live, F.col("code")))["code"].alias("entry_code"), F.min(F.struct("pos", "which")).alias("pos"))
    )


def resolve(names: DataFrame, register: DataFrame, name: str = "program") -> DataFrame:
    """(program, category, code, how) of each distinct name."""
    index = register_names(register)
    todo = names.select(F.col(f"`{name}`").alias("wanted")).distinct().withColumn("plain", nfkc(F.col("wanted")))
    todo = todo.withColumns({"n": label(F.col("plain")), "base": denoised(label(F.col("plain")))})
    parts = F.filter(F.transform(F.split("plain", ","), lambda p: F.trim(p)), lambda p: p != "")
    tries = todo.select(
        "wanted", "n", "base",
        F.posexplode(
            F.concat(
                F.array(F.col("n"), F.col("base")),
                F.transform(
                    F.reverse(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1)))),
                    lambda i: denoised(label(F.array_join(F.slice(parts, F.lit(1), i), ", "))),
                ),
            )
        ).alias("step", "cand"),
    )
    found = tries.join(index, F.col("cand") == F.col("entry"), "left").withColumn("alias", looked_up(F.col("cand"), ALIASES))
    hit = F.struct(
        F.col("step"),
        F.coalesce("alias", category_of(F.col("entry_code"))).alias("category"),
        F.when(F.col("alias").isNull(), F.col("entry_code")).alias("code"),
        F.when(F.col("alias").isNotNull(), "alias").when(F.col("step") < 2, "exact").otherwise("prefix").alias("how"),
    )
    staged = found.groupBy("wanted", "n", "base").agg(
        F.min(F.when(F.col("alias").isNotNull() | F.col("entry_code").isNotNull(), hit)).alias("hit")
    )
    keyword = F.contains("n", F.lit("påbygg")) | F.contains("n", F.lit("pabygg"))
    known = staged.where(keyword | F.col("hit").isNotNull()).select(
        "wanted",
        F.when(keyword, "PB").otherwise(F.col("hit.category")).alias("category"),
        F.when(keyword, "PBPBY3----").otherwise(F.col("hit.code")).alias("code"),
        F.when(keyword, "keyword").otherwise(F.col("hit.how")).alias("how"),
    )
    left = staged.where(~keyword & F.col("hit").isNull()).select("wanted", "base")
    close, inside = closest(left, index), longest_inside(left, index)
    guessed = left.join(close, "wanted", "left").join(inside, "wanted", "left")
    code = F.coalesce("close_code", "inside_code")
    guessed = guessed.select(
        "wanted",
        category_of(code).alias("category"),
        code.alias("code"),
        F.when(F.col("close_code").isNotNull(), F.concat(F.lit("fuzzy "), F.format_string("%.2f", "ratio")))
        .when(F.col("inside_code").isNotNull(), "contains")
        .otherwise("unresolved")
        .alias("how"),
    )
    return known.unionByName(guessed).withColumnRenamed("wanted", name)


def closest(left: DataFrame, index: DataFrame) -> DataFrame:
    """(wanted, close_code, ratio): the entry with the highest ratio(entry, label) from ``CLOSE`` on, of equals the one that
    sorts last; the ratio shown is that of (label, entry), as the measure is not symmetric.

    A ratio is at most twice the shorter length over both lengths, so a label is joined to the lengths that leave it possible.
    """
    size = F.length("base")
    least, most = F.ceil(size * (CLOSE / (2 - CLOSE)) - 1e-9), F.floor(size * ((2 - CLOSE) / CLOSE) + 1e-9)
    asked = left.where(size > 0).select("wanted", "base", F.explode(F.sequence(least, most)).alias("entry_length"))
    entries = index.select("entry", "entry_code", F.length("entry").cast("bigint").alias("entry_length"))
    return (
        asked.join(entries, "entry_length")
        .withColumn("selected", close_similarity(F.col("entry"), F.col("base")))
        .where(F.col("selected") >= CLOSE)
        .groupBy("wanted", "base")
        .agg(F.max(F.struct("selected", "entry", "entry_code")).alias("best"))
        .select("wanted", F.col("best.entry_code").alias("close_code"), similarity(F.col("base"), F.col("best.entry")).alias("ratio"))
    )


def longest_inside(left: DataFrame, index: DataFrame, least: int = 8) -> DataFrame:
    """(wanted, inside_code): the longest entry of at least ``least`` characters inside the label, of equals the register's first.

    A label's own parts are joined by equality, so nothing is compared with every entry. Parts are made of those lengths only
    that entries have, each length in a row of its own, so a long label makes no more than its length in parts a row.
    """
    entries = index.where(F.length("entry") >= least).withColumn("size", F.length("entry"))
    lengths = F.explode(F.sequence(F.lit(least), F.length("base"))).alias("size")
    asked = left.where(F.length("base") >= least).select("wanted", "base", lengths).join(entries.select("size").distinct(), "size")
    starts = F.sequence(F.lit(1), F.length("base") - F.col("size") + 1)
    parts = F.transform(starts, lambda at: F.substring(F.col("base"), at, F.col("size")))
    return (
        asked.select("wanted", F.explode(F.array_distinct(parts)).alias("entry"))
        .join(entries, "entry")
        .groupBy("wanted")
        .agg(F.min(F.struct(-F.col("size"), "pos", "entry_code"))["entry_code"].alias("inside_code"))
    )


#: What a county appends to a name and what it means, longer patterns first.
SUFFIXES = (
    (r",?\s*SK\s*3[\s-]*(år|årig)?", "3-year academic track"), (r",?\s*SK\b", "academic track"),
    (r",?\s*YSK\s*4?\s*(år)?", "4-year vocational + academic"), (r",?\s*landslinje", "national programme"),
    (r",?\s*LAL\b", "national programme"), (r",?\s*m/toppidrett", "elite sport"), (r",?\s*toppidrett", "elite sport"),
    (r",?\s*friluftsliv", "outdoor life"), (r",?\s*dyrekunnskap", "animal science"), (r",?\s*hest\b", "horses"),
    (r",?\s*forskerlinje", "research track"), (r",?\s*entreprenørskap", "entrepreneurship"), (r",?\s*teknologifag", "technology"),
    (r",?\s*internasjonalisering", "internationalisation"), (r",?\s*skiskyting", "biathlon"), (r",?\s*dagtid", "daytime"),
    (r",?\s*kveld", "evening"), (r",?\s*nett\b", "online"), (r",?\s*folkemusikk", "folk music"), (r",?\s*alpin", "alpine skiing"),
    (r",?\s*business", "business"), (r",?\s*ambulanse", "ambulance"),
)


#: English names that the register does not have, by normalised name; disciplines; titles that are too long.
BASE_ENGLISH = {
    "teknikk og industriell produksjon": "Technical and Industrial Production",
    "elektrofag": "Electrical Engineering",
    "elektro": "Electrical Engineering",
    "elenergi": "Electrical Power",
    "data og elektronikk": "Computer and Electronics",
    "kulde varmepumpe vent tekn": "Refrigeration, Heat Pump and Ventilation Technology",
    "kulde varmepumpe vent teknologi": "Refrigeration, Heat Pump and Ventilation Technology",
    "international baccalaureate": "International Baccalaureate",
    "international baccalaureate ib": "International Baccalaureate",
    "studiespes business": "Specialization in General Studies",
    "studiespes skiskyting": "Specialization in General Studies",
    "dronefag": "Drone Technology",
    "service og sikkerhet og admin": "Service, Security and Administration",
    "helse oppvekst ambulanse": "Healthcare, Childhood and Youth Development",
    "språk samfunn og økonomi toppidrett": "Languages, Social Sciences and Economics",
    "håndverk design og produktutv søm th": "Handicrafts, Design and Product Development",
    "elektrofag elenergi": "Electrical Engineering",
    "elektro og datatekn autom": "Electrical Engineering and Computer Technology",
    "elektrofag autom": "Electrical Engineering",
}
DISCIPLINES = {
    "musikk dans og drama musikk": "Music, Dance and Drama — music",
    "musikk dans og drama dans": "Music, Dance and Drama — dance",
    "musikk dans og drama drama": "Music, Dance and Drama — drama",
    "musikk dans og drama folkemusikk lal": "Music, Dance and Drama — folk music, national programme",
    "musikk folkemusikk lal": "Music — folk music, national programme",
}
SHORTER = {
    "Supplementary programme for general university and college admissions certification": "Supplementary year for general university admission",
    "Subjects for general university and college admissions certification": "Supplementary year for general university admission",
}


def english_names(resolved: DataFrame, register: DataFrame, name: str = "program") -> DataFrame:
    """``resolved`` (a name, category, code) with column ``english``.

    The title is the discipline's own, else that of the fixed table, the register or the category, in title case; what the
    county appended after the name follows, each pattern taken out before the next one is sought. Null if nothing is known.
    """
    titles = register.select("code", F.col("eng").alias("eng_title"), F.col("nob").alias("nob_title")).dropDuplicates(["code"])
    rows = resolved.select(
        F.struct(*[F.col(f"`{c}`") for c in resolved.columns]).alias("row"), F.col(f"`{name}`").alias("wanted"), "category", "code"
    ).join(titles, "code", "left").withColumn("plain", nfkc(F.col("wanted"))).withColumn("nob_title", nfkc(F.col("nob_title")))
    n = label(F.col("plain"))
    base = F.coalesce(
        looked_up(n, BASE_ENGLISH), looked_up(denoised(n), BASE_ENGLISH), F.nullif(F.col("eng_title"), F.lit("")),
        looked_up(F.col("category"), {code: names[1] for code, names in CATEGORIES.items()}),
    )
    base = F.coalesce(looked_up(base, SHORTER), base)
    base = title(F.trim(F.regexp_replace(base, r"(?iU)\s*vg\s*[1-4]\s*$", "")))
    head = F.nullif(F.get(F.split(label(F.coalesce("nob_title", F.lit(""))), " "), F.lit(0)), F.lit(""))
    at = F.when(head.isNotNull(), F.position(head, F.lower("plain"))).otherwise(F.lit(0))
    after = F.regexp_replace(F.substring(F.col("plain"), at + F.length(head), F.length("plain")), "^[^,]*", "")
    tail = F.when(F.coalesce(at, F.lit(0)) > 0, after).otherwise(F.col("plain"))
    found = []
    for pattern, meaning in SUFFIXES:
        found.append(F.when(tail.rlike("(?iU)" + pattern), F.lit(meaning)))
        tail = F.regexp_replace(tail, "(?iU)" + pattern, " ")
    extras = F.array_distinct(F.filter(F.array(*found), lambda x: x.isNotNull()))
    whole = F.when(F.size(extras) > 0, F.concat(base, F.lit(", "), F.array_join(extras, ", "))).otherwise(base)
    return rows.select("row.*", F.coalesce(looked_up(n, DISCIPLINES), whole).alias("english"))


