"""Text functions, as expressions on columns."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: Fixed value: how wide pictures are shown, in pixels.
DISPLAY_WIDTH = 960


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normal form, which no built-in function gives; null stays null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def replaced(text: Column, *rules: tuple[str, str]) -> Column:
    """Apply regular expressions in order."""
    return reduce(lambda c, rule: F.regexp_replace(c, rule[0], rule[1]), rules, text)


def looked_up(text: Column, entries: dict[str, str]) -> Column:
    """The entry for a text, null if there is none."""
    return F.create_map(*[F.lit(x) for pair in entries.items() for x in pair])[text] if entries else F.lit(None).cast("string")


def norm(text: Column) -> Column:
    """Compatibility normal form with plain spaces and hyphens, trimmed; null counts as empty.

    The form is made in Python (Arrow batches), so this is applied to a column once, before the expressions that build on it.
    Texts of plain and accented Latin-1 letters only are in that form already and are not sent there.
    """
    given = F.coalesce(text, F.lit(""))
    formed = F.coalesce(nfkc(F.when(given.rlike("[^\\x00-\\x7f\\xc0-\\xff]"), given)), given)
    return F.trim(F.translate(formed, "\u00a0\u2010", " -"))


def squash(text: Column) -> Column:
    """Runs of white space of any kind become one space; hard spaces and hyphens become plain ones."""
    return F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), "\u00a0\u2010", " -"), "(?U)\\s+", " "))


#: What is said about a programme's form and does not tell which programme it is.
NOISE = (
    r"\b(sk|ysk)\s*\d?\s*(år|årig)?\b", r"\b\d\s*(år|årig)\b", r"\blandslinje\b", r"\blal\b", r"\bny\b", r"\bpb[a-z0-9]+\b",
    r"\bmed\b", r"\bm\b", r"\bdagtid\b", r"\bkveld\b", r"\bnett\b", r"\better\b", r"\be\b",
)


def label(text: Column) -> Column:
    """A programme name for comparison: lower case, without year step and punctuation."""
    lower = F.lower(F.translate(F.coalesce(text, F.lit("")), "\u00a0", " "))
    return F.trim(replaced(lower, (r"(?U)\bvg\s*[1-4]\b", " "), (r"[.,/()\-–]", " "), (r"(?U)\s+", " ")))


def denoised(text: Column) -> Column:
    return F.trim(replaced(text, *[("(?U)" + rule, " ") for rule in NOISE], (r"(?U)\s+", " ")))


def school_key(name: Column) -> Column:
    """A school's name without the words that all of them have."""
    return F.trim(
        replaced(
            F.lower(F.coalesce(name, F.lit(""))),
            (r"(?U)\bvid[ae]reg\w*\b", " "),
            (r"(?U)\b(vgs|vg)\b", " "),
            (r"(?U)\b(skole|skule|skulen|skolen|avdeling)\b", " "),
            (r"(?U)\bavd\b\.?", " "),
            (r"st\.", "st "),
            (r"[.,/()\-]", " "),
            (r"\s+", " "),
        )
    )


#: Words that do not tell schools apart.
STOP = ("videregående", "vidaregåande", "videregaande", "skole", "skule", "skolen", "skulen", "vgs", "avd", "avdeling", "og", "gymnas")


def name_tokens(name: Column, stop: tuple[str, ...] = STOP) -> Column:
    """Words of over three letters that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(F.translate(name, ".", " ")), r"(?U)[^\wæøå ]", " "), " +")
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(*stop))


#: Words that stay small in a title.
SMALL_WORDS = ("and", "or", "of", "the", "for", "in", "to", "a", "an", "with", "on", "at")


def title(text: Column, small: tuple[str, ...] = SMALL_WORDS) -> Column:
    """First letters upper case but in small words after the first; the rest of a word stays as it is."""

    def word(w: Column, i: Column) -> Column:
        first, rest = F.substring(w, 1, 1), F.substring(w, F.lit(2), F.length(w))
        return F.when((i > 0) & F.lower(w).isin(*small), F.concat(F.lower(first), rest)).otherwise(F.concat(F.upper(first), rest))

    return F.array_join(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), word), " ")


def address(text: Column) -> Column:
    """struct(street, number, postcode, place) of "Street 16, 3629, Place"; a range of numbers counts as its first."""
    parts = F.filter(F.transform(F.split(text, ","), lambda p: F.trim(p)), lambda p: p != "")
    street = F.regexp_replace(F.coalesce(F.get(parts, F.lit(0)), F.lit("")), r"([0-9]+)\s*-\s*[0-9]+$", "$1")
    found = r"^(.*?)\s+([0-9]+)\s*[A-Za-z]?$"
    number = F.nullif(F.regexp_extract(street, found, 2), F.lit(""))
    postcode = F.get(F.filter(parts, lambda p: p.rlike("^[0-9]{4}$")), F.lit(0))
    last = F.when(F.size(parts) > 1, F.element_at(parts, -1))
    return F.struct(
        F.when(number.isNotNull(), F.regexp_extract(street, found, 1)).otherwise(street).alias("street"),
        number.alias("number"),
        postcode.alias("postcode"),
        F.when(~last.eqNullSafe(postcode), last).alias("place"),
    )


def site_url(url: Column) -> Column:
    """A web address with scheme; null for nothing and for e-mail addresses."""
    url = F.trim(url)
    return F.when((url == "") | F.contains(url, F.lit("@")), None).when(F.startswith(url, F.lit("http")), url).otherwise(
        F.concat(F.lit("https://"), F.regexp_replace(url, "^/+", ""))
    )


def larger(url: Column) -> Column:
    """The same picture in a larger rendition: the first of three forms that applies."""
    forms = (("([?&]width=)[0-9]+", "$11600"), ("/w600/h[0-9]+/", "/w1200/h675/"), ("__w=[0-9]+_h=[0-9]+", "__w=1200_h=675"))
    return F.coalesce(*[F.nullif(F.regexp_replace(url, pattern, new), url) for pattern, new in forms], url)


def with_query(url: Column, settings: dict[str, Column]) -> Column:
    """The address with parameters set: one that is there keeps its place, a new one comes last, null sets nothing.

    Parameters without a value go, as does a second setting of one that is set here; a fragment stays at the end.
    """
    names = F.array(*map(F.lit, settings))
    given = F.map_filter(F.map_from_arrays(names, F.array(*settings.values())), lambda k, v: v.isNotNull())
    whole = F.substring_index(url, "#", 1)
    fragment = F.regexp_extract(url, "#.*$", 0)
    path, query = F.regexp_extract(whole, r"^[^?]*", 0), F.regexp_extract(whole, r"\?(.*)$", 1)
    key = lambda p: F.substring_index(p, "=", 1)
    parts = F.filter(F.split(query, "&"), lambda p: p.rlike("^[^=]+=."))
    firsts = F.filter(parts, lambda p, i: ~F.map_contains_key(given, key(p)) | (F.array_position(F.transform(parts, key), key(p)) == i + 1))
    kept = F.transform(firsts, lambda p: F.coalesce(F.concat(key(p), F.lit("="), F.try_element_at(given, key(p))), p))
    new = F.filter(F.map_keys(given), lambda k: ~F.array_contains(F.transform(parts, key), k))
    every = F.concat(kept, F.transform(new, lambda k: F.concat(k, F.lit("="), F.try_element_at(given, k))))
    return F.concat(path, F.when(F.size(every) > 0, "?").otherwise(""), F.array_join(every, "&"), fragment)


def displayed(url: Column, width: int = DISPLAY_WIDTH) -> Column:
    """The same picture as wide as it is shown, as far as its host is known to scale; else the address as it is."""
    path = F.lower(F.regexp_extract(url, r"^[^?#]*", 0))
    settings = {"width": F.lit(str(width)), "quality": F.lit("75"), "format": F.when(path.endswith(".png"), "jpg")}
    return (
        F.when(F.contains(url, F.lit("upload.wikimedia.org")), F.regexp_replace(url, r"/\d+px-", f"/{width}px-"))
        .when(F.contains(url, F.lit("v.imgi.no")), F.regexp_replace(url, r"__w=\d+", f"__w={width}"))
        .when(F.contains(url, F.lit("/bv.ashx/")) | ~path.rlike(r"\.(jpg|jpeg|png|webp)$"), url)
        .otherwise(with_query(url, settings))
    )


def thumbnail(url: Column, width: int = DISPLAY_WIDTH) -> Column:
    """A Commons picture's rendition of at most ``width``: originals get one, wider ones are narrowed, drawings stay.

    Parameters are dropped. Whether the host serves the rendition is for the caller to ask.
    """
    bare = F.substring_index(F.coalesce(url, F.lit("")), "?", 1)
    size = F.regexp_extract(bare, r"/(\d+)px-", 1).try_cast("bigint")
    original = r"^.*/wikipedia/commons/([^/]+)/([^/]+)/([^/]+).*$"
    drawn = F.lower(F.regexp_extract(bare, original, 3)).rlike(r"\.(svg|gif)$")
    made = F.regexp_replace(bare, original, f"https://upload.wikimedia.org/wikipedia/commons/thumb/$1/$2/$3/{width}px-$3")
    return (
        F.when(~F.contains(bare, F.lit("upload.wikimedia.org")), bare)
        .when(F.contains(bare, F.lit("/thumb/")), F.when(size > width, F.regexp_replace(bare, r"/\d+px-", f"/{width}px-")).otherwise(bare))
        .when(~bare.rlike(original) | drawn, bare)
        .otherwise(made)
    )


def without_tags(html: Column) -> Column:
    return F.trim(replaced(html, ("<[^>]+>", ""), (r"\s+", " ")))


def one_line(text: Column, most: int | None = None) -> Column:
    """One line, of at most ``most`` characters if that is given."""
    text = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return text if most is None else F.substring(text, 1, most)


def paragraphs(text: Column, most: int | None = None) -> Column:
    """Lines are kept, runs of blanks become one and empty lines at most one; of at most ``most`` characters if given."""
    text = replaced(F.coalesce(text, F.lit("")), (r"\r\n?", "\n"), (r"[^\S\n]+", " "), (r"\n{3,}", "\n\n"))
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    return text if most is None else F.substring(text, 1, most)


def is_email(text: Column) -> Column:
    return text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def right_anchored(text: Column, parse, most: int = 4) -> Column:
    """``parse`` of the longest run of last words (at most ``most``) for which it gives a value."""
    words = F.split(F.trim(text), r"\s+")
    tails = F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(words))), lambda n: parse(F.array_join(F.slice(words, -n, n), " ")))
    return F.element_at(F.filter(F.concat(F.array(F.lit(None).cast("string")), tails), lambda v: v.isNotNull()), -1)


#: Words in a picture's name that speak for a building, and against one.
GOOD = (
    "fasade", "fasaden", "bygg", "bygget", "bygning", "hovedinngang", "inngang", "campus", "anlegg", "flyfoto", "luftfoto",
    "drone", "dji", "skolegard", "skolegård", "skulegard", "uteomrade", "uteområde", "oversikt", "front", "forside",
    "framside", "skolen", "skulen", "skole", "skule", "vgs", "utsiden", "ute", "hovedbygg", "nybygg", "sett-fra", "exterior",
    "eksterior",
)
BAD = (
    "logo", "ikon", "icon", "favicon", "sprite", "placeholder", "avatar", "illustrasjonsfoto", "illustrasjon", "unsplash",
    "shutterstock", "istock", "pexels", "designer-", "elev", "elevar", "klasse", "russ", "avslutning", "portrett", "ansatt",
    "rektor", "larer", "lærer", "undervisning", "praksis", "arrangement", "besok", "besøk", "tur", "konsert", "messe",
    "workshop", "jente", "gutt", "barn", "person", "gruppe", "apple-touch", "facebook", "instagram", "vipps",
)


def picture_score(url: Column, alt: Column, tokens: Column, good: tuple[str, ...] = GOOD, bad: tuple[str, ...] = BAD) -> Column:
    """-10 for a word of ``bad`` in the name, else 3 for each word of ``good`` and 4 for each of ``tokens``."""
    hay = F.concat(F.lower(url), F.lit(" "), F.lower(F.coalesce(alt, F.lit(""))))
    tail = F.element_at(F.split(hay, "/"), -1)
    among = lambda words: F.size(F.filter(words, lambda w: F.contains(tail, w)))
    veto = F.exists(F.array(*map(F.lit, bad)), lambda w: F.contains(tail, w)) | F.exists(
        F.array(*map(F.lit, ("logo", "ikon", "favicon"))), lambda w: F.contains(hay, w)
    )
    return F.when(veto, F.lit(-10)).otherwise(3 * among(F.array(*map(F.lit, good))) + 4 * among(tokens))


#: How sources misspell or shorten schools, lower case; schools under a new name; schools that became part of
#: another, with the year.
SCHOOL_ALIASES = {
    "bjørnholt skole": "Bjørnholt videregående skole",
    "oslo handelsgym.": "Oslo Handelsgymnasium",
    "oslo handelsgym": "Oslo Handelsgymnasium",
    "oslo handelsgymnasium": "Oslo Handelsgymnasium",
    "vika videregående": "Vika videregående skole",
    "kyrsæterøra videregående skole": "Kyrksæterøra videregående skole",
    "verdal videregåendende skole": "Verdal videregående skole",
    "inderøy videregåendende skole": "Inderøy videregående skole",
}
RENAMED = {"Førde vidaregåande skule, avd Høyanger": "Høyanger vidaregåande skule"}
MERGED = {
    "Hafstad videregående skole": ("Førde vidaregåande skule", 2023),
    "Mo og Øyrane vidaregåande skule": ("Førde vidaregåande skule", 2023),
}


def school_identity(name: Column) -> Column:
    """struct(school, merged_from, merged_year): the name to publish under; the last two only for a school that another took in."""
    known = F.coalesce(looked_up(F.lower(squash(name)), SCHOOL_ALIASES), squash(name))
    into = looked_up(known, {old: new for old, (new, _) in MERGED.items()})
    year = looked_up(known, {old: str(since) for old, (_, since) in MERGED.items()}).cast("int")
    return F.struct(
        F.coalesce(into, looked_up(known, RENAMED), known).alias("school"),
        F.when(into.isNotNull(), known).alias("merged_from"),
        year.alias("merged_year"),
    )


def without_digits(name: Column) -> Column:
    """A name into which a column of numbers has run: digits and commas go, blanks become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, "[0-9,]", ""), r"\s+", " "))


def numbered_school(text: Column) -> Column:
    """struct(number, school) of a name after a school number of five digits."""
    number = F.nullif(F.regexp_extract(text, r"^([0-9]{5})(.*)$", 1), F.lit(""))
    return F.struct(number.alias("number"), F.trim(F.when(number.isNotNull(), F.substring(text, F.lit(6), F.length(text))).otherwise(text)).alias("school"))
