"""What a table cell's text means: a threshold, a status, or nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelforge.functions.text import looked_up, replaced, squash

#: How the sources begin a cell of each status, and what they write for no data.
PRIORITY = ("fortrinn", "fortrinnsrett", "fortinnsrett", "fortrinsrett")
GONE = ("utgår", "utgar", "utgått", "lagt ned")
DOCUMENTATION = (
    "dokumentasjon", "dok.", "individuell", "intervju", "inntak etter en kombinasjon", "kombinasjon av karakterer",
    "kombinasjon av ferdighet", "kombinasjon av intervju",
)
OPEN = ("ingen vente", "ingen ventelis", "ledige", "alle søkere", "alle sokere", "alle som søkte", "alle", "ingen venteliste", "ingen ventesliste")
EMPTY = ("", "-", "–", "—", ".", "..", "n/a", "ikke aktuelt")
LEAST, MOST = 8.0, 65.0


def _begins(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.startswith(text, w))


def _number(text: Column, pattern: str, least: float) -> Column:
    found = F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    value = F.regexp_replace(found, ",", ".").try_cast("double")
    return F.when(value.between(least, MOST), value)


def classified(text: Column, least: float = LEAST, loose: bool = False) -> Column:
    """struct(status, points): status is points, open, F, D or U, null for no data.

    ``least`` is the least plausible threshold; ``loose`` also takes a number at the beginning of a longer text.
    """
    # the cleaned text is a variable of a lambda, so that it is made once and not again for each word it is compared with
    clean = F.array(F.trim(F.regexp_replace(F.lower(squash(text)), r"\*+$", "")))
    return F.get(F.transform(clean, lambda t: _meaning(t, least, loose)), F.lit(0))


def _meaning(t: Column, least: float, loose: bool) -> Column:
    points = _number(t, r"^([0-9]{1,2}([.,][0-9]{1,2})?)$", least)
    if loose:
        points = F.coalesce(points, _number(t, r"^([0-9]{1,2}([.,][0-9]{1,2})?)\b", least))
    status = (
        F.when(t.isin(*EMPTY), None)
        .when(_begins(t, PRIORITY), "F")
        .when(_begins(t, GONE), "U")
        .when(_begins(t, DOCUMENTATION), "D")
        .when(_begins(t, OPEN), "open")
        .when(points.isNotNull(), "points")
    )
    return F.struct(status.alias("status"), F.when(status == "points", points).alias("points"))


def classified_older(text: Column) -> Column:
    """The older rule of one county: anything that begins with "fort" is F, and numbers have no bounds."""
    t = F.lower(squash(text))
    value = F.regexp_replace(F.nullif(F.regexp_extract(t, r"^([0-9]{1,2}([.,][0-9]{1,2})?)$", 1), F.lit("")), ",", ".")
    points = value.try_cast("double")
    status = F.when(F.startswith(t, F.lit("fort")), "F").when(_begins(t, OPEN), "open").when(points.isNotNull(), "points")
    return F.struct(status.alias("status"), F.when(status == "points", points).alias("points"))


#: Names by their spelling in the sources, lower case.
PROGRAM_ALIASES = {
    "språk, samfunnsfag og økonomi": "Språk, samfunn og økonomi",
    "helse og oppvekstfag": "Helse- og oppvekstfag",
    "restaurant og matfag": "Restaurant- og matfag",
    "bygg og anleggsteknikk": "Bygg- og anleggsteknikk",
    "teknologi og industrifag": "Teknologi- og industrifag",
    "barne- og ungdomsarbeiderfag": "Barne- og ungdomsarbeider",
    "helsearbeider": "Helsearbeiderfag",
    "elektro og datateknologi": "Elektro og datateknologi",
    "informasjonsteknologi og medieproduksjon": "Informasjonsteknologi og medieproduksjon",
    "frisør, blom., int. og eksp.design": "Frisør, blomster, interiør og eksponeringsdesign",
    "håndverk, design og produktutvikling": "Håndverk, design og produktutvikling",
    "salg, service og reiseliv": "Salg, service og reiseliv",
    "fbie": "Frisør, blomster, interiør og eksponeringsdesign",
    "teknikk og industrifag": "Teknologi- og industrifag",
    "studespesialisering": "Studiespesialisering",
    "studespesialisering, entreprenørskap": "Studiespesialisering, entreprenørskap",
    "musikk, dans, drama": "Musikk, dans og drama",
    "kunst, design og arkitektur (kda)": "Kunst, design og arkitektur",
    "elektro og datatekologi": "Elektro og datateknologi",
    "helse-og oppvekstfag": "Helse- og oppvekstfag",
    "studiespesialisering,toppidrett": "Studiespesialisering, toppidrett",
    "frisør, blomst, int., eksp. design": "Frisør, blomster, interiør og eksponeringsdesign",
    "frisør, blomster, interiør og eksponeringsdesign": "Frisør, blomster, interiør og eksponeringsdesign",
    "bygg og anlegg": "Bygg- og anleggsteknikk",
    "håndverk, design, produktutv": "Håndverk, design og produktutvikling",
    "it og medieproduksjon": "Informasjonsteknologi og medieproduksjon",
    "inform.tekn og medieprod, inform.tekn sk 3 år": "Informasjonsteknologi og medieproduksjon, SK 3 år",
    "teknologi og idustrifag": "Teknologi- og industrifag",
    "elektro og datateknologi, , sk 3 år": "Elektro og datateknologi, SK 3 år",
    "studiespesialiseriing, internasjonalisering": "Studiespesialisering, internasjonalisering",
    "helse- og oppvekst, studiekompetanse": "Helse- og oppvekstfag, studiekompetanse",
    "studiespesialisering, ib": "Studiespesialisering, forberedende IB",
    "studiespesialisering, topppidrett": "Studiespesialisering, toppidrett",
    "frisør, blomst, int, eksp. design": "Frisør, blomster, interiør og eksponeringsdesign",
    "inform.ekn og medieprod, inform.tekn sk 3 år": "Informasjonsteknologi og medieproduksjon, SK 3 år",
    "inform.tekn og medieprod. sk 3 år": "Informasjonsteknologi og medieproduksjon, SK 3 år",
}
FIRST_YEAR = (
    "studiespesialisering", "idrettsfag", "kunst, design og arkitektur", "medier og kommunikasjon", "musikk, dans og drama",
    "bygg- og anleggsteknikk", "elektro og datateknologi", "elektrofag", "design og håndverk",
    "frisør, blomster, interiør og eksponeringsdesign", "helse- og oppvekstfag", "håndverk, design og produktutvikling",
    "informasjonsteknologi og medieproduksjon", "naturbruk", "restaurant- og matfag", "service og samferdsel",
    "salg, service og reiseliv", "teknologi- og industrifag", "teknikk og industriell produksjon",
)
THIRD_YEAR = ("påbygg til generell studiekompetanse",)


def program_name(text: Column) -> Column:
    """One spelling for a programme: known names are looked up before and after the general rules."""
    known = lambda c: F.coalesce(looked_up(F.lower(c), PROGRAM_ALIASES), c)
    early = replaced(
        squash(text),
        (r",(\S)", ", $1"),
        (r"\s*\.\s*$", ""),
        (r"^[ \-–,]+|[ \-–,]+$", ""),
        (r"\bSK\s*([0-9])\s*år", "SK $1 år"),
        (r"\bSK\s*([0-9])$", "SK $1 år"),
        (r"(?i)\s+vg\s?[1-4]$", ""),
    )
    return known(
        replaced(
            known(early),
            (r"\bYSK\s*\(?\s*([0-9])\s*år\)?", "YSK $1 år"),
            ("^(Bygg|Helse|Restaurant|Teknologi) og ", "$1- og "),
            (r"\bint\.\s*eksp\.", "int, eksp."),
            (r"\beksp\.(\S)", "eksp. $1"),
        )
    )


def level_of(program: Column, explicit: Column | None = None) -> Column:
    lower = F.lower(program)
    guess = F.when(lower.isin(*FIRST_YEAR), "Vg1").when(lower.isin(*THIRD_YEAR), "Vg3").otherwise("Vg2/Vg3")
    return guess if explicit is None else F.coalesce(F.nullif(explicit, F.lit("")), guess)


#: What one source writes instead of a status.
SYMBOLS = {"*": "D", "**": "open", "***": "D"}


def classified_symbols(text: Column, least: float = LEAST) -> Column:
    """struct(status, points) where a cell that is a symbol only has that symbol's status."""
    symbol, plain = looked_up(F.trim(text), SYMBOLS), classified(text, least)
    return F.struct(
        F.coalesce(symbol, plain["status"]).alias("status"), F.when(symbol.isNull(), plain["points"]).alias("points")
    )
