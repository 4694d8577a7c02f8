"""Picture candidates of web pages, read from their tags by expressions, without a parser in Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.text import picture_score

#: Where pages name their picture, in the order in which they are believed.
META = ("og:image", "og:image:url", "twitter:image")
MOST_IMAGES = 40
UNREAD = r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>"
TAG = r"(?is)<(?:img|meta)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in double, single or no quotes; empty if it has none."""
    found = rf"(?is)[\s\"'/]{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    value = F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])
    return F.trim(F.replace(F.replace(value, F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&")))


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from a page: whole, without scheme, from the host's root, or beside the page; dots are left as they are."""
    root = F.regexp_extract(base, r"^([a-zA-Z]+://[^/?#]+)", 1)
    path = F.regexp_replace(base, r"[?#].*$", "")
    folder = F.when(path == root, F.concat(root, F.lit("/"))).otherwise(F.regexp_replace(path, r"[^/]*$", ""))
    return (
        F.when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(F.regexp_extract(base, r"^([a-zA-Z]+:)", 1), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .otherwise(F.concat(folder, link))
    )


def picture_candidates(pages: DataFrame, key: str, bonus: int = 0, most: int = MOST_IMAGES) -> DataFrame:
    """(key, place, url, why, score, alt) of the pictures that a page (key, url, html, tokens) offers, by place from 1.

    Pictures named in the head come first and score one more, then the first ``most`` images of the page by position. A link
    that is empty, holds its data or leads to an SVG drawing is none; of several links to one address the first counts; names
    that speak against a building are left out. ``tokens`` are words that speak for the page's own school. Comments, scripts
    and styles are not read; a page without html offers nothing.
    """
    tags = F.regexp_extract_all(F.regexp_replace("html", UNREAD, " "), F.lit(TAG), F.lit(0))
    images = F.slice(F.filter(tags, lambda t: t.rlike("(?i)^<img")), 1, most)
    heads = F.filter(tags, lambda t: t.rlike("(?i)^<meta"))
    read = pages.select(key, "url", "tokens", images.alias("images"), heads.alias("heads"))

    def named(kind: str, name: str, turn: int) -> Column:
        hits = F.filter("heads", lambda t: F.lower(attribute(t, kind)) == name)
        return F.transform(hits, lambda t, i: F.struct(F.lit(turn).alias("turn"), i.alias("pos"), attribute(t, "content").alias("link"), F.lit("").alias("alt"), F.lit(name).alias("why")))

    turns = [named(kind, name, 2 * i + j) for i, name in enumerate(META) for j, kind in enumerate(("property", "name"))]
    source = lambda t: F.coalesce(F.nullif(attribute(t, "src"), F.lit("")), attribute(t, "data-src"))
    turns.append(F.transform("images", lambda t, i: F.struct(F.lit(len(turns)).alias("turn"), i.alias("pos"), source(t).alias("link"), attribute(t, "alt").alias("alt"), F.lit("img").alias("why"))))
    links = read.select(key, F.col("url").alias("page"), "tokens", F.inline(F.concat(*turns))).where("link <> '' and not startswith(link, 'data:')")
    links = links.withColumn("url", absolute(F.col("page"), F.col("link"))).where(~F.lower(F.substring_index("url", "?", 1)).endswith(".svg"))
    scored = links.withColumn("score", picture_score(F.col("url"), F.col("alt"), F.col("tokens"))).where("score > -10")
    first = scored.groupBy(key, "url").agg(F.min_by(F.struct("turn", "pos", "why", "alt", "score"), F.struct("turn", "pos")).alias("f"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("f.turn", "f.pos"))
    return first.select(
        key, place.alias("place"), "url", "f.why", (F.col("f.score") + bonus + F.when(F.col("f.why") != "img", 1).otherwise(0)).alias("score"), F.substring("f.alt", 1, 80).alias("alt")
    )
