"""Printed tables, made of the panel as words on pages, read back by the plans for each layout.

The words are made by one text in both dialects; each query's SQL reads them in its own way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions.text import BAD, GOOD
from panelforge.operators import grids, pictures
from panelforge.plans.panel import PANEL_SQL, panel, programs, table
from panelforge.plans.stored import stored


def words(spark, made: str, numbered: DataFrame, then: str) -> DataFrame:
    """``made`` from the CTE ``then`` on, which follows ``numbered``; the cells with their numbers are written once, for the words
    are a union of many looks at them, and so are the words, at which a plan looks more than once."""
    rest = made.split(f",\n{then} AS ", 1)[1]
    return stored(spark.sql(f"WITH numbered AS (SELECT * FROM {{numbered}}),\n{then} AS {rest}", numbered=stored(numbered, "numbered")), "words")


def _ranked(cells: DataFrame, of: list[str], by: str, name: str, first: int) -> DataFrame:
    """Add ``name``: the dense rank of ``by`` within ``of``, from ``first``. Only the different values are put in order, so a
    task's sort holds a document's schools or programmes and not its cells."""
    keys = [*of, by]
    ranks = cells.select(*keys).distinct().withColumn(name, F.dense_rank().over(Window.partitionBy(*of).orderBy(by)) + (first - 1))
    ranks = ranks.select(*[F.col(k).alias(f"_{k}") for k in keys], name)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return cells.join(ranks, same).drop(*[f"_{k}" for k in keys])


def _numbered(spark, sf_dir, first: int) -> DataFrame:
    """The panel with numbers of schools and programmes within county and year."""
    cells = stored(panel(spark, sf_dir).withColumn("doc", F.concat("county", F.lit(" "), F.col("year").cast("string"))), "panel")
    return _ranked(_ranked(cells, ["county", "year"], "program", "pn", first), ["county", "year"], "school", "sn", first)


#: How a cell is printed.
CELL = "CASE WHEN status = 'open' THEN 'Ledige' WHEN status = 'F' THEN 'fortrinn' ELSE CAST(CAST(points AS INT) AS STRING) || ',5' END"

#: Each three years are a document, with four schools on a page. A school's name is whole, or its second word stands in a line of its own after the
#: first row or after the last, or its second half of rows has the first word only. Even pages have the header.
ROLLING = f"""
WITH dated AS (SELECT county || ' ' || CAST(year - year % 3 AS STRING) AS doc, year - year % 3 AS base, * FROM {{panel}}),
numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY school) - 1 AS sn, dense_rank() OVER (PARTITION BY doc, school ORDER BY level, program) AS rn,
    dense_rank() OVER (PARTITION BY doc, school, level ORDER BY program) AS ln FROM dated),
placed AS (SELECT *, CAST(floor(sn / 4) AS INT) AS page, 100 + 400 * (sn % 4) + 12 * rn AS top FROM numbered),
shifted AS (SELECT *, 3 * ((page - page % 2) % 4) AS dx FROM placed),
lines AS (SELECT DISTINCT doc, base, page, dx, sn, school, program, level, rn, ln, top FROM shifted),
ends AS (SELECT doc, page, sn, max(top) AS top FROM lines GROUP BY doc, page, sn),
heads AS (SELECT DISTINCT doc, base, page, dx FROM lines WHERE page % 2 = 0),
made AS (
  SELECT doc, page, 'Skole' AS text, 40 AS x, 50 AS top FROM heads
  UNION ALL SELECT doc, page, 'Nivå', 170 + dx, 50 FROM heads
  UNION ALL SELECT doc, page, 'Programområde', 200 + dx, 51 FROM heads
  UNION ALL SELECT doc, page, CAST(base + 28 + i AS STRING), 360 + dx + 80 * i, 50 FROM heads JOIN (VALUES (0), (1), (2)) AS years(i) ON i >= 0
  UNION ALL SELECT doc, page, 'Poenggrense for sist inntatte', 40, 20 FROM heads
  UNION ALL SELECT doc, page, school, 40, top FROM lines WHERE rn = 1 OR (sn % 4 = 3 AND rn = 6)
  UNION ALL SELECT doc, page, 'skole', 150, top FROM lines WHERE rn = 1 AND sn % 4 IN (0, 3)
  UNION ALL SELECT doc, page, 'skole', 40, top + 6 FROM lines WHERE rn = 1 AND sn % 4 = 1
  UNION ALL SELECT doc, page, 'skole', 40, top + 6 FROM ends WHERE sn % 4 = 2
  UNION ALL SELECT doc, page, substr(level, 3, 1), 172 + dx, top FROM lines WHERE ln = 1
  UNION ALL SELECT doc, page, program, 202 + dx, top FROM lines
  UNION ALL SELECT doc, page, {CELL}, 360 + dx + 80 * (year - base) + 4 * (rn % 3), top FROM shifted
  UNION ALL SELECT doc, page, 'plasser', 382 + dx + 80 * (year - base) + 4 * (rn % 3), top FROM shifted WHERE status = 'open')
SELECT doc, page, text, CAST(x AS DOUBLE) AS x0, CAST(x + 4 * length(text) AS DOUBLE) AS x1, CAST(top AS DOUBLE) AS top FROM made"""


def rolling_matrix(spark, sf_dir):
    """Three-year tables with names that go on in the next lines."""
    base = F.col("year") - F.col("year") % 3
    cells = stored(panel(spark, sf_dir).select("*", F.concat("county", F.lit(" "), base.cast("string")).alias("doc"), base.alias("base")), "panel")
    of_school = Window.partitionBy("doc", "school")
    numbered = _ranked(cells, ["doc"], "school", "sn", 0).withColumns({
        "rn": F.dense_rank().over(of_school.orderBy("level", "program")), "ln": F.dense_rank().over(Window.partitionBy("doc", "school", "level").orderBy("program")),
    })
    return grids.rolling_matrix(words(spark, ROLLING, numbered, "placed"))


#: Columns are the programmes' codes; every fourth school's number stands apart from its name.
CODES = """
WITH numbered AS (
  SELECT *, dense_rank() OVER (PARTITION BY county, year ORDER BY school) - 1 AS sn, dense_rank() OVER (PARTITION BY county, year ORDER BY program) - 1 AS pn FROM {panel}),
placed AS (SELECT county || ' ' || CAST(year AS STRING) AS doc, CAST(floor(sn / 15) AS INT) AS page, 90 + 12 * (sn % 15) AS top, * FROM numbered),
made AS (
  SELECT DISTINCT doc, page, 'BRAND1' || lpad(substr(program, 7), 2, '0') || '--' AS text, 300 + 40 * pn AS x, 40 AS top FROM placed
  UNION ALL SELECT DISTINCT doc, page, 'Skoleår', 10, 42 FROM placed
  UNION ALL SELECT DISTINCT doc, page, '20242025', 10, top FROM placed
  UNION ALL SELECT DISTINCT doc, page, CAST(50001 + sn AS STRING) || CASE WHEN sn % 4 = 0 THEN '' ELSE school END, 60, top + 1 FROM placed
  UNION ALL SELECT DISTINCT doc, page, CASE WHEN sn % 4 = 0 THEN school ELSE 'videregående' END, 150, top FROM placed
  UNION ALL SELECT DISTINCT doc, page, 'skole', 230, top FROM placed
  UNION ALL SELECT doc, page, CASE WHEN status = 'open' THEN '*' WHEN status = 'F' THEN '0' ELSE CAST(CAST(points AS INT) AS STRING) || ',5' END,
    298 + 40 * pn + 3 * (sn % 4), top FROM placed)
SELECT doc, page, text, CAST(x AS DOUBLE) AS x0, CAST(x + 4 * length(text) AS DOUBLE) AS x1, CAST(top AS DOUBLE) AS top FROM made"""


def code_matrix(spark, sf_dir):
    """Tables under programme codes; the register knows four of five."""
    register = programs(spark, sf_dir).where("cast(substr(program, 7) as int) % 5 <> 0").selectExpr(
        "'BRAND1' || lpad(substr(program, 7), 2, '0') || '--' AS code", "program AS nob"
    )
    return grids.code_matrix(words(spark, CODES, _numbered(spark, sf_dir, 0).drop("doc"), "placed"), register.distinct())


#: Rows in the order of level, school and programme, thirty a page. Of three years' layouts one has a column of levels, one
#: names the block's level in the header, and one neither, with other columns; every block begins with a header and a line
#: for its level, and some rows are printed again with another value.
LISTS = f"""
WITH numbered AS (
  SELECT *, row_number() OVER (PARTITION BY county, year ORDER BY level, school, program) - 1 AS rn,
    row_number() OVER (PARTITION BY county, year, level ORDER BY school, program) - 1 AS ln FROM {{panel}}),
placed AS (
  SELECT county || ' ' || CAST(year AS STRING) AS doc, CAST(floor(rn / 30) AS INT) AS page, 100 + 12 * (rn % 30) AS top, year % 3 AS kind,
    CASE WHEN year % 3 = 2 THEN 170 ELSE 200 END AS px, * FROM numbered),
heads AS (SELECT DISTINCT doc, page, kind, px FROM placed WHERE ln = 0),
made AS (
  SELECT doc, page, CASE WHEN kind = 0 THEN 'Skole' ELSE 'Skule' END AS text, 40 AS x, 40 AS top FROM heads
  UNION ALL SELECT doc, page, 'namn', 75, 40 FROM heads
  UNION ALL SELECT doc, page, CASE WHEN kind = 2 THEN 'Programområdenamn' ELSE 'Programområde' END, px, 41 FROM heads
  UNION ALL SELECT doc, page, CASE WHEN kind = 0 THEN 'Vg1' ELSE 'Nivå' END, 400, 40 FROM heads WHERE kind < 2
  UNION ALL SELECT doc, page, 'Nedre', 423, 40 FROM heads
  UNION ALL SELECT doc, page, 'poenggrense', 450, 40 FROM heads
  UNION ALL SELECT doc, page, level, 40, top - 4 FROM placed WHERE ln = 0 AND kind <> 1
  UNION ALL SELECT doc, page, 'Oversikt', 40, 20 FROM heads
  UNION ALL SELECT doc, page, school, 40, top FROM placed
  UNION ALL SELECT doc, page, 'skule', 130, top FROM placed
  UNION ALL SELECT doc, page, program, px + 2, top FROM placed
  UNION ALL SELECT doc, page, 'linje', px + 60, top FROM placed
  UNION ALL SELECT doc, page, substr(level, 3, 1), 402, top FROM placed WHERE kind = 1
  UNION ALL SELECT doc, page, {CELL}, 412 + rn % 7, top FROM placed
  UNION ALL SELECT doc, page, 'plasser', 442 + rn % 7, top FROM placed WHERE status = 'open'
  UNION ALL SELECT doc, page, school || ' skule', 40, top + 4 FROM placed WHERE rn % 41 = 5
  UNION ALL SELECT doc, page, program, px + 2, top + 4 FROM placed WHERE rn % 41 = 5
  UNION ALL SELECT doc, page, 'linje', px + 60, top + 4 FROM placed WHERE rn % 41 = 5
  UNION ALL SELECT doc, page, substr(level, 3, 1), 402, top + 4 FROM placed WHERE rn % 41 = 5 AND kind = 1
  UNION ALL SELECT doc, page, '9,9', 415, top + 4 FROM placed WHERE rn % 41 = 5)
SELECT doc, page, text, CAST(x AS DOUBLE) AS x0, CAST(x + 4 * length(text) AS DOUBLE) AS x1, CAST(top AS DOUBLE) AS top FROM made"""


def listed_thresholds(spark, sf_dir):
    """Lists in three layouts, the header only where a block begins."""
    cells = stored(panel(spark, sf_dir), "panel")
    # the number of a row is that of its school's rows in a level, and how many rows of the document or level come before them
    blocks = cells.groupBy("county", "year", "level", "school").agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("county", "year").orderBy("level", "school")
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(
        *[F.col(k).alias(f"_{k}") for k in ("county", "year", "level", "school")], before(upto).alias("of_doc"),
        before(Window.partitionBy("county", "year", "level").orderBy("school")).alias("of_level"),
    )
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in ("county", "year", "level", "school")])
    own = F.row_number().over(Window.partitionBy("county", "year", "level", "school").orderBy("program")) - 1
    numbered = cells.withColumn("own", own).join(blocks, same)
    numbered = numbered.select(*cells.columns, (F.col("of_doc") + F.col("own")).alias("rn"), (F.col("of_level") + F.col("own")).alias("ln"))
    return grids.listed_thresholds(words(spark, LISTS, numbered, "placed"))


#: Cells of two cuts of the same figures: tables by programme, then tables by school with the rounds the other way round and
#: programmes in another case. Each leaves out other pairs, and the second has other values.
CUTS = """
WITH numbered AS (
  SELECT county || ' ' || CAST(year AS STRING) AS doc, *, dense_rank() OVER (PARTITION BY county, year ORDER BY school) AS sn,
    dense_rank() OVER (PARTITION BY county, year ORDER BY program) AS pn FROM {panel}),
printed AS (
  SELECT *, CASE WHEN status = 'open' AND pn % 2 = 0 THEN 'Alle  som søkte' WHEN v1 IS NULL THEN '-' ELSE CAST(CAST(v1 AS INT) AS STRING) || ',0' END AS c1,
    CASE WHEN status = 'F' THEN '' WHEN v2 IS NULL THEN '-' ELSE CAST(CAST(v2 AS INT) AS STRING) || ',0' END AS c2,
    CASE WHEN v2 IS NULL THEN 'utgår' ELSE CAST(CAST(v2 AS INT) + 1 AS STRING) || ',0' END AS other FROM numbered),
tables AS (
  SELECT DISTINCT doc, pn AS table_no, 'Utdanning – ' || program AS heading, 'Skole' AS first, '1. inntak' AS a, '2. inntak' AS b FROM printed
  UNION ALL SELECT DISTINCT doc, 1000 + sn, school || ' vgs.', 'Utdanningsprogram', '2. inntak', '1. inntak' FROM printed
  UNION ALL SELECT DISTINCT doc, 100000, 'no programme', 'Skole', '1. inntak', '2. inntak' FROM printed),
lines AS (
  SELECT doc, pn AS table_no, sn AS row_no, 'Utdanning – ' || program AS heading, ' ' || school AS first, c1 AS a, c2 AS b FROM printed WHERE (sn + pn) % 5 <> 0
  UNION ALL SELECT doc, 1000 + sn, pn, school || ' vgs.', upper(program), other, c1 FROM printed WHERE (sn + pn) % 3 <> 0
  UNION ALL SELECT doc, 100000, sn, 'no programme', school, c1, c2 FROM printed WHERE pn = 1
  UNION ALL SELECT DISTINCT doc, pn, 100000, 'Utdanning – ' || program, 'Poenggrense 0,0 betyr kø', '', '' FROM printed
  UNION ALL SELECT doc, table_no, 0, heading, first, a, b FROM tables)
SELECT doc, table_no, row_no, i AS col_no, CASE i WHEN 0 THEN first WHEN 1 THEN a ELSE b END AS text, heading
FROM lines JOIN (VALUES (0), (1), (2)) AS places(i) ON i >= 0"""


def two_cuts(spark, sf_dir):
    """Figures that a page prints by programme and by school, each once."""
    return grids.two_cuts(words(spark, CUTS, _numbered(spark, sf_dir, 1), "printed"))


_PLACES = ", ".join(f"({i})" for i in range(1, 33))
#: Glyphs: rows of a school's number, its name and a value under each programme. Programmes stand upright above their
#: columns, bottom to top, in two lines; another glyph stands far above, and the title runs through the labels in a font of its
#: own. In every other year numbers and names are set so close that only the smaller tolerance parts them.
GLYPHS = f"""
WITH numbered AS (
  SELECT county || ' ' || CAST(year AS STRING) AS doc, *, dense_rank() OVER (PARTITION BY county, year ORDER BY school) - 1 AS sn,
    dense_rank() OVER (PARTITION BY county, year ORDER BY program) - 1 AS pn FROM {{panel}}),
placed AS (SELECT *, CAST(floor(sn / 20) AS INT) AS page, 210 + 12 * (sn % 20) AS top, 160 + 24 * pn AS c FROM numbered),
valued AS (SELECT *, CASE WHEN status = 'open' THEN '**' WHEN status = 'F' THEN '***' ELSE CAST(CAST(points AS INT) AS STRING) || ',5' END AS cell FROM placed),
made AS (
  SELECT DISTINCT doc, page, CAST(3000 + sn AS STRING) AS text, 20 AS x, 4 AS dx, top, 0 AS dy, 'Body' AS font FROM placed
  UNION ALL SELECT DISTINCT doc, page, translate(substr(school, 14), '0123456789', 'ABCDEFGHIJ') || ' vg. skole', CASE WHEN year % 2 = 0 THEN 38 ELSE 42 END, 4, top + 1, 0, 'Body' FROM placed
  UNION ALL SELECT DISTINCT doc, page, substr(program, 1, 6), c - 6, 0, 190, -5, 'Label' FROM placed
  UNION ALL SELECT DISTINCT doc, page, substr(program, 7), c + 2, 0, 190, -5, 'Label' FROM placed
  UNION ALL SELECT DISTINCT doc, page, 'x', c - 6, 0, 135, 0, 'Label' FROM placed
  UNION ALL SELECT DISTINCT doc, page, 'Poenggrenser for inntak', 150, 4, 172, 0, 'Title' FROM placed
  UNION ALL SELECT doc, page, cell, c - 2 * CAST(length(cell) AS INT), 4, top, 0, 'Body' FROM valued)
SELECT doc, page, substr(text, i, 1) AS text, CAST(x + dx * (i - 1) AS DOUBLE) AS x0, CAST(x + dx * (i - 1) + 4 AS DOUBLE) AS x1,
  CAST(top + dy * (i - 1) AS DOUBLE) AS top, font
FROM made JOIN (VALUES {_PLACES}) AS places(i) ON i <= length(text)"""


def rotated_matrix(spark, sf_dir):
    """Tables under upright labels, from single glyphs."""
    return grids.rotated_matrix(words(spark, GLYPHS, _numbered(spark, sf_dir, 0), "placed"))


#: Pages whose links have become images, with pictures named in the head and images of other forms; the same text in both
#: dialects.
PICTURED = """SELECT page_id, url, replace(replace(replace(replace(html, '<a href="', '<img alt="Hovedbygg" src="'),
    '<title>', '<meta property="og:image" content="//cdn.example.org/' || CAST(page_id AS STRING) || '/fasade.jpg?a=1&amp;b=2"><META content=' || chr(39) || '/skolen.jpg' || chr(39) || ' name="twitter:image"><title>'),
    '<h1>', '<IMG src="/static/x.svg?v=1"><img src="data:image/png;base64,xx"><img alt="a > b" src=bygg.jpg><img src="" data-src="https://m.example.org/logo.png"><img src="/skolen.jpg"><h1>'),
    '<!-- ad', '<!-- <img src="/hidden.jpg"> ad') AS html
FROM {pages}"""


def picture_candidates(spark, sf_dir):
    """Pictures that each page offers, scored by their names and the words of the page's host."""
    pages = spark.sql(PICTURED, pages=table(spark, sf_dir, "pages"))
    tokens = F.split(F.regexp_extract("url", r"//(?:www\.|m\.)?([a-z-]+)", 1), "-")
    return pictures.picture_candidates(pages.withColumn("tokens", F.filter(tokens, lambda w: F.length(w) > 3)), "page_id")


def _listed(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _attribute(name: str) -> str:
    found = f"""(?is)[\\s"''/]{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))"""
    parts = " || ".join(f"regexp_extract(tag, '{found}', {i})" for i in (1, 2, 3))
    return f"replace(trim({parts}), '&amp;', '&')"


def _sql(made: str) -> str:
    """The words, and their lines, as the SQL of a query begins."""
    return f"""WITH {PANEL_SQL}, words AS ({made.format(panel="panel")}),
  tops AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY doc, page ORDER BY top) > 2.5 THEN 1 ELSE 0 END AS new FROM words),
  lined AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY top) AS line FROM tops)"""


#: What a printed cell means; these tables print no other.
MEANS = r"""CASE WHEN regexp_matches({0}, '^Ledige plasser$') THEN 'open' WHEN {0} = 'fortrinn' THEN 'F' WHEN regexp_matches({0}, '^[0-9]{{1,2}}(,[0-9])?$') THEN 'points' END AS status,
    CASE WHEN regexp_matches({0}, '^[0-9]{{1,2}}(,[0-9])?$') THEN CAST(replace({0}, ',', '.') AS DOUBLE) END AS points"""

QUERIES = {
    "picture_candidates": (picture_candidates, f"""WITH made AS ({PICTURED.format(pages="pages")}),
      found AS (SELECT page_id, url AS page, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM (SELECT *, regexp_extract_all(
        regexp_replace(html, '(?is)<!--.*?-->|<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?i)<(?:img|meta)\\b(?:[^>"'']|"[^"]*"|''[^'']*'')*>') AS tags FROM made)),
      read AS (SELECT page_id, page, pos, regexp_matches(tag, '(?i)^<img') AS is_img, {_attribute("content")} AS content, {_attribute("property")} AS property, {_attribute("name")} AS name,
        {_attribute("src")} AS src, {_attribute("data-src")} AS data_src, {_attribute("alt")} AS alt FROM found),
      named AS (SELECT page_id, page, pos, CASE lower(coalesce(nullif(property, ''), name)) WHEN 'og:image' THEN 0 WHEN 'og:image:url' THEN 1 WHEN 'twitter:image' THEN 2 END AS turn, content AS link, '' AS alt,
        lower(coalesce(nullif(property, ''), name)) AS why FROM read WHERE NOT is_img
        UNION ALL SELECT page_id, page, pos, 9, coalesce(nullif(src, ''), data_src), alt, 'img' FROM read WHERE is_img QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) <= 40),
      linked AS (SELECT *, CASE WHEN regexp_matches(link, '^[a-z]+:') THEN link WHEN link LIKE '//%' THEN regexp_extract(page, '^[a-z]+:') || link
        WHEN link LIKE '/%' THEN regexp_extract(page, '^[a-z]+://[^/?#]+') || link ELSE regexp_extract(regexp_replace(page, '[?#].*$', ''), '^(.*/)', 1) || link END AS url,
        list_filter(string_split(regexp_extract(page, '//(?:www[.]|m[.])?([a-z-]+)', 1), '-'), lambda w: length(w) > 3) AS tokens
        FROM named WHERE turn IS NOT NULL AND link <> '' AND link NOT LIKE 'data:%'),
      hays AS (SELECT *, lower(url) || ' ' || lower(alt) AS hay, string_split(lower(url) || ' ' || lower(alt), '/')[-1] AS tail FROM linked WHERE NOT lower(string_split(url, '?')[1]) LIKE '%.svg'),
      scored AS (SELECT *, CASE WHEN len(list_filter({_listed(BAD)}, lambda w: contains(tail, w))) > 0 OR len(list_filter(['logo', 'ikon', 'favicon'], lambda w: contains(hay, w))) > 0 THEN -10
        ELSE 3 * len(list_filter({_listed(GOOD)}, lambda w: contains(tail, w))) + 4 * len(list_filter(tokens, lambda w: contains(tail, w))) END AS points FROM hays),
      kept AS (SELECT * FROM scored WHERE points > -10 QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY turn, pos) = 1)
      SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY turn, pos) AS INTEGER) AS place, url, why, CAST(points + CASE WHEN turn < 9 THEN 1 ELSE 0 END AS INTEGER) AS score,
        substr(alt, 1, 80) AS alt FROM kept"""),
    "two_cuts": (two_cuts, f"""WITH {PANEL_SQL}, cells_of AS ({CUTS.format(panel="panel")}),
      header AS (SELECT doc, table_no, any_value(heading) AS heading, max(text) FILTER (col_no = 0) AS h0, max(col_no) FILTER (text LIKE '1.%') AS i1, max(col_no) FILTER (text LIKE '2.%') AS i2
        FROM cells_of WHERE row_no = 0 GROUP BY ALL),
      rows AS (SELECT c.doc, c.table_no, row_no, h0, h.heading, trim(max(text) FILTER (col_no = 0)) AS first, max(text) FILTER (col_no = i1) AS c1, max(text) FILTER (col_no = i2) AS c2
        FROM cells_of c JOIN header h ON c.doc = h.doc AND c.table_no = h.table_no WHERE row_no > 0 GROUP BY ALL),
      named AS (SELECT *, CASE WHEN h0 LIKE 'Utdanningsprogram%' THEN regexp_replace(heading, ' vgs[.]$', '') ELSE first END AS school,
        CASE WHEN h0 LIKE 'Utdanningsprogram%' THEN first ELSE regexp_extract(heading, '– (.*)$', 1) END AS program FROM rows WHERE first NOT LIKE 'Poenggrense%'),
      read AS (SELECT *, CASE WHEN c1 LIKE 'Alle%' THEN 'open' WHEN c1 LIKE '%,%' THEN 'points' END AS s1, CASE WHEN c2 = 'utgår' THEN 'U' WHEN c2 LIKE '%,%' THEN 'points' END AS s2 FROM named WHERE program <> ''),
      kept AS (SELECT * FROM read WHERE s1 IS NOT NULL OR s2 IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc, school, lower(program) ORDER BY table_no, row_no) = 1),
      valued AS (SELECT *, CASE WHEN s1 = 'points' THEN CAST(replace(c1, ',', '.') AS DOUBLE) END AS p1, CASE WHEN s2 = 'points' THEN CAST(replace(c2, ',', '.') AS DOUBLE) END AS p2 FROM kept)
      SELECT doc, school, program, 'Vg1' AS level, coalesce(s2, s1) AS status, CASE WHEN s2 IS NULL THEN p1 ELSE p2 END AS points, s1 AS r1_status, p1 AS r1_points,
        CASE WHEN s2 IS NULL THEN '1' END AS round_note FROM valued"""),
    "rotated_matrix": (rotated_matrix, f"""WITH {PANEL_SQL}, glyphs AS (SELECT *, (x0 + x1) / 2 AS cx FROM ({GLYPHS.format(panel="panel")}) WHERE text <> ' '),
      tops AS (SELECT *, CASE WHEN top - lag(top) OVER (PARTITION BY doc, page ORDER BY top) > 3 THEN 1 ELSE 0 END AS new FROM glyphs),
      lined AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY top) AS line FROM tops),
      gaps AS (SELECT l.*, tol, CASE WHEN x0 - lag(x1) OVER (PARTITION BY doc, page, line, tol ORDER BY x0) > tol THEN 1 ELSE 0 END AS starts FROM lined l, (VALUES (3.0), (1.5)) AS t(tol)),
      runs AS (SELECT *, sum(starts) OVER (PARTITION BY doc, page, line, tol ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS word FROM gaps),
      words AS (SELECT doc, page, line, tol, min(x0) AS x0, max(x1) AS x1, min(top) AS top, string_agg(text, '' ORDER BY x0) AS text FROM runs GROUP BY doc, page, line, tol, word),
      valid AS (SELECT doc, page, max(tol) AS tol FROM words WHERE regexp_matches(text, '^[0-9]{{4}}$') AND x0 < 60 GROUP BY doc, page),
      used AS (SELECT w.* FROM words w JOIN valid USING (doc, page, tol)),
      numbers AS (SELECT * FROM used WHERE regexp_matches(text, '^[0-9]{{4}}$') AND x0 < 60),
      firsts AS (SELECT doc, page, min(top) AS first FROM numbers GROUP BY doc, page),
      middles AS (SELECT doc, page, (x0 + x1) / 2 AS cx FROM used JOIN firsts USING (doc, page) WHERE top >= first - 2 AND (x0 + x1) / 2 > 100 AND regexp_matches(text, '^([0-9]{{1,2}}(,[0-9]{{1,2}})?|[*]{{1,3}})$')),
      cut AS (SELECT *, CASE WHEN cx - lag(cx) OVER (PARTITION BY doc, page ORDER BY cx) > 8 THEN 1 ELSE 0 END AS new FROM middles),
      clusters AS (SELECT *, sum(new) OVER (PARTITION BY doc, page ORDER BY cx) AS col FROM cut),
      cols AS (SELECT doc, page, col, avg(cx) AS c FROM clusters GROUP BY ALL),
      band AS (SELECT g.doc, g.page, col, text, cx, top, font FROM glyphs g JOIN firsts f ON g.doc = f.doc AND g.page = f.page JOIN cols k ON k.doc = g.doc AND k.page = g.page
        WHERE top > 40 AND top < first - 4 AND abs(cx - c) <= 9),
      fonts AS (SELECT doc, page, col, arg_max(font, n) AS font FROM (SELECT doc, page, col, font, count(*) AS n FROM band GROUP BY ALL) GROUP BY ALL),
      main AS (SELECT band.* FROM band JOIN fonts USING (doc, page, col, font)),
      beside AS (SELECT *, CASE WHEN cx - lag(cx) OVER (PARTITION BY doc, page, col ORDER BY cx) > 3 THEN 1 ELSE 0 END AS new FROM main),
      subs AS (SELECT *, sum(new) OVER (PARTITION BY doc, page, col ORDER BY cx) AS sub FROM beside),
      up AS (SELECT *, CASE WHEN lag(top) OVER (PARTITION BY doc, page, col, sub ORDER BY top DESC) - top > 12 THEN 1 ELSE 0 END AS gap FROM subs),
      near AS (SELECT *, sum(gap) OVER (PARTITION BY doc, page, col, sub ORDER BY top DESC) AS far FROM up),
      labels AS (SELECT doc, page, col, string_agg(text, '' ORDER BY sub, top DESC) AS program FROM near WHERE far = 0 GROUP BY ALL),
      names AS (SELECT n.doc, n.page, n.line, string_agg(u.text, ' ' ORDER BY u.x0) AS name FROM numbers n JOIN used u ON u.doc = n.doc AND u.page = n.page AND u.line = n.line
        WHERE u.x0 > 30 AND u.x0 < 124 GROUP BY ALL),
      printed AS (SELECT l.doc, l.page, l.line, col, string_agg(text, '' ORDER BY x0) AS cell FROM lined l JOIN cols k ON k.doc = l.doc AND k.page = l.page
        WHERE abs(cx - c) <= 9 AND regexp_matches(text, '^[0-9,*]$') GROUP BY ALL)
      SELECT doc, replace(name, 'vg. skole', 'videregående skole') AS school, program, 'Vg1' AS level, CASE cell WHEN '**' THEN 'open' WHEN '***' THEN 'D' ELSE 'points' END AS status,
        CASE WHEN cell NOT LIKE '*%' THEN CAST(replace(cell, ',', '.') AS DOUBLE) END AS points
      FROM printed JOIN names USING (doc, page, line) JOIN labels USING (doc, page, col)"""),
    "rolling_matrix": (rolling_matrix, f"""{_sql(ROLLING)},
      pages AS (SELECT doc, page, max(x0) FILTER (text = 'Nivå') AS lx, max(x0) FILTER (text LIKE 'Programområde%') AS px,
        list({{'x': x0, 'y': TRY_CAST(text AS INTEGER)}} ORDER BY x0) FILTER (regexp_matches(text, '^20[0-9][0-9]$')) AS ys FROM words GROUP BY doc, page),
      geo AS (SELECT doc, page, last_value(lx IGNORE NULLS) OVER w AS lx, last_value(px IGNORE NULLS) OVER w AS px, last_value(ys IGNORE NULLS) OVER w AS ys
        FROM pages WINDOW w AS (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING)),
      parts AS (SELECT l.*, ys, CASE WHEN x0 < lx - 4 THEN 'name' WHEN x0 < px - 4 THEN 'digit' WHEN x0 < ys[1].x - 8 THEN 'label' ELSE 'value' END AS part FROM lined l JOIN geo USING (doc, page)),
      rows AS (SELECT doc, page, line, string_agg(text, ' ' ORDER BY x0) AS whole, string_agg(text, ' ' ORDER BY x0) FILTER (part = 'name') AS name,
        arg_min(text, x0) FILTER (part = 'digit') AS digit, string_agg(text, ' ' ORDER BY x0) FILTER (part = 'label') AS label, count(*) FILTER (part = 'value') AS n
        FROM parts GROUP BY doc, page, line HAVING NOT regexp_matches(whole, '^(Skole |Poenggrense)')),
      opened AS (SELECT *, sum(CASE WHEN name IS NOT NULL AND (label IS NOT NULL OR n > 0) THEN 1 ELSE 0 END) OVER w AS grp, last_value(digit IGNORE NULLS) OVER w AS lev
        FROM rows WINDOW w AS (PARTITION BY doc ORDER BY page, line ROWS UNBOUNDED PRECEDING)),
      schools AS (SELECT doc, grp, string_agg(name, ' ' ORDER BY page, line) AS school FROM opened WHERE name IS NOT NULL GROUP BY doc, grp),
      longer AS (SELECT a.doc, a.school, min(b.school) AS long FROM (SELECT DISTINCT doc, school FROM schools) a JOIN (SELECT DISTINCT doc, school FROM schools) b
        ON a.doc = b.doc AND starts_with(b.school, a.school || ' ') GROUP BY ALL HAVING count(*) = 1),
      marked AS (SELECT doc, page, line, text, x0, list_sort(list_transform(ys, lambda y: {{'d': abs(y.x + 14 - (x0 + x1) / 2), 'y': y.y}}))[1].y AS year FROM parts WHERE part = 'value'),
      values_of AS (SELECT doc, page, line, year, string_agg(text, ' ' ORDER BY x0) AS cell FROM marked GROUP BY ALL)
      SELECT o.doc, coalesce(l.long, s.school) AS school, o.label AS program, 'Vg' || o.lev AS level, c.year, {MEANS.format("c.cell")}
      FROM values_of c JOIN opened o USING (doc, page, line) JOIN schools s ON s.doc = o.doc AND s.grp = o.grp LEFT JOIN longer l ON l.doc = s.doc AND l.school = s.school
      WHERE o.label IS NOT NULL"""),
    "code_matrix": (code_matrix, f"""{_sql(CODES)},
      register AS (SELECT DISTINCT 'BRAND1' || lpad(substr(p_brand, 7), 2, '0') || '--' AS code, p_brand AS nob FROM part WHERE CAST(substr(p_brand, 7) AS INTEGER) % 5 <> 0),
      codes AS (SELECT DISTINCT doc, page, x0 AS cx, text AS code FROM words WHERE text LIKE 'BRAND1%--'),
      firsts AS (SELECT doc, page, line, arg_min(text, x0) AS first FROM lined GROUP BY ALL),
      rows AS (SELECT l.*, regexp_matches(text, '^([0-9]{{1,2}}(,[0-9])?|[*])$') AS is_value FROM lined l JOIN firsts USING (doc, page, line) WHERE regexp_matches(first, '^[0-9]{{8}}$') AND text <> first),
      names AS (SELECT doc, page, line, string_agg(text, ' ' ORDER BY x0) AS name FROM rows WHERE NOT is_value GROUP BY ALL),
      values_of AS (SELECT v.doc, v.page, v.line, v.text AS cell, v.x0, arg_max(code, cx) AS code FROM rows v JOIN codes c ON c.doc = v.doc AND c.page = v.page AND cx <= (v.x0 + v.x1) / 2 + 8
        WHERE is_value GROUP BY ALL)
      SELECT doc, substr(name, 1, 5) AS number, trim(substr(name, 6)) AS school, nob AS program, 'Vg1' AS level, CASE WHEN cell = '*' THEN 'open' ELSE 'points' END AS status,
        CASE WHEN cell <> '*' THEN CAST(replace(cell, ',', '.') AS DOUBLE) END AS points
      FROM values_of JOIN names USING (doc, page, line) JOIN register USING (code)"""),
    "listed_thresholds": (listed_thresholds, f"""{_sql(LISTS)},
      heads AS (SELECT doc, page, max(x0) FILTER (text LIKE 'Programområde%') AS px, max(x0) FILTER (text = 'Nivå') AS dx, max(x0) FILTER (text = 'Vg1' AND x0 > 100) AS bx, max(x0) FILTER (text = 'Nedre') AS vx
        FROM words GROUP BY doc, page),
      geo AS (SELECT doc, page, last_value(px IGNORE NULLS) OVER w AS px,
        last_value(CASE WHEN px IS NULL THEN NULL WHEN dx BETWEEN px AND vx THEN 'level' WHEN bx BETWEEN px AND vx THEN 'block' ELSE 'plain' END IGNORE NULLS) OVER w AS layout
        FROM heads WINDOW w AS (PARTITION BY doc ORDER BY page ROWS UNBOUNDED PRECEDING)),
      rows AS (SELECT doc, page, line, px, layout, string_agg(text, ' ' ORDER BY x0) AS whole, list({{'x': x0, 't': text}} ORDER BY x0) AS ws FROM lined JOIN geo USING (doc, page) GROUP BY ALL),
      carried AS (SELECT *, coalesce(last_value(nullif(regexp_extract(whole, '^Vg([1-4])', 1), '') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY page, line ROWS UNBOUNDED PRECEDING), '1') AS block FROM rows),
      data AS (SELECT *, CASE WHEN whole LIKE '% Ledige plasser' THEN 2 ELSE 1 END AS k FROM carried WHERE NOT regexp_matches(whole, '^(Vg[1-4]|Skule|Skole|Oversikt)')),
      cut AS (SELECT *, array_to_string(list_transform(ws[len(ws) - k + 1 :], lambda w: w.t), ' ') AS cell, ws[: len(ws) - k] AS body FROM data),
      leveled AS (SELECT *, CASE WHEN regexp_matches(body[-1].t, '^[1-4]$') AND body[-1].x > px THEN body[-1].t END AS digit FROM cut),
      named AS (SELECT doc, page, line, layout, cell, 'Vg' || coalesce(digit, block) AS level, array_to_string(list_transform(list_filter(body, lambda w: w.x < px - 4), lambda w: w.t), ' ') AS school,
        array_to_string(list_transform(list_filter(CASE WHEN digit IS NULL THEN body ELSE body[: len(body) - 1] END, lambda w: w.x >= px - 4), lambda w: w.t), ' ') AS program FROM leveled),
      kept AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY doc, school, program, level ORDER BY page DESC, line DESC) = 1)
      SELECT doc, layout, school, program, level, {MEANS.format("cell")} FROM kept"""),
}
