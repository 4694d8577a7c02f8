"""Maps, identities, rounds, tiers and checks on the star tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from panelforge.functions import cells, text
from panelforge.operators import baselines, rules
from panelforge.operators.baselines import WALK_SQL
from panelforge.plans.panel import OBS_SQL, PANEL_SQL, SERIES, observations, panel, table
from panelforge.plans.stored import stored
from panelforge.queries import evaluation
from panelforge.queries.panels import BRIDGE_SQL, SAMPLES_SQL, samples


def _pick(values, n):
    """One of a few values by a number."""
    return F.get(F.array(*[F.lit(v) for v in values]), (n % len(values)).cast("int"))


def map_explode(spark, sf_dir):
    """Series with a map from year to value, one row for each entry again."""
    series = panel(spark, sf_dir).where("points is not null").groupBy(*SERIES).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("year", "points")))).alias("values")
    )
    return rules.exploded(series, "values", value="points")


def map_overlay_years(spark, sf_dir):
    """Numbers of the first round, filled up with those of the second; how many years each series has, and their sum."""
    of = lambda c: F.map_from_entries(F.array_compact(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("year", c))))))
    both = panel(spark, sf_dir).groupBy(*SERIES).agg(of("v1").alias("a"), of("v2").alias("b"))
    values = F.map_values(rules.merged_maps(F.col("a"), F.col("b")))
    return both.select(*SERIES, F.size(values).alias("years"), F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x).alias("total"))


def catchment(spark, sf_dir):
    """A catchment is shown only where free choice is known to be off."""
    flag = _pick((False, True, None), F.col("n_nationkey"))
    return table(spark, sf_dir, "nation").select("n_nationkey", rules.only_if_false(flag, F.col("n_name")).alias("catchment"))


def message_kind(spark, sf_dir):
    raw = _pick(("feil", "bilde", "spam", None, "forslag"), F.col("event_id"))
    return table(spark, sf_dir, "events").groupBy(rules.kind(raw).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _places(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k, F.when(k % 29 != 0, 57.0 + k * 37 % 160 / 10.0).alias("lat"), F.when(k % 31 == 0, 0.0).otherwise(4.0 + k * 53 % 300 / 10.0).alias("lon")
    )


def coordinate_checks(spark, sf_dir):
    """How many places have coordinates, how many of these lie in the country's box, and whether 99 in 100 are located."""
    here = rules.located(F.col("lat"), F.col("lon"))
    return _places(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(here).alias("located"),
        F.count_if(here & rules.in_box(F.col("lat"), F.col("lon"))).alias("inside"), (F.avg(here.cast("double")) >= 0.99).alias("enough"),
    )


PLACES = """places AS (SELECT s_suppkey, CASE WHEN s_suppkey % 29 <> 0 THEN 57.0 + s_suppkey * 37 % 160 / 10.0 END AS lat,
  CASE WHEN s_suppkey % 31 = 0 THEN 0.0 ELSE 4.0 + s_suppkey * 53 % 300 / 10.0 END AS lon FROM supplier),
  l AS (SELECT *, coalesce(abs(lat) > 1 AND abs(lon) > 1, false) AS here FROM places)"""


def forecast_export(spark, sf_dir):
    """Samples of the newest year with the forecast of their series: only those that have one; numbers rounded, nulls as empty text."""
    cells = stored(panel(spark, sf_dir), "panel")
    preds = evaluation.with_spread(evaluation.predictions(spark, sf_dir, cells)).select(
        *SERIES, F.col("T").alias("year"), *[F.coalesce(F.round(F.round(c, 6), d).cast("string"), F.lit("")).alias(c) for c, d in (("m", 1), ("s", 1), ("pi", 3), ("v", 1))]
    )
    rows = samples(spark, sf_dir, cells).select(*SERIES, "occurrence", "year")
    return rows.join(preds, [*SERIES, "year"])


def uncertain_from_meta(spark, sf_dir):
    """Years that a county's own notes call uncertain, by (county, name); schools without a note have none."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("county"), F.col("s_name").alias("name"), "s_suppkey")
    meta = s.where(k % 5 == 0).select("county", F.when(k % 2 == 0, F.upper("name")).otherwise(F.col("name")).alias("name"), F.array((1995 + k % 3).cast("int"), F.lit(2000)).alias("uncertain"))
    return s.join(meta, ["county", "name"], "left").select("county", "name", F.array_join(F.col("uncertain").cast("array<string>"), ",").alias("uncertain_years"))


def alternate_rounds(spark, sf_dir):
    """Cells of the first round with the value of the second round of the same year, where it was published."""
    both = panel(spark, sf_dir)
    first = both.where("v1 is not null").select(*SERIES, "year", "v1")
    second = both.where("v2 is not null").select(*SERIES, "year", F.col("v2").alias("alternate"))
    return first.join(second, [*SERIES, "year"], "left")


def round_selection(spark, sf_dir):
    """The first round of each cell that was published, and how many other rounds there are."""
    rounds = F.inline(F.array(F.struct(F.lit("1").alias("round"), F.col("v1").alias("value")), F.struct(F.lit("3").alias("round"), F.col("v2").alias("value"))))
    rows = panel(spark, sf_dir).select(*SERIES, "year", rounds).where("value is not null")
    return rules.round_choice(rows, [*SERIES, "year"]).select(*SERIES, "year", "round", "value", F.size("others").alias("others"))


def code_names(spark, sf_dir):
    """Codes of parts with a local name, the register's or none."""
    k = F.col("p_partkey")
    codes = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 3 == 0, _pick(sorted(rules.EXTRA_CODES), k)).otherwise(F.upper(F.substring(F.md5("p_type"), 1, 6))).alias("code"))
    register = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.upper(F.substring(F.md5("p_type"), 1, 6)).alias("code"), F.col("p_type").alias("nob"))
    return rules.code_titles(codes, register).select("p_partkey", "code", "title")


def category_offsets(spark, sf_dir):
    """What a later round is expected to move: by category, else by county, else the default."""
    bridge = baselines.round_bridge(baselines.round_pairs(panel(spark, sf_dir))).where("category is null or n_pairs >= 3")
    nations = table(spark, sf_dir, "region").select(F.col("r_name").alias("county")).unionByName(spark.createDataFrame([("NOWHERE",)], "county string"))
    kinds = panel(spark, sf_dir).select("category").distinct().unionByName(spark.createDataFrame([("NONE",)], "category string"))
    rows = nations.join(F.broadcast(kinds))  # a few counties and a few categories
    return rules.offsets(rows, bridge)


def school_order(spark, sf_dir):
    """Schools by county and name, in the order of their characters."""
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("county"), F.col("s_name").alias("name")).orderBy("county", "name")


SCHOOLS = ("Oslo handelsgym.", "VIKA  videregående", "Hafstad videregående skule", "Hafstad videregående skole", "Førde vidaregåande skule, avd Høyanger", "Bryne vgs", None)


def school_identities(spark, sf_dir):
    """Spellings, new names and mergers, with the year and the former name."""
    got = text.school_identity(_pick(SCHOOLS, F.col("s_suppkey")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", got["school"].alias("school"), got["merged_from"].alias("merged_from"), got["merged_year"].alias("merged_year"))


SYMBOL_CELLS = ("*", "**", " *** ", "38,5", "-", "****", "38,5*", None)


def symbol_cells(spark, sf_dir):
    got = cells.classified_symbols(_pick(SYMBOL_CELLS, F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", got["status"].alias("status"), got["points"].alias("points"))


def digit_strip(spark, sf_dir):
    """Names into which numbers have run, and names after a school number."""
    raw = F.concat_ws(" ", F.regexp_replace("p_name", "a", "4,5"), F.col("p_size").cast("string"))
    coded = _numbered(F.col("p_partkey"), F.col("p_name"))
    got = text.numbered_school(coded)
    return table(spark, sf_dir, "part").select("p_partkey", text.without_digits(raw).alias("name"), got["number"].alias("number"), got["school"].alias("school"))


def _numbered(key, name):
    """School numbers have five digits; keys that have more stand for none."""
    return F.when((key % 3 == 0) | (F.length(key.cast("string")) > 5), name).otherwise(F.concat(F.lpad(key.cast("string"), 5, "0"), F.lit(" "), name))


def url_decoded(spark, sf_dir):
    """Addresses that were escaped, read back, with the host."""
    coded = F.url_encode("url")
    return table(spark, sf_dir, "pages").select("page_id", F.try_url_decode(coded).alias("url"), F.length(coded).alias("coded_length"))


def last_wins(spark, sf_dir):
    """The last event of each user and type; earlier ones are replaced."""
    w = Window.partitionBy("user_id", "event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_type", "event_id")


def file_names(spark, sf_dir):
    """Year, round and region that made-up file names carry."""
    k = F.col("page_id")
    name = F.concat(F.when(k % 4 != 0, F.concat((k % 3 + 1).cast("string"), F.lit(".inntak-"))).otherwise(F.lit("liste-")),
                    _pick(("fosen", "namdal", "trondelag-sor"), k), F.lit("-"), F.when(k % 5 != 0, (2015 + k % 10).cast("string")).otherwise(F.lit("ny")), F.lit(".pdf"))
    got = rules.file_parts(name)
    return table(spark, sf_dir, "pages").select("page_id", name.alias("file"), *[got[c].alias(c) for c in ("year", "round", "region")])


def press_lines(spark, sf_dir):
    """Lines with this year's number and last year's in brackets, two rows each."""
    k = F.col("p_partkey")
    line = F.concat("p_name", F.lit(" "), (8 + k % 50).cast("string"), F.lit(","), (k % 10).cast("string"),
                    F.when(k % 4 != 0, F.concat(F.lit(" ("), (9 + k % 45).cast("string"), F.lit(".5)"))).otherwise(F.lit("")))
    return rules.two_year_lines(table(spark, sf_dir, "part").select("p_partkey", line.alias("line")), "p_partkey", "line", 2019)


def detail_lookup(spark, sf_dir):
    """Details of customers from a kept table, one page of which is missing: keys without details stay, without them."""
    pages = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.floor(F.col("c_custkey") / 100).alias("page"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(
        pages.where("page % 7 <> 3").select("c_custkey", "c_mktsegment"), "c_custkey", "left"
    )


def register_keyed(spark, sf_dir):
    """The register as one map of names by language for each code."""
    names = F.array(F.struct(F.lit("nob").alias("language"), F.col("n_name").alias("name")), F.struct(F.lit("eng").alias("language"), F.initcap(F.lower("n_name")).alias("name")))
    got = table(spark, sf_dir, "nation").select("n_nationkey", F.map_from_entries(names).alias("titles"))
    return got.select("n_nationkey", F.col("titles")["nob"].alias("nob"), F.col("titles")["eng"].alias("eng"), F.col("titles")["sme"].alias("sme"))


def picture_tiers(spark, sf_dir):
    """Candidates by tier; the last tier is asked only for customers that no other tier knows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("picture"), "o_orderpriority")
    tier = lambda p: o.where(F.col("o_orderpriority").startswith(p)).select("id", "picture")
    return rules.tiers([tier("1"), tier("2")], "id", tier("5"))


def crawl_filter(spark, sf_dir):
    """Links between pages of a host, the first eight of each page that speak of the school itself."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    near = pages.select("page_id", F.col("url").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("pos"))
    host = F.try_parse_url(F.col("page"), F.lit("HOST"))
    link = F.concat(F.lit("https://"), F.when(F.col("pos") % 4 == 3, F.lit("elsewhere.test")).otherwise(host), F.lit("/"),
                    _pick(("om-skolen", "kontakt", "nyheter", "om-skulen", "about"), F.col("pos") + F.col("page_id")), F.lit("?"), F.col("pos").cast("string"))
    return rules.crawl_links(near.where(host.isNotNull()).select("page", link.alias("link"), "pos"), "om-sk|about|kontakt")


def credit_backfill(spark, sf_dir):
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier")
    pictures = s.select("s_suppkey", F.when(k % 3 == 0, F.concat(F.lit("Foto: "), F.col("s_name"))).when(k % 3 == 1, F.lit("unknown")).alias("credit"))
    credits = s.where(k % 2 == 0).select("s_suppkey", F.concat(F.lit("Foto: "), F.col("s_nationkey").cast("string")).alias("credit"))
    return rules.credited(pictures, credits, "s_suppkey")


def bridge_checks(spark, sf_dir):
    """Bridges by county: is the later round lower, is the shift of a plausible size, is the share a share."""
    bridge = baselines.round_bridge(baselines.round_pairs(panel(spark, sf_dir)))
    return bridge.select(
        "county", "category", (F.col("mean") < 0).alias("lower"), F.col("mean").between(-8, -0.5).alias("plausible"),
        F.col("share_vanished").between(0, 1).alias("is_share"),
    )


def calibration_gates(spark, sf_dir):
    """Held-out coverage within 70 to 92 %, the chance's Brier score below the last-year rule's, and the widest gap of a decile of 200 or more."""
    preds = evaluation.predictions(spark, sf_dir)
    late = ~F.col("T").isin(*evaluation.CALIBRATION)
    inside = F.abs(F.col("v") - F.col("m")) <= 1.2816 * F.col("s")
    coverage = evaluation.with_spread(preds).where(late & (F.col("state") == "num")).agg(F.avg(inside.cast("double")).alias("coverage"))
    rows = stored(evaluation._chances(preds).where(late).select(F.round("p", 9).alias("p"), "y", "x", "last"), "chances")
    rule = (F.col("x") >= F.col("last")).cast("double")
    brier = rows.agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"), F.avg(F.pow(rule - F.col("y"), 2)).alias("by_rule"))
    bins = rows.groupBy(F.least(F.floor(F.col("p") * 10), F.lit(9)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg("p") - F.avg("y")).alias("gap"))
    worst = bins.where("n >= 200").agg(F.max("gap").alias("gap"))
    return coverage.crossJoin(brier).crossJoin(worst).select(  # one row each
        F.col("coverage").between(0.70, 0.92).alias("coverage_fits"), (F.col("brier") < F.col("by_rule")).alias("beats_last_year"), F.round("gap", 6).alias("worst_gap")
    )


def effects_centred(spark, sf_dir):
    """School effects (means less the mean of all): centred, spread, each with a standard error above 0."""
    num = observations(panel(spark, sf_dir)).where("state = 'num'")
    means = stored(num.groupBy("county", "school").agg(F.avg("v").alias("mean"), F.count(F.lit(1)).alias("n")), "means")
    overall = means.agg(F.avg("mean").alias("all"))
    e = means.crossJoin(overall).select((F.col("mean") - F.col("all")).alias("alpha"), F.sqrt(1.0 / (F.col("n") / 100.0 + 1.0 / 16.0)).alias("se"))
    return e.agg(
        (F.abs(F.avg("alpha")) < 1).alias("centred"), (F.max("alpha") - F.min("alpha")).between(2, 40).alias("spread"),
        F.count_if(F.col("se") <= 0).alias("without_error"), F.count(F.lit(1)).alias("n"),
    )


V = lambda values: ", ".join("NULL" if v is None else f"'{v}'" for v in values)
HEX = "upper(substr(md5(p_type), 1, 6))"
EXTRA = "CASE code " + " ".join(f"WHEN '{c}' THEN '{t}'" for c, t in rules.EXTRA_CODES.items()) + " END"
QUERIES = {
    "map_explode": (map_explode, f"WITH {PANEL_SQL} SELECT county, school, program, year, points FROM panel WHERE points IS NOT NULL"),
    "map_overlay_years": (map_overlay_years, f"""WITH {PANEL_SQL} SELECT county, school, program, CAST(count(coalesce(v1, v2)) AS INTEGER) AS years,
      coalesce(sum(coalesce(v1, v2)), 0.0) AS total FROM panel GROUP BY ALL"""),
    "catchment": (catchment, "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN n_name END AS catchment FROM nation"),
    "message_kind": (message_kind, """SELECT CASE event_id % 5 WHEN 0 THEN 'feil' WHEN 1 THEN 'bilde' WHEN 4 THEN 'forslag' ELSE 'annet' END AS kind, count(*) AS n
      FROM events GROUP BY 1"""),
    "coordinate_checks": (coordinate_checks, f"""WITH {PLACES} SELECT count(*) AS n, count(*) FILTER (here) AS located,
      count(*) FILTER (here AND lat BETWEEN 57.5 AND 71.5 AND lon BETWEEN 4 AND 31.5) AS inside, avg(CASE WHEN here THEN 1.0 ELSE 0.0 END) >= 0.99 AS enough FROM l"""),
    "forecast_export": (forecast_export, f"""WITH {evaluation.SPREADS}, samples AS ({SAMPLES_SQL}),
      p AS (SELECT county, school, program, T AS year, coalesce(CAST(round(round(m, 6), 1) AS VARCHAR), '') AS m, coalesce(CAST(round(round(s, 6), 1) AS VARCHAR), '') AS s,
        coalesce(CAST(round(round(pi, 6), 3) AS VARCHAR), '') AS pi, coalesce(CAST(round(round(v, 6), 1) AS VARCHAR), '') AS v FROM spread)
      SELECT county, school, program, occurrence, year, m, s, pi, v FROM samples JOIN p USING (county, school, program, year)"""),
    "uncertain_from_meta": (uncertain_from_meta, """SELECT s_nationkey AS county, s_name AS name,
      CASE WHEN s_suppkey % 5 = 0 AND s_suppkey % 2 <> 0 THEN (1995 + s_suppkey % 3) || ',2000' END AS uncertain_years FROM supplier"""),
    "alternate_rounds": (alternate_rounds, f"WITH {PANEL_SQL} SELECT county, school, program, year, v1, v2 AS alternate FROM panel WHERE v1 IS NOT NULL"),
    "round_selection": (round_selection, f"""WITH {PANEL_SQL} SELECT county, school, program, year, CASE WHEN v1 IS NULL THEN '3' ELSE '1' END AS round,
      coalesce(v1, v2) AS value, CASE WHEN v1 IS NOT NULL AND v2 IS NOT NULL THEN 1 ELSE 0 END AS others FROM panel WHERE coalesce(v1, v2) IS NOT NULL"""),
    "code_names": (code_names, f"""WITH c AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN [{V(sorted(rules.EXTRA_CODES))}][p_partkey % 5 + 1] ELSE {HEX} END AS code FROM part),
      r AS (SELECT {HEX} AS code, min(p_type) AS nob FROM part WHERE p_size % 2 = 0 GROUP BY 1)
      SELECT p_partkey, code, coalesce({EXTRA}, nob) AS title FROM c LEFT JOIN r USING (code)"""),
    "category_offsets": (category_offsets, f"""WITH b AS ({BRIDGE_SQL.strip()}),
      c AS (SELECT r_name AS county FROM region UNION ALL SELECT 'NOWHERE'), k AS (SELECT DISTINCT category FROM b WHERE category IS NOT NULL UNION ALL SELECT 'NONE')
      SELECT c.county, k.category, coalesce(x.mean, y.mean, -3.0) AS "offset" FROM c CROSS JOIN k
      LEFT JOIN b x ON x.county = c.county AND x.category = k.category AND x.n_pairs >= 3 LEFT JOIN b y ON y.county = c.county AND y.category IS NULL"""),
    "school_order": (school_order, "SELECT s_nationkey AS county, s_name AS name FROM supplier ORDER BY 1, 2"),
    "school_identities": (school_identities, """SELECT s_suppkey, ['Oslo Handelsgymnasium', 'Vika videregående skole', 'Hafstad videregående skule', 'Førde vidaregåande skule',
      'Høyanger vidaregåande skule', 'Bryne vgs', ''][s_suppkey % 7 + 1] AS school, CASE WHEN s_suppkey % 7 = 3 THEN 'Hafstad videregående skole' END AS merged_from,
      CASE WHEN s_suppkey % 7 = 3 THEN 2023 END AS merged_year FROM supplier"""),
    "symbol_cells": (symbol_cells, """SELECT p_partkey, ['D', 'open', 'D', 'points', NULL, NULL, 'points', NULL][p_partkey % 8 + 1] AS status,
      CASE WHEN p_partkey % 8 IN (3, 6) THEN CAST(38.5 AS DOUBLE) END AS points FROM part"""),
    "digit_strip": (digit_strip, r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(p_name, 'a', '4,5') || ' ' || p_size, '[0-9,]', '', 'g'), '\s+', ' ', 'g')) AS name,
      CASE WHEN p_partkey % 3 <> 0 AND length(CAST(p_partkey AS VARCHAR)) <= 5 THEN lpad(CAST(p_partkey AS VARCHAR), 5, '0') END AS number, trim(p_name) AS school FROM part"""),
    "url_decoded": (url_decoded, """SELECT page_id, url, CAST(length(replace(url_encode(url), '%20', '+')) AS INTEGER) AS coded_length FROM pages"""),
    "last_wins": (last_wins, "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL"),
    "file_names": (file_names, """WITH f AS (SELECT page_id, (CASE WHEN page_id % 4 <> 0 THEN (page_id % 3 + 1) || '.inntak-' ELSE 'liste-' END)
        || ['fosen', 'namdal', 'trondelag-sor'][page_id % 3 + 1] || '-' || (CASE WHEN page_id % 5 <> 0 THEN CAST(2015 + page_id % 10 AS VARCHAR) ELSE 'ny' END) || '.pdf' AS file FROM pages)
      SELECT page_id, file, CASE WHEN page_id % 5 <> 0 THEN CAST(2015 + page_id % 10 AS INTEGER) END AS year, CASE WHEN page_id % 4 <> 0 THEN CAST(page_id % 3 + 1 AS VARCHAR) END AS round,
        CASE WHEN page_id % 4 <> 0 AND page_id % 5 <> 0 THEN ['fosen', 'namdal', 'trondelag-sor'][page_id % 3 + 1] END AS region FROM f"""),
    "press_lines": (press_lines, """SELECT p_partkey, trim(p_name) AS name, CAST(y AS INTEGER) AS year,
      CASE WHEN y = 2019 THEN CAST((8 + p_partkey % 50) || '.' || (p_partkey % 10) AS DOUBLE) ELSE CAST((9 + p_partkey % 45) || '.5' AS DOUBLE) END AS points
      FROM part, (SELECT unnest([2019, 2018]) AS y) WHERE p_partkey % 4 <> 0"""),
    "detail_lookup": (detail_lookup, """SELECT o_orderkey, o_custkey AS c_custkey, CASE WHEN (o_custkey // 100) % 7 <> 3 THEN c_mktsegment END AS c_mktsegment
      FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""),
    "register_keyed": (register_keyed, """SELECT n_nationkey, n_name AS nob, array_to_string(list_transform(string_split(lower(n_name), ' '), lambda w: upper(w[1]) || w[2:]), ' ') AS eng,
      CAST(NULL AS VARCHAR) AS sme FROM nation"""),
    "picture_tiers": (picture_tiers, """WITH t AS (SELECT o_custkey AS id, o_orderkey AS picture, CASE WHEN o_orderpriority LIKE '1%' THEN 1 WHEN o_orderpriority LIKE '2%' THEN 2
        WHEN o_orderpriority LIKE '5%' THEN 3 END AS tier FROM orders)
      SELECT id, picture, tier FROM t WHERE tier < 3 UNION ALL SELECT id, picture, tier FROM t WHERE tier = 3 AND id NOT IN (SELECT id FROM t WHERE tier < 3)"""),
    "crawl_filter": (crawl_filter, """WITH n AS (SELECT page_id, url AS page, nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS host, unnest(range(12)) AS pos FROM pages),
      l AS (SELECT page, min(pos) AS pos, 'https://' || host || '/' || ['om-skolen', 'kontakt', 'nyheter', 'om-skulen', 'about'][(pos + page_id) % 5 + 1] || '?' || pos AS link
        FROM n WHERE host IS NOT NULL AND pos % 4 <> 3 AND (pos + page_id) % 5 <> 2 GROUP BY ALL),
      r AS (SELECT page, link, CAST(row_number() OVER (PARTITION BY page ORDER BY pos, link) AS INTEGER) AS place FROM (SELECT page, link, min(pos) AS pos FROM l GROUP BY ALL))
      SELECT page, link, place FROM r WHERE place <= 8"""),
    "credit_backfill": (credit_backfill, """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'Foto: ' || s_name WHEN s_suppkey % 2 = 0 THEN 'Foto: ' || s_nationkey
      WHEN s_suppkey % 3 = 1 THEN 'unknown' END AS credit FROM supplier"""),
    "bridge_checks": (bridge_checks, f"""WITH b AS ({BRIDGE_SQL.strip()}) SELECT county, category, mean < 0 AS lower, mean BETWEEN -8 AND -0.5 AS plausible,
      share_vanished BETWEEN 0 AND 1 AS is_share FROM b"""),
    "calibration_gates": (calibration_gates, f"""WITH {evaluation.CHANCES}, h AS (SELECT round(p, 9) AS p, y, x, last FROM chances WHERE T NOT IN {evaluation.CALIBRATION}),
      c AS (SELECT avg(CASE WHEN abs(v - m) <= 1.2816 * s THEN 1.0 ELSE 0.0 END) AS coverage FROM spread WHERE state = 'num' AND T NOT IN {evaluation.CALIBRATION}),
      b AS (SELECT avg(pow(p - y, 2)) AS brier, avg(pow(CASE WHEN x >= last THEN 1.0 WHEN x < last THEN 0.0 END - y, 2)) AS by_rule FROM h),
      g AS (SELECT abs(avg(p) - avg(y)) AS gap FROM h GROUP BY least(trunc(p * 10), 9) HAVING count(*) >= 200)
      SELECT coverage BETWEEN 0.70 AND 0.92 AS coverage_fits, brier < by_rule AS beats_last_year, (SELECT round(max(gap), 6) FROM g) AS worst_gap FROM c, b"""),
    "effects_centred": (effects_centred, f"""WITH {OBS_SQL}, m AS (SELECT avg(v) AS mean, count(*) AS n FROM obs WHERE state = 'num' GROUP BY county, school),
      e AS (SELECT mean - (SELECT avg(mean) FROM m) AS alpha, sqrt(1.0 / (n / 100.0 + 1.0 / 16.0)) AS se FROM m)
      SELECT abs(avg(alpha)) < 1 AS centred, max(alpha) - min(alpha) BETWEEN 2 AND 40 AS spread, count(*) FILTER (se <= 0) AS without_error, count(*) AS n FROM e"""),
}
