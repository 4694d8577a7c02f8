"""Text functions and matching, on documents, parts, pages, suppliers and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import cells, stats, text
from panelforge.operators import match, taxonomy
from panelforge.plans.panel import schools, table
from panelforge.schemas import REGISTER
from panelforge.sources.files import matched_lines
from panelforge.sources.html import html_cells

CELL_TEXTS = ("38,8", "38.8*", "66,0", "4,0", "-", "Ingen venteliste", "Fortrinnsrett", "Dokumentasjon", "Lagt ned", "35,0 (+ x) y", "123,4")


def cell_classify(spark, sf_dir):
    """Cell texts made of part sizes and known statuses, and what they mean."""
    raw = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(","), (F.col("p_partkey") % 10).cast("string"))).otherwise(
        F.get(F.array(*map(F.lit, CELL_TEXTS)), (F.col("p_partkey") % len(CELL_TEXTS)).cast("int"))
    )
    rows = table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"))
    c, loose = cells.classified(F.col("raw")), cells.classified(F.col("raw"), 0.0, loose=True)
    return rows.select("p_partkey", "raw", c["status"].alias("status"), c["points"].alias("points"), loose["points"].alias("loose_points"))


def squash_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.squash(text.norm(F.col("text")))).alias("digest"))


def canon_name(spark, sf_dir):
    """Part names written like programmes, in one spelling."""
    raw = F.concat(F.regexp_replace("p_name", " ", ","), F.when(F.col("p_partkey") % 2 == 0, F.lit(" vg1")).otherwise(F.lit(" .")))
    return table(spark, sf_dir, "part").select("p_partkey", cells.program_name(raw).alias("name"))


def mini_register(spark, sf_dir) -> DataFrame:
    """A register of codes made of the part types: their first words, lower case, and the whole types."""
    types = table(spark, sf_dir, "part").select(F.col("p_type").alias("nob")).distinct()
    code = F.concat(F.upper(F.substring(F.md5("nob"), 1, 6)), F.lit("----"))
    return types.select(code.alias("code"), "nob", F.lit(None).cast("string").alias("nno"), F.lit(None).cast("string").alias("eng"))


def taxonomy_exact_prefix(spark, sf_dir):
    """Types with something appended after a comma, found by their longest known prefix."""
    names = table(spark, sf_dir, "part").select(
        F.concat(F.col("p_type"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(", x"), F.col("p_size").cast("string"))).otherwise(F.lit(""))).alias("program")
    )
    got = taxonomy.resolve(names, mini_register(spark, sf_dir))
    return got.select("program", "code", "how")


def taxonomy_levenshtein(spark, sf_dir):
    """Misspelled types and the closest entry by edit distance."""
    entries = mini_register(spark, sf_dir).select("code", F.lower("nob").alias("name"))
    wrong = table(spark, sf_dir, "part").select(F.lower(F.regexp_replace("p_type", "[AE]", "x")).alias("typed")).distinct()
    d = F.levenshtein("typed", "name")
    return wrong.crossJoin(F.broadcast(entries)).groupBy("typed").agg(F.min(F.struct(d.alias("d"), "name", "code")).alias("b")).select(
        "typed", F.col("b.name").alias("name"), F.col("b.d").cast("bigint").alias("distance")
    )


def taxonomy_difflib(spark, sf_dir):
    """The whole cascade on misspelled types: exact, prefix, fuzzy, contained."""
    names = table(spark, sf_dir, "part").select(F.regexp_replace("p_type", "A", "o").alias("program")).distinct()
    return taxonomy.resolve(names, mini_register(spark, sf_dir))


def taxonomy_categories(spark, sf_dir):
    """The mini register of the tests, with a name for each way of resolution."""
    register = spark.createDataFrame(
        [("STUSP1----", "Studiespesialisering", None, "Specialization in general studies"), ("TPTIP1----", "Teknologi- og industrifag", None, None),
         ("SSTRL2----", "Transport og logistikk", None, None), ("TPTOL2----", "Transport og logistikk", None, None),
         ("NAGAR2----", "Landbruk og gartnernæring", None, None)], REGISTER,
    )
    names = ["Studiespesialisering", "Studiespesialisering, toppidrett", "Teknolog og idustrifag", "Transport og logistikk", "Elektrofag", "Xyz",
             "Landbruk og gartnernæring, hest", "Påbygg. gen. studiekomp"]
    got = taxonomy.resolve(spark.createDataFrame([(n,) for n in names], "program string"), register)
    got = taxonomy.english_names(got, register)
    return got.withColumn("filter_key", taxonomy.category_or_other(F.col("category")))


def entity_match_cascade(spark, sf_dir):
    """Suppliers matched to a register in which most names are changed, some are branches and one is entered by hand."""
    s = schools(spark, sf_dir)
    n = F.col("l_suppkey")
    name = F.when(n % 4 == 0, F.col("school")).when(n % 4 == 1, F.concat(F.col("school"), F.lit(" Extra Campus"))).when(
        n % 4 == 2, F.concat(F.col("school"), F.lit(" avd North"))
    ).otherwise(F.lit("Other"))
    register = s.select(F.concat(F.lit("o"), n.cast("string")).alias("orgnr"), F.col("county").alias("fylke"), name.alias("navn"), n.alias("pos"))
    manual = s.where("l_suppkey % 10 = 3").select("school", "county", F.lit("hand").alias("orgnr"))
    return match.cascade(s.select("school", "county"), register, manual)


def _points(spark, sf_dir) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("id"), (58.0 + (k * 37 % 1000) / 100.0).alias("lat"), (5.0 + (k * 53 % 1000) / 100.0).alias("lon")
    )


def geo_pairs(spark, sf_dir):
    """Suppliers at most 150 km apart, at coordinates made from their keys."""
    p = _points(spark, sf_dir)
    return match.within_km(p, p, 150.0, digits=6).where("id_a < id_b")


def map_pixels(spark, sf_dir):
    xy = stats.mercator(F.col("lat"), F.col("lon"), 6)
    return _points(spark, sf_dir).select("id", F.round(xy["x"], 6).alias("x"), F.round(xy["y"], 6).alias("y"))


def token_semi_join(spark, sf_dir):
    """Parts whose name holds any, all and at least two of the long words of their type."""
    tokens = F.filter(F.split(F.lower("p_type"), " "), lambda w: F.length(w) > 3)
    holds = lambda w: F.contains(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")), F.substring(w, 2, 5))
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.exists(tokens, holds).alias("any_token"), F.forall(tokens, holds).alias("all_tokens"),
        (F.size(F.filter(tokens, holds)) >= 2).alias("two_tokens"),
    )


def url_rewrite(spark, sf_dir):
    url = F.concat(F.col("url"), F.when(F.col("page_id") % 2 == 0, F.lit("?width=600")).otherwise(F.lit("/w600/h400/a.jpg")))
    return table(spark, sf_dir, "pages").select(
        "page_id", text.larger(url).alias("large"), text.site_url(F.regexp_replace("url", "^https?://", "")).alias("site"),
        F.regexp_extract("url", "/([0-9]+)", 1).alias("number"),
    )


def html_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(text.without_tags(F.col("html"))).alias("digest"))


def html_tables(spark, sf_dir):
    """The cells of all tables; list items of the pages are put in a table of their own, as few pages have one."""
    page = F.concat(
        F.lit("<h2>List</h2><table><tr><th>item</th></tr>"),
        F.regexp_replace(F.regexp_extract("html", "<ul>(.*?)</ul>", 1), "<li>(.*?)</li>", "<tr><td>$1</td></tr>"),
        F.lit("</table>"), F.col("html"),
    )
    return html_cells(table(spark, sf_dir, "pages").select("page_id", page.alias("html")), "page_id")


def boilerplate_hash(spark, sf_dir):
    """Documents of at least three sources that have the same text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.md5("text").alias("hash"))
    shared = d.groupBy("hash").agg(F.count_distinct("source").alias("n")).where("n >= 3")
    return d.join(shared, "hash").select("doc_id", "hash", "n")


def document_lines(spark, sf_dir):
    """Lines of documents that name a license."""
    return matched_lines(table(spark, sf_dir, "documents"), "doc_id", "text", "(Licensed|licensed) under (the )?([A-Z][A-Za-z]*)", ["verb", "art", "name"])


def keyword_score(spark, sf_dir):
    """Pictures named after parts, scored by words of their names."""
    url = F.concat(F.lit("https://x.org/img/"), F.regexp_replace(F.lower("p_type"), " ", "-"), F.when(F.col("p_partkey") % 5 == 0, F.lit("-logo")).otherwise(F.lit("")), F.lit("-campus.jpg"))
    score = text.picture_score(url, F.col("p_name"), F.array(F.lit("steel"), F.lit("brass")))
    return table(spark, sf_dir, "part").select("p_partkey", score.cast("bigint").alias("score"))


def topk_candidates(spark, sf_dir):
    """The best document of each source and up to three more, by length."""
    from pyspark.sql import Window

    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    return table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.row_number().over(w).alias("k")).where("k <= 4")


def address_parse(spark, sf_dir):
    raw = F.concat_ws(", ", F.concat(F.lit("Main st "), F.col("c_custkey").cast("string"), F.lit("-"), F.col("c_nationkey").cast("string")),
                      F.lpad(F.col("c_nationkey").cast("string"), 4, "0"), F.col("c_mktsegment"))
    a = text.address(raw)
    return table(spark, sf_dir, "customer").select("c_custkey", a["street"].alias("street"), a["number"].alias("number"), a["postcode"].alias("postcode"), a["place"].alias("place"))


def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.title(F.concat(F.lower("p_type"), F.lit(" of the ICT and a "), F.col("p_name"))).alias("title"))


def message_clean(spark, sf_dir):
    """Digests of the whole cleaned texts."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.one_line(F.col("text"))).alias("line"), F.md5(text.paragraphs(F.col("text"))).alias("message"))


def json_props(spark, sf_dir):
    """Numbers in a JSON text, with a default, and what is not JSON."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("int")
    return e.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(k, F.lit(0)).cast("bigint")).alias("sum_k"), F.count_if(F.try_parse_json("props").isNull()).alias("broken")
    )


GOODS, BADS = (", ".join(f"'{w}'" for w in words) for words in (text.GOOD, text.BAD))
TAXO = """types AS (SELECT DISTINCT p_type AS t FROM part),
  idx AS (SELECT lower(t) AS name, min(upper(substr(md5(t), 1, 6)) || '----') AS code FROM types GROUP BY 1)"""
QUERIES = {
    "cell_classify": (cell_classify, f"""WITH r AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || ',' || (p_partkey % 10)
        ELSE [{", ".join(f"'{c}'" for c in CELL_TEXTS)}][p_partkey % {len(CELL_TEXTS)} + 1] END AS raw FROM part),
      n AS (SELECT *, trim(rtrim(lower(raw), '*')) AS t FROM r),
      v AS (SELECT *, CASE WHEN regexp_full_match(t, '[0-9]{{1,2}}([.,][0-9]{{1,2}})?') THEN CAST(replace(t, ',', '.') AS DOUBLE) END AS v,
        CAST(replace(nullif(regexp_extract(t, '^([0-9]{{1,2}}([.,][0-9]{{1,2}})?)\\b', 1), ''), ',', '.') AS DOUBLE) AS l FROM n)
      SELECT p_partkey, raw, CASE WHEN t = '-' THEN NULL WHEN t LIKE 'fortrinn%' THEN 'F' WHEN t LIKE 'lagt ned%' THEN 'U'
        WHEN t LIKE 'dokumentasjon%' THEN 'D' WHEN t LIKE 'ingen vente%' THEN 'open' WHEN v BETWEEN 8 AND 65 THEN 'points' END AS status,
        CASE WHEN v BETWEEN 8 AND 65 THEN v END AS points, CASE WHEN l BETWEEN 0 AND 65 THEN l END AS loose_points FROM v"""),
    "squash_text": (squash_text, """SELECT doc_id, md5(trim(regexp_replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(8208), '-'),
      '[\\s\\x0B\\x85\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1680}]+', ' ', 'g'))) AS digest FROM documents"""),
    "canon_name": (canon_name, """SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(replace(p_name, ' ', ',') ||
      CASE WHEN p_partkey % 2 = 0 THEN ' vg1' ELSE ' .' END, ',(\\S)', ', \\1', 'g'), '\\s*\\.\\s*$', ''), '\\s+vg\\s?[1-4]$', '')) AS name FROM part"""),
    "taxonomy_exact_prefix": (taxonomy_exact_prefix, f"""WITH {TAXO}, n AS (
      SELECT DISTINCT p_type AS t, p_type || CASE WHEN p_size % 2 = 0 THEN ', x' || p_size ELSE '' END AS program FROM part)
      SELECT program, code, CASE WHEN program = t THEN 'exact' ELSE 'prefix' END AS how FROM n JOIN idx ON lower(t) = name"""),
    "taxonomy_levenshtein": (taxonomy_levenshtein, f"""WITH {TAXO}, w AS (SELECT DISTINCT lower(regexp_replace(p_type, '[AE]', 'x', 'g')) AS typed FROM part),
      d AS (SELECT typed, name, levenshtein(typed, name) AS d, row_number() OVER (PARTITION BY typed ORDER BY levenshtein(typed, name), name) AS k FROM w, idx)
      SELECT typed, name, CAST(d AS BIGINT) AS distance FROM d WHERE k = 1"""),
    "taxonomy_difflib": (taxonomy_difflib, None),
    "taxonomy_categories": (taxonomy_categories, None),
    "entity_match_cascade": (entity_match_cascade, """WITH s AS (
        SELECT s_suppkey AS n, s_name AS school, r_name AS county FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
      r AS (SELECT 'o' || n AS orgnr, county, n AS pos, lower(CASE n % 4 WHEN 0 THEN school WHEN 1 THEN school || ' Extra Campus'
        WHEN 2 THEN school || ' avd North' ELSE 'Other' END) AS navn FROM s),
      k AS (SELECT *, trim(regexp_replace(regexp_replace(navn, '\\bavd\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS key FROM r),
      t AS (SELECT s.school, s.county, k.orgnr, k.pos, CASE WHEN key = lower(school) THEN 1
          WHEN NOT contains(navn, 'avd') AND (contains(lower(school), key) OR contains(key, lower(school))) THEN 2
          WHEN contains(key, lower(school)) THEN 3 END AS tier FROM s JOIN k USING (county)),
      b AS (SELECT school, county, arg_min(orgnr, (tier, pos)) AS orgnr, min(tier) AS tier FROM t WHERE tier IS NOT NULL GROUP BY ALL)
      SELECT s.school, s.county, CAST(CASE WHEN n % 10 = 3 THEN 0 ELSE coalesce(tier, 9) END AS INTEGER) AS tier,
        CASE WHEN n % 10 = 3 THEN 'hand' ELSE orgnr END AS orgnr FROM s LEFT JOIN b USING (school, county)"""),
    "geo_pairs": (geo_pairs, """WITH p AS (SELECT s_suppkey AS id, 58.0 + (s_suppkey * 37 % 1000) / 100.0 AS lat, 5.0 + (s_suppkey * 53 % 1000) / 100.0 AS lon FROM supplier),
      d AS (SELECT a.id AS id_a, b.id AS id_b, 2 * 6371.0 * asin(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2)
        + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))) AS km FROM p a JOIN p b ON a.id < b.id)
      SELECT id_a, id_b, round(km, 6) AS km FROM d WHERE km <= 150"""),
    "map_pixels": (map_pixels, """WITH p AS (SELECT s_suppkey AS id, 58.0 + (s_suppkey * 37 % 1000) / 100.0 AS lat, 5.0 + (s_suppkey * 53 % 1000) / 100.0 AS lon FROM supplier)
      SELECT id, round((lon + 180.0) / 360.0 * 32768, 6) AS x, round((1.0 - ln(tan(radians(lat)) + 1.0 / cos(radians(lat))) / pi()) / 2.0 * 32768, 6) AS y FROM p"""),
    "token_semi_join": (token_semi_join, """WITH t AS (SELECT p_partkey, list_transform(list_filter(string_split(lower(p_type), ' '), lambda w: length(w) > 3),
        lambda w: contains(lower(p_name || ' ' || p_brand || ' ' || p_type), substr(w, 2, 5))) AS h FROM part)
      SELECT p_partkey, len(list_filter(h, lambda x: x)) > 0 AS any_token, len(list_filter(h, lambda x: NOT x)) = 0 AS all_tokens,
        len(list_filter(h, lambda x: x)) >= 2 AS two_tokens FROM t"""),
    "url_rewrite": (url_rewrite, """SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url || '?width=600', '([?&]width=)[0-9]+', '\\11600', 'g')
        ELSE url || '/w1200/h675/a.jpg' END AS large, 'https://' || regexp_replace(url, '^https?://', '') AS site,
        regexp_extract(url, '/([0-9]+)', 1) AS number FROM pages"""),
    "html_strip": (html_strip, """SELECT page_id, md5(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[\\s\\x0B]+', ' ', 'g'))) AS digest FROM pages"""),
    "html_tables": (html_tables, None),
    "boilerplate_hash": (boilerplate_hash, """WITH d AS (SELECT doc_id, source, md5(text) AS hash FROM documents)
      SELECT doc_id, hash, n FROM d JOIN (SELECT hash, count(DISTINCT source) AS n FROM d GROUP BY hash HAVING count(DISTINCT source) >= 3) USING (hash)"""),
    "document_lines": (document_lines, """WITH l AS (SELECT doc_id, generate_subscripts(p, 1) - 1 AS line_no, unnest(p) AS line
        FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))
      SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, regexp_extract(line, '(Licensed|licensed) under (the )?([A-Z][A-Za-z]*)', 1) AS verb,
        regexp_extract(line, '(Licensed|licensed) under (the )?([A-Z][A-Za-z]*)', 2) AS art,
        regexp_extract(line, '(Licensed|licensed) under (the )?([A-Z][A-Za-z]*)', 3) AS name
      FROM l WHERE regexp_matches(line, '(Licensed|licensed) under (the )?([A-Z][A-Za-z]*)')"""),
    "keyword_score": (keyword_score, f"""WITH u AS (SELECT p_partkey, replace(lower(p_type), ' ', '-') || CASE WHEN p_partkey % 5 = 0 THEN '-logo' ELSE '' END
        || '-campus.jpg ' || lower(p_name) AS tail FROM part)
      SELECT p_partkey, CASE WHEN len(list_filter([{BADS}], lambda w: contains(tail, w))) > 0 THEN -10
        ELSE 3 * len(list_filter([{GOODS}], lambda w: contains(tail, w))) + 4 * len(list_filter(['steel', 'brass'], lambda w: contains(tail, w))) END AS score FROM u"""),
    "topk_candidates": (topk_candidates, """SELECT source, doc_id, n_chars, CAST(k AS INTEGER) AS k FROM (
      SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS k FROM documents) WHERE k <= 4"""),
    "address_parse": (address_parse, """SELECT c_custkey, 'Main st' AS street, CAST(c_custkey AS VARCHAR) AS number, lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS postcode,
      c_mktsegment AS place FROM customer"""),
    "title_case": (title_case, """WITH w AS (SELECT p_partkey, list_filter(string_split(lower(p_type) || ' of the ICT and a ' || p_name, ' '), lambda x: x <> '') AS ws FROM part)
      SELECT p_partkey, array_to_string(list_transform(ws, lambda x, i: CASE WHEN i > 1 AND lower(x) IN ('and','or','of','the','for','in','to','a','an','with','on','at')
        THEN lower(x[1]) ELSE upper(x[1]) END || x[2:]), ' ') AS title FROM w"""),
    "message_clean": (message_clean, """SELECT doc_id, md5(trim(regexp_replace(text,
        '[\\s\\x0B\\x85\\x{a0}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}\\x{1680}]+', ' ', 'g'))) AS line,
      md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\r\\f\\x0B]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'),
        '^\\s+|\\s+$', '', 'g')) AS message FROM documents"""),
    "json_props": (json_props, """SELECT event_type, count(*) AS n, CAST(sum(coalesce(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), 0)) AS BIGINT) AS sum_k,
      count(*) FILTER (NOT json_valid(props)) AS broken FROM events GROUP BY ALL"""),
}
