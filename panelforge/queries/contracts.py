"""Rows that break a rule, sources by county, places of schools, and addresses of pictures."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelforge.functions.text import displayed, thumbnail, with_query
from panelforge.operators import match, merge, problems
from panelforge.plans.panel import PANEL_SQL, SERIES, panel, schools, table
from panelforge.queries import evaluation
from panelforge.sources.registry import Registry

MOST = 45.0  # the greatest plausible quantity of an order line, so that some are not


def problem_rows(spark, sf_dir):
    """Order lines as cells of named programmes: every name and number that breaks a rule."""
    size = F.when(F.col("p_size") > 40, F.col("p_size").cast("string"))
    part = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_type", "p_name", size).alias("program"),
        F.when(F.col("p_type") == "ECONOMY", "other").otherwise(F.lower("p_type")).alias("category"),
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey", F.year("l_shipdate").alias("year")).agg(F.max("l_quantity").alias("points"))
    cells = lines.join(part, "l_partkey").join(schools(spark, sf_dir), "l_suppkey")
    return problems.cell_problems(cells, words="promo|small", most=MOST)


def forecast_rules(spark, sf_dir):
    """Forecasts that break a bound, counted by rule; the fill probability and the threshold are widened so that some do."""
    preds = evaluation.with_spread(evaluation.predictions(spark, sf_dir))
    wide = preds.withColumns({"pi": F.expr("pi * 1.2"), "m": F.expr("m * 4"), "s": F.expr("s - 3 * hist")})
    return problems.forecast_problems(wide, [*SERIES, "T"]).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def spread_rules(spark, sf_dir):
    found = problems.spread_problems(evaluation.spreads(evaluation.predictions(spark, sf_dir)), 2.0)
    return found.select("bucket", F.round("s", 6).alias("s"), "above_residual", "shrinks")


def round_years(spark, sf_dir):
    """Years in which all of a school's cells of one level and category come from one round that is not the usual one."""
    cells = panel(spark, sf_dir).withColumn("county", F.concat_ws("|", "school", "level", "category"))
    return problems.round_years(cells, "1")


def reviewed_pictures(spark, sf_dir):
    """A customer's reviewed order: the newest of the dear ones, else the first of all as it was before."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), "o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    old = orders.groupBy("name").agg(F.min_by(F.struct(F.col("o_orderkey").alias("photo"), F.col("o_orderpriority").alias("credit")), F.struct("o_orderdate", "o_orderkey")).alias("p"))
    new = orders.where("o_totalprice > 300000").groupBy("name").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("photo"))
    return merge.superseded(old.select("name", "p.*"), new, ["name"])


def located_schools(spark, sf_dir):
    """Customers as schools: by hand, by a register of two segments, by an address, by the name of a place."""
    c = table(spark, sf_dir, "customer").selectExpr("cast(c_nationkey as string) as county", "c_name as school", "c_custkey as k", "c_acctbal as b", "c_mktsegment as g")
    register = c.where("g in ('FURNITURE', 'AUTOMOBILE')").selectExpr(
        "county", "upper(school) as navn", "k as pos", "if(b > 4000, b / 200, null) as lat", "if(b > 4000, 10.0D, null) as lon", "concat('Street ', k % 40) as adresse"
    )
    s = table(spark, sf_dir, "supplier").selectExpr("cast(s_nationkey as string) as county", "s_suppkey as k", "s_acctbal as b")
    addresses = s.select("county", F.explode(F.sequence(F.col("k") % 3, F.lit(39), F.lit(3))).alias("n"), "b").selectExpr("county", "concat('Street ', n) as adresse", "b / 200 as lat", "11.0D as lon")
    places = c.where("g in ('BUILDING', 'AUTOMOBILE')").selectExpr(
        "county", "case when g = 'AUTOMOBILE' then upper(school) when k % 3 = 0 then school else concat(school, ' school') end as name", "b / 200 as lat", "12.0D as lon"
    )
    manual = c.where("k % 17 = 0").selectExpr("county", "school", "60.0D as lat", "9.0D as lon")
    found = match.located(c, register, manual, addresses, places, ["school"])
    return found.withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


SOURCES = Registry()


@SOURCES.source("Lines", round="1", note="order lines")
def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("school"), F.col("l_returnflag").alias("program"), F.year("l_shipdate").alias("year"),
        F.col("l_quantity").alias("points"), F.when(F.col("l_linestatus") == "F", "1").otherwise("2").alias("round"),
    )


@SOURCES.source("Orders", note="orders, without rounds")
def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("c"), "o_custkey").alias("school"), F.col("o_orderstatus").alias("program"), F.year("o_orderdate").alias("year"),
        F.round(F.col("o_totalprice") / 10000, 1).alias("points"),
    )


@SOURCES.source("Visits", note="events, open to all")
def _visits(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("u"), "user_id").alias("school"), F.col("event_type").alias("program"), F.year("ts").alias("year"), F.lit("open").alias("status")
    )


def county_sources(spark, sf_dir):
    """Three sources of unlike columns under one contract, with what their counties say of themselves."""
    rows = SOURCES.rows(spark, sf_dir).groupBy("county", "program", "year").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("points"), 2).alias("points"), F.count("round").alias("with_round"), F.count("status").alias("with_status")
    )
    return rows.join(F.broadcast(SOURCES.counties(spark)), "county").withColumn("note", F.element_at("about", "note")).drop("about")  # one row a source


PICTURE = """concat(case page_id % 6
  when 0 then concat('https://upload.wikimedia.org/wikipedia/commons/a/ab/Page_', page_id, case when page_id % 5 = 0 then '.svg' else '.jpg' end, '?utm=', page_id)
  when 1 then concat('https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/P.jpg/', page_id * 37 % 4000 + 1, 'px-P.jpg')
  when 2 then concat('https://v.imgi.no/x', page_id, '__w=2400_h=600')
  when 3 then concat('https://e.org/bv.ashx/w600/', page_id, '.jpg')
  when 4 then concat('https://e.org/', page_id, '.PNG?a=1&width=', page_id, '&b=')
  else url end, '')"""


def displayed_pictures(spark, sf_dir):
    """Addresses of pictures on five kinds of hosts and of pages themselves, as shown, as a thumbnail, and marked."""
    urls = table(spark, sf_dir, "pages").select("page_id", F.expr(PICTURE).alias("picture"))
    return urls.select(
        "page_id", displayed(F.col("picture")).alias("shown"), thumbnail(F.col("picture")).alias("thumb"),
        with_query(F.col("picture"), {"ref": F.col("page_id").cast("string")}).alias("marked"),
    )


QUERIES = {
    "problem_rows": (problem_rows, f"""WITH cells AS (
      SELECT r_name AS county, s_name AS school, p_type || ' ' || p_name || CASE WHEN p_size > 40 THEN ' ' || p_size ELSE '' END AS program, p_type,
        CAST(year(l_shipdate) AS INTEGER) AS year, max(l_quantity) AS points
      FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY county, school, program, p_type, year, p_partkey, s_suppkey)
      SELECT DISTINCT county, school, program, NULL::INTEGER AS year, 'number glued to name' AS rule FROM cells WHERE regexp_matches(program, ' [0-9]+$')
      UNION SELECT county, school, program, NULL, 'status glued to name' FROM cells WHERE lower(program) LIKE '%promo%' OR lower(program) LIKE '%small%'
      UNION SELECT county, school, program, NULL, 'uncategorised' FROM cells WHERE p_type = 'ECONOMY'
      UNION SELECT county, school, program, year, 'out of range' FROM cells WHERE points < 0 OR points > {MOST}"""),
    "forecast_rules": (forecast_rules, f"""WITH {evaluation.SPREADS}, w AS (SELECT pi * 1.2 AS pi, m * 4 AS m, s - 3 * hist AS s FROM spread),
      r AS (SELECT 'fill is no probability' AS rule FROM w WHERE pi < 0 OR pi > 1 UNION ALL SELECT 'spread not positive' FROM w WHERE s <= 0
        UNION ALL SELECT 'threshold not plausible' FROM w WHERE m < -10 OR m > 70)
      SELECT rule, count(*) AS n FROM r GROUP BY rule"""),
    "spread_rules": (spread_rules, f"""WITH {evaluation.SPREADS} SELECT bucket, round(s, 6) AS s, s >= 2.0 AS above_residual,
      coalesce(s <= (SELECT b.s FROM spreads b WHERE b.bucket = a.bucket - 1), true) AS shrinks FROM spreads a"""),
    "round_years": (round_years, f"""WITH {PANEL_SQL} SELECT school || '|' || level || '|' || category AS county, year, any_value(round) AS round FROM panel WHERE round IS NOT NULL
      GROUP BY 1, 2 HAVING count(DISTINCT round) = 1 AND any_value(round) <> '1'"""),
    "reviewed_pictures": (reviewed_pictures, """WITH n AS (SELECT o_custkey AS name, o_orderkey AS photo FROM orders WHERE o_totalprice > 300000
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
      o AS (SELECT o_custkey AS name, o_orderkey AS photo, o_orderpriority AS credit FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1)
      SELECT name, CASE WHEN n.photo IS NULL THEN o.photo ELSE n.photo END AS photo, CASE WHEN n.photo IS NULL THEN credit END AS credit
      FROM o LEFT JOIN n USING (name)"""),
    "located_schools": (located_schools, """WITH c AS (SELECT CAST(c_nationkey AS VARCHAR) AS county, c_name AS school, c_custkey AS k, c_acctbal AS b, c_mktsegment AS g FROM customer),
      a AS (SELECT c_.k, min(s_acctbal) / 200 AS lat FROM c c_ JOIN supplier ON s_nationkey = CAST(county AS INTEGER) AND s_suppkey % 3 = k % 40 % 3 GROUP BY 1),
      t AS (SELECT c.*, a.lat, CASE WHEN k % 17 = 0 THEN 'manual' WHEN g IN ('FURNITURE', 'AUTOMOBILE') AND b > 4000 THEN 'register'
          WHEN g IN ('FURNITURE', 'AUTOMOBILE') AND a.lat IS NOT NULL THEN 'address' WHEN g IN ('BUILDING', 'AUTOMOBILE') THEN 'place' ELSE 'unmatched' END AS tier
        FROM c LEFT JOIN a USING (k))
      SELECT county, school, tier, round(CASE tier WHEN 'manual' THEN 60 WHEN 'register' THEN b / 200 WHEN 'address' THEN lat WHEN 'place' THEN b / 200 END, 6) AS lat,
        round(CASE tier WHEN 'manual' THEN 9.0::DOUBLE WHEN 'register' THEN 10.0::DOUBLE WHEN 'address' THEN 11.0::DOUBLE WHEN 'place' THEN 12.0::DOUBLE END, 6) AS lon FROM t"""),
    "county_sources": (county_sources, """SELECT 'Lines' AS county, l_returnflag AS program, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n,
        round(sum(l_quantity), 2) AS points, count(l_linestatus) AS with_round, 0::BIGINT AS with_status, 'order lines' AS note FROM lineitem GROUP BY 2, 3
      UNION ALL SELECT 'Orders', o_orderstatus, CAST(year(o_orderdate) AS INTEGER), count(*), round(sum(round(o_totalprice / 10000, 1)), 2), 0, 0, 'orders, without rounds' FROM orders GROUP BY 2, 3
      UNION ALL SELECT 'Visits', event_type, CAST(year(ts) AS INTEGER), count(*), NULL, 0, count(*), 'events, open to all' FROM events GROUP BY 2, 3"""),
    "displayed_pictures": (displayed_pictures, """SELECT page_id,
        CASE page_id % 6 WHEN 0 THEN 'https://upload.wikimedia.org/wikipedia/commons/a/ab/Page_' || page_id || ext || '?utm=' || page_id
          WHEN 1 THEN 'https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/P.jpg/960px-P.jpg' WHEN 2 THEN 'https://v.imgi.no/x' || page_id || '__w=960_h=600'
          WHEN 3 THEN ash WHEN 4 THEN 'https://e.org/' || page_id || '.PNG?a=1&width=960&quality=75&format=jpg' ELSE url END AS shown,
        CASE page_id % 6 WHEN 0 THEN 'https://upload.wikimedia.org/wikipedia/commons/' || CASE WHEN ext = '.svg' THEN 'a/ab/Page_' || page_id || ext
            ELSE 'thumb/a/ab/Page_' || page_id || ext || '/960px-Page_' || page_id || ext END
          WHEN 1 THEN 'https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/P.jpg/' || least(page_id * 37 % 4000 + 1, 960) || 'px-P.jpg'
          WHEN 2 THEN 'https://v.imgi.no/x' || page_id || '__w=2400_h=600' WHEN 3 THEN ash WHEN 4 THEN 'https://e.org/' || page_id || '.PNG' ELSE split_part(url, '?', 1) END AS thumb,
        CASE page_id % 6 WHEN 0 THEN 'https://upload.wikimedia.org/wikipedia/commons/a/ab/Page_' || page_id || ext || '?utm=' || page_id || '&ref=' || page_id
          WHEN 1 THEN 'https://upload.wikimedia.org/wikipedia/commons/thumb/a/ab/P.jpg/' || (page_id * 37 % 4000 + 1) || 'px-P.jpg?ref=' || page_id
          WHEN 2 THEN 'https://v.imgi.no/x' || page_id || '__w=2400_h=600?ref=' || page_id WHEN 3 THEN ash || '?ref=' || page_id
          WHEN 4 THEN 'https://e.org/' || page_id || '.PNG?a=1&width=' || page_id || '&ref=' || page_id
          ELSE CASE WHEN regexp_matches(url, '[?&]ref=[^&#]') THEN regexp_replace(split_part(url, '#', 1), '([?&]ref=)[^&#]+', '\\1' || page_id)
            WHEN contains(split_part(url, '#', 1), '?') THEN split_part(url, '#', 1) || '&ref=' || page_id ELSE split_part(url, '#', 1) || '?ref=' || page_id END
            || regexp_extract(url, '#.*$') END AS marked
      FROM (SELECT *, CASE WHEN page_id % 5 = 0 THEN '.svg' ELSE '.jpg' END AS ext, 'https://e.org/bv.ashx/w600/' || page_id || '.jpg' AS ash FROM pages)"""),
}
