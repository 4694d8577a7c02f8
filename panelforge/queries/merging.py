"""Merges, conflict logs and set operations on order lines, suppliers, parts and customers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import baselines, merge
from panelforge.operators.baselines import WALK_SQL
from panelforge.plans.panel import OBS_SQL, PANEL_SQL, observations, panel, programs, schools, table
from panelforge.plans.stored import stored

KEYS = ["school", "program", "year"]
ORDER = ["source_rank", "l_orderkey", "l_partkey", "v", "l_extendedprice", "l_discount", "l_tax"]


def source_rows(spark, sf_dir) -> DataFrame:
    """Order lines as rows of several sources, the newest having rank 0."""
    lines = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_partkey", "l_orderkey", "l_extendedprice", "l_discount", "l_tax", F.col("l_quantity").alias("v"),
        F.year("l_shipdate").alias("year"), (F.lit(7) - F.col("l_linenumber")).alias("source_rank"),
    )
    return (
        lines.join(programs(spark, sf_dir), "l_partkey")
        .join(schools(spark, sf_dir), "l_suppkey")
        .withColumn("source", F.concat(F.lit("s"), F.col("source_rank").cast("string")))
    )


def _order():
    return [F.col(c) for c in ORDER]


def priority_merge(spark, sf_dir):
    return merge.priority_merge(source_rows(spark, sf_dir), KEYS, _order()).select("county", *KEYS, "v", "source")


def drift_log(spark, sf_dir):
    return merge.drift(source_rows(spark, sf_dir), KEYS, _order(), "v", "source")


def uncertain_years(spark, sf_dir):
    """Years of a school in which two sources differ by 8 or more."""
    far = drift_log(spark, sf_dir).where(F.abs(F.col("kept") - F.col("ignored")) >= 8)
    return far.groupBy("school").agg(F.array_join(F.array_sort(F.collect_set("year")), ",").alias("uncertain_years"))


LINES_SQL = """
lines AS (
  SELECT r_name AS county, s_name AS school, p_brand AS program, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity AS v,
    7 - l_linenumber AS source_rank, 's' || (7 - l_linenumber) AS source, l_orderkey, l_partkey, l_extendedprice, l_discount, l_tax
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
placed AS (
  SELECT *, row_number() OVER w AS k, first_value(v) OVER w AS kept, first_value(source) OVER w AS kept_from FROM lines
  WINDOW w AS (PARTITION BY school, program, year ORDER BY source_rank, l_orderkey, l_partkey, v, l_extendedprice, l_discount, l_tax))"""


def case_insensitive_entities(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("county"), F.col("s_name").alias("name"), "s_suppkey")
    both = supplier.withColumn("source_rank", F.lit(0)).unionByName(
        supplier.select("county", F.upper("name").alias("name"), "s_suppkey", F.lit(1).alias("source_rank"))
    )
    named = merge.one_spelling(both, ["county"], "name", [F.col("source_rank"), F.col("s_suppkey")])
    return named.groupBy("county", "published").agg(F.count(F.lit(1)).alias("n"))


def occurrence_index(spark, sf_dir):
    """The number of each part among those of its brand with the same name but for case."""
    w = Window.partitionBy("p_brand", F.lower("p_type")).orderBy("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", (F.row_number().over(w) - 1).alias("occurrence"))


def first_wins(spark, sf_dir):
    """The first event of each user and type; later ones are repeats."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(w)).where("k = 1").select("user_id", "event_type", "event_id")


def overlay_precedence(spark, sf_dir):
    """Overrides: customers divisible by 7 get another segment, those divisible by 11 lose it."""
    base = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    over = base.where("c_custkey % 7 = 0 or c_custkey % 11 = 0").select(
        "c_custkey",
        F.create_map(F.lit("c_mktsegment"), F.when(F.col("c_custkey") % 11 != 0, F.lit("OVERRIDE"))).alias("fields"),
    )
    return merge.overlaid(base, over, "c_custkey", ["c_mktsegment"])


def carry_over(spark, sf_dir):
    """Even customers lost their balance in the new data; the old data know it by nation and name, some by name only."""
    c = table(spark, sf_dir, "customer")
    new = c.select(
        F.col("c_nationkey").alias("county"), F.col("c_name").alias("name"), F.when(F.col("c_custkey") % 2 == 1, F.col("c_acctbal")).alias("balance")
    )
    old = c.where("c_custkey % 4 <> 0").select(
        F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("county"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance")
    )
    return merge.carried_over(new, old, ["balance"])


def reject_anti_join(spark, sf_dir):
    """Orders whose customer is not on the reject list."""
    rejected = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, sf_dir, "orders").join(rejected, "o_custkey", "left_anti").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def live_without_forecast(spark, sf_dir):
    """Series that are alive (seen in the county's newest year or the one before) and have no forecast for the newest year."""
    obs = stored(observations(panel(spark, sf_dir)), "observations")
    newest = obs.groupBy("county").agg(F.max("year").alias("newest"))
    seen = obs.groupBy("county", "school", "program").agg(F.max("year").alias("last_year")).join(newest, "county")
    made = baselines.walk_forward(obs).join(newest, "county").where("T = newest").select("county", "school", "program")
    return seen.where("last_year >= newest - 1").select("county", "school", "program").join(made, ["county", "school", "program"], "left_anti")


def prefix_rename(spark, sf_dir):
    """Type names cut short after the first word stand for the only longer name that begins so."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_type", F.col("p_size").cast("string")).alias("full"))
    cut = part.select(
        "p_partkey", F.when(F.col("p_partkey") % 10 == 0, F.regexp_replace("full", " [^ ]*$", "")).otherwise(F.col("full")).alias("name")
    )
    return merge.prefix_renamed(cut, "name").groupBy("renamed").agg(F.count(F.lit(1)).alias("n"))


def sibling_levels(spark, sf_dir):
    """A placeholder level is the only other level of its programme, where there is only one."""
    cells = panel(spark, sf_dir).select(
        "county", "school", "category", "program", F.when(F.col("year") % 3 == 0, F.lit("Vg2/Vg3")).otherwise(F.col("level")).alias("level")
    )
    found = cells.where("level <> 'Vg2/Vg3'").groupBy("county", "school", "category").agg(
        F.count_distinct("level").alias("n"), F.min("level").alias("only")
    )
    joined = cells.join(found, ["county", "school", "category"], "left")
    level = F.when((F.col("level") == "Vg2/Vg3") & (F.col("n") == 1), F.col("only")).otherwise(F.col("level"))
    return joined.groupBy("county", level.alias("resolved")).agg(F.count(F.lit(1)).alias("n"))


def sources_merged(spark, sf_dir):
    """Full merge with repeats and placeholder levels, of two editions of the panel that partly disagree."""
    cells = panel(spark, sf_dir)
    number = F.regexp_extract("program", "([0-9]+)", 1).cast("int")
    a = cells.select(
        "county", F.lit("A").alias("source"), F.lit(0).alias("source_rank"), number.cast("bigint").alias("row_pos"), "school", "program", "level",
        "year", "status", "points",
    )
    b = a.select(
        "county", F.lit("B").alias("source"), F.lit(1).alias("source_rank"), "row_pos", F.upper("school").alias("school"), "program",
        F.when(F.col("row_pos") % 2 == 0, F.lit("Vg2/Vg3")).otherwise(F.col("level")).alias("level"), "year", "status",
        (F.col("points") + F.when(F.col("year") == 1996, 10).otherwise(0)).alias("points"),
    )
    series, _ = merge.merge_sources(a.unionByName(b))
    return series


QUERIES = {
    "priority_merge": (priority_merge, f"WITH {LINES_SQL} SELECT county, school, program, year, v, source FROM placed WHERE k = 1"),
    "drift_log": (drift_log, f"""WITH {LINES_SQL} SELECT school, program, year, kept, kept_from, v AS ignored, source AS ignored_from
      FROM placed WHERE k > 1 AND v IS DISTINCT FROM kept"""),
    "uncertain_years": (uncertain_years, f"""WITH {LINES_SQL} SELECT school, string_agg(year, ',' ORDER BY year) AS uncertain_years
      FROM (SELECT DISTINCT school, year FROM placed WHERE k > 1 AND abs(kept - v) >= 8) GROUP BY school"""),
    "case_insensitive_entities": (case_insensitive_entities, """SELECT s_nationkey AS county, s_name AS published, 2 * count(*) AS n
      FROM supplier GROUP BY ALL"""),
    "occurrence_index": (occurrence_index, """SELECT p_partkey, p_brand, p_type,
      CAST(row_number() OVER (PARTITION BY p_brand, lower(p_type) ORDER BY p_partkey) - 1 AS INTEGER) AS occurrence FROM part"""),
    "first_wins": (first_wins, """SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY ALL"""),
    "overlay_precedence": (overlay_precedence, """SELECT c_custkey, c_name, CASE WHEN c_custkey % 11 = 0 THEN NULL
      WHEN c_custkey % 7 = 0 THEN 'OVERRIDE' ELSE c_mktsegment END AS c_mktsegment FROM customer"""),
    "carry_over": (carry_over, """SELECT c_nationkey AS county, c_name AS name,
      CASE WHEN c_custkey % 2 = 1 OR c_custkey % 4 <> 0 THEN c_acctbal END AS balance FROM customer"""),
    "reject_anti_join": (reject_anti_join, """SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
      WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY ALL"""),
    "live_without_forecast": (live_without_forecast, f"""WITH {OBS_SQL + WALK_SQL}, n AS (SELECT county, max(year) AS newest FROM obs GROUP BY county)
      SELECT county, school, program FROM obs JOIN n USING (county) GROUP BY county, school, program, newest HAVING max(year) >= newest - 1
      EXCEPT SELECT county, school, program FROM preds JOIN n USING (county) WHERE T = newest"""),
    "prefix_rename": (prefix_rename, """WITH p AS (SELECT p_type || ' ' || p_size AS f, p_partkey FROM part),
      c AS (SELECT CASE WHEN p_partkey % 10 = 0 THEN regexp_replace(f, ' [^ ]*$', '') ELSE f END AS name FROM p),
      d AS (SELECT DISTINCT name FROM c),
      u AS (SELECT s.name, min(l.name) AS long FROM d s JOIN d l ON starts_with(l.name, s.name || ' ') GROUP BY s.name HAVING count(*) = 1)
      SELECT coalesce(u.long, c.name) AS renamed, count(*) AS n FROM c LEFT JOIN u USING (name) GROUP BY 1"""),
    "sibling_levels": (sibling_levels, f"""WITH {PANEL_SQL}, c AS (
      SELECT county, school, category, CASE WHEN year % 3 = 0 THEN 'Vg2/Vg3' ELSE level END AS level FROM panel),
      f AS (SELECT county, school, category, count(DISTINCT level) AS n, min(level) AS lone FROM c WHERE level <> 'Vg2/Vg3' GROUP BY ALL)
      SELECT county, CASE WHEN level = 'Vg2/Vg3' AND n = 1 THEN lone ELSE level END AS resolved, count(*) AS n
      FROM c LEFT JOIN f USING (county, school, category) GROUP BY 1, 2"""),
    "sources_merged": (sources_merged, None),
}
