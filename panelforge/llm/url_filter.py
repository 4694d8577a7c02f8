"""URL filter lists as they stood when each page was fetched.

A list is a log of dated changes: a pattern (a domain, which also stands for its subdomains) is added to or removed
from a category. Changes become validity intervals, each from an addition to the next change of the same
pattern and category; a capture is judged by the intervals that hold at its fetch time. Of several, the most
specific pattern decides, then ``allow`` before ``block``, then the category that sorts first.

Captures are first reduced to distinct (host, fetch date), so a host with a large share of all captures is looked
up a few times only; whether the interval side is broadcast is left to its measured size.

Defined cases: a URL without scheme and host has a null host and is never listed; a null fetch date matches no
interval; changes with a null pattern, date or category are left out; of an addition and a removal at the same
time, the removal holds; repeated captures give repeated rows; empty tables give no listings; columns of the
captures that are named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import quoted, table

#: The production list, as (pattern, category, action, change, date).
CHANGES = (
    ("spam-farm.example.org", "spam", "block", "add", "2024-02-01"),
    ("spam-farm.example.org", "spam", "block", "remove", "2024-06-15"),
    ("spam-farm.example.org", "spam", "block", "add", "2024-09-01"),
    ("adult-x.example.net", "adult", "block", "add", "2024-01-01"),
    ("m.adult-x.example.net", "review", "allow", "add", "2024-03-01"),
    ("m.adult-x.example.net", "review", "allow", "remove", "2024-05-01"),
    ("malware-drop.example.com", "malware", "block", "add", "2024-01-15"),
    ("tionsh.example.net", "mirror", "block", "add", "2024-04-01"),
    ("tionsh.example.net", "mirror", "block", "remove", "2024-10-01"),
    ("blog.tionsh.example.net", "review", "allow", "add", "2024-07-01"),
    ("ththre.example.org", "copyright", "block", "add", "2024-08-01"),
    ("ththre.example.org", "copyright", "block", "remove", "2024-08-01"),
    ("therat.example.net", "spam", "block", "add", "2024-05-01"),
    ("therat.example.net", "mirror", "block", "add", "2024-05-01"),
)
DDL = "pattern string, category string, action string, change string, changed_on string"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; null if there is none."""
    found = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    found = F.regexp_replace(F.regexp_replace(F.regexp_replace(found, "^.*@", ""), ":[0-9]*$", ""), "[.]+$", "")
    return F.nullif(found, F.lit(""))


def intervals(changes: DataFrame) -> DataFrame:
    """(pattern, category, action, valid_from, valid_to) from dated changes; an open interval has no valid_to."""
    w = Window.partitionBy("pattern", "category").orderBy("valid_from")
    return (
        changes.where("pattern is not null and category is not null and changed_on is not null")
        .groupBy(F.lower("pattern").alias("pattern"), "category", F.col("changed_on").cast("date").alias("valid_from"))
        .agg(F.max("change").alias("change"), F.min("action").alias("action"))
        .withColumn("valid_to", F.lead("valid_from").over(w))
        .where("change = 'add'")
        .select("pattern", "category", "action", "valid_from", "valid_to")
    )


def judge(captures: DataFrame, changes: DataFrame, url: str = "url", fetched: str = "fetched_on") -> DataFrame:
    """Add host, decision (block, allow or none), and the pattern, category and start of the interval that decided."""
    results = ("host", "decision", "pattern", "category", "valid_from")
    kept = [c for c in captures.columns if c not in results]
    seen = captures.select(
        F.struct(*[F.col(quoted(c)) for c in kept]).alias("row"),
        host_of(F.col(quoted(url))).alias("host"),
        F.col(quoted(fetched)).cast("date").alias("day"),
    )
    labels = F.split("host", "[.]")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")
    )
    keys = seen.where("host is not null and day is not null").select("host", "day").distinct()
    order = F.struct(
        (-F.size(F.split("pattern", "[.]"))).alias("n"), (F.col("action") != "allow").alias("block"), F.col("category")
    )
    decided = (
        keys.select("host", "day", F.explode(suffixes).alias("pattern"))
        .join(intervals(changes), "pattern")
        .where("valid_from <= day and (valid_to is null or day < valid_to)")
        .groupBy("host", "day")
        .agg(F.min_by(F.struct("action", "pattern", "category", "valid_from"), order).alias("by"))
    )
    return seen.join(decided, ["host", "day"], "left").select(
        *[F.col(f"row.{quoted(c)}") for c in kept],
        "host",
        F.coalesce("by.action", F.lit("none")).alias("decision"),
        F.col("by.pattern").alias("pattern"),
        F.col("by.category").alias("category"),
        F.col("by.valid_from").alias("valid_from"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")).alias("fetched_on")
    )
    changes = spark.createDataFrame(CHANGES, DDL)
    return judge(pages, changes).select(
        "page_id",
        "host",
        F.col("fetched_on").cast("string").alias("fetched_on"),
        "decision",
        "pattern",
        "category",
        F.col("valid_from").cast("string").alias("valid_from"),
    )


ORACLE_SQL = f"""
WITH changes(pattern, category, action, change, changed_on) AS (
  VALUES {", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in CHANGES)}),
events AS (
  SELECT lower(pattern) AS pattern, category, CAST(changed_on AS DATE) AS valid_from, max(change) AS change, min(action) AS action
  FROM changes GROUP BY 1, 2, 3),
spans AS (
  SELECT *, lead(valid_from) OVER (PARTITION BY pattern, category ORDER BY valid_from) AS valid_to FROM events),
captures AS (
  SELECT page_id, DATE '2024-01-01' + CAST(page_id % 366 AS INTEGER) AS fetched_on,
    nullif(regexp_replace(regexp_replace(regexp_replace(
      regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '[.]+$', ''), '') AS host
  FROM pages),
ranked AS (
  SELECT c.page_id, c.host, c.fetched_on, s.pattern, s.category, s.action, s.valid_from,
    row_number() OVER (PARTITION BY c.page_id, c.host, c.fetched_on
      ORDER BY len(string_split(s.pattern, '.')) DESC, s.action = 'allow' DESC, s.category) AS k
  FROM captures c JOIN spans s ON s.change = 'add' AND (c.host = s.pattern OR c.host LIKE '%.' || s.pattern)
    AND s.valid_from <= c.fetched_on AND (s.valid_to IS NULL OR c.fetched_on < s.valid_to))
SELECT c.page_id, c.host, CAST(c.fetched_on AS VARCHAR) AS fetched_on, coalesce(r.action, 'none') AS decision,
  r.pattern, r.category, CAST(r.valid_from AS VARCHAR) AS valid_from
FROM captures c LEFT JOIN ranked r ON r.k = 1 AND c.page_id = r.page_id AND c.host = r.host AND c.fetched_on = r.fetched_on
"""
