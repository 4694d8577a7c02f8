"""Order-dependent operators on the event stream: islands, carried values, limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators import anchored, layout
from panelforge.plans.panel import table
from panelforge.streaming import admission


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp")))


def gap_islands(spark, sf_dir):
    """Sessions of a user: a new one after six hours without an event."""
    rows = layout.islands(_events(spark, sf_dir), ["user_id"], "sec", 21600.0)
    return rows.groupBy("user_id", "island").agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("least"), (F.max("sec") - F.min("sec")).alias("seconds"))


def forward_fill(spark, sf_dir):
    """The value of the last purchase, carried to every event of the user."""
    rows = _events(spark, sf_dir).withColumn("bought", F.when(F.col("event_type") == "purchase", F.col("value")))
    return layout.carried(rows, ["user_id"], ["sec", "event_id"], "bought", "last_bought").select("event_id", "last_bought")


def backward_fill(spark, sf_dir):
    """The type of a user's next event with another type."""
    w = Window.partitionBy("user_id").orderBy("sec", "event_id").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first(F.when(F.col("value") > 50, F.col("event_id")), ignorenulls=True).over(w)
    return _events(spark, sf_dir).select("event_id", nxt.alias("next_high"))


def nearest_column(spark, sf_dir):
    """Events as words on pages: the nearest of five columns."""
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).cast("int").alias("page"), F.col("value").alias("x"))
    heads = rows.select("page").distinct().select("page", F.posexplode(F.array(*[F.lit(c) for c in (10.0, 30.0, 50.0, 70.0, 90.0)])).alias("col_no", "cx"))
    return layout.nearest(rows, heads, ["page"]).select("event_id", "col_no")


def floor_column(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 7).cast("int").alias("page"), F.col("value").alias("x"))
    heads = rows.select("page").distinct().select("page", F.posexplode(F.array(*[F.lit(c) for c in (20.0, 40.0, 60.0, 80.0)])).alias("col_no", "x0"))
    return layout.floor_column(rows, heads, ["page"]).select("event_id", "col_no")


def band_join(spark, sf_dir):
    """The lowest of nested bands that holds each event's value."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit(0).alias("page"), F.col("value").alias("y"))
    bands = spark.createDataFrame([(0, 0.0, 80.0, "wide"), (0, 10.0, 40.0, "low"), (0, 35.0, 60.0, "mid"), (0, 36.0, 38.0, "slim")], "page int, top double, bottom double, band string")
    return layout.smallest_band(rows, bands, ["page"]).select("event_id", "band")


def before_gap(spark, sf_dir):
    """A user's events until the first pause of two days."""
    return layout.before_gap(_events(spark, sf_dir), ["user_id"], "sec", 172800.0).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("most"))


def modal_type(spark, sf_dir):
    """Each user's most frequent event type; of equals the one that sorts first."""
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("user_id").agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("event_type"), F.max("n").alias("n"))


def rate_limit_window(spark, sf_dir):
    """More than five events of a user within a day are refused."""
    return admission.limited(table(spark, sf_dir, "events"), "user_id", "ts", 86400, 5).select("event_id", "recent", "limited")


def daily_cap_anchored(spark, sf_dir):
    return admission.capped(table(spark, sf_dir, "events"), "user_id", "ts", 3)


def daily_cap_global(spark, sf_dir):
    """One cap of 20 a day over all events, the day beginning with the first event after the last one has run out."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    return anchored.capped_all(events, "ts", "event_id", 20)


#: Events as requests; the same text in both dialects.
REQUESTS = """SELECT event_id, ts,
  CASE WHEN event_type = 'view' AND event_id % 7 = 0 THEN 'GET' WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'PUT' ELSE 'POST' END AS method,
  CASE WHEN user_id % 13 = 0 THEN 'https://elsewhere.test' WHEN user_id % 4 = 0 THEN NULL WHEN user_id % 4 = 1 THEN 'http://localhost:3000'
    ELSE 'https://app.example.org' END AS origin,
  CASE WHEN user_id % 11 = 0 THEN '' ELSE ' 10.0.0.' || CAST(user_id AS STRING) || ' , 10.1.1.1' END AS forwarded,
  CASE WHEN event_id % 19 = 0 THEN substr(props, 1, length(props) - 1) WHEN event_id % 23 = 0 THEN '[1, 2]' WHEN event_id % 29 = 0 THEN '"text"'
    WHEN event_id % 31 = 0 THEN '' ELSE '{{"website": "' || CASE WHEN user_id % 17 = 0 THEN ' spam ' ELSE '  ' END || '", "message": "' ||
    CASE WHEN value < 5 THEN '  a ' ELSE event_type || '  ' || CAST(event_id AS STRING) END || '", "props": ' || props || '}}' END AS body
FROM {events}"""


def admission_outcome(spark, sf_dir):
    """Events as requests: what is refused, and why first."""
    requests = spark.sql(REQUESTS, events=table(spark, sf_dir, "events"))
    return admission.admit(requests, 86400, 5, 20).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def year_repair(spark, sf_dir):
    """Header years with repeats, made of order keys."""
    k = F.col("o_orderkey")
    years = F.array((2019 + k % 3).cast("int"), (2020 + k % 2).cast("int"), F.lit(2021))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(layout.repaired_years(years), ",").alias("years"))


SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
LIMITED = """l AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM events)"""
#: From e (event_id, ms, sends): the chain of windows, one after the other, and by rank which events find the cap of 20 used up.
CHAIN = """starts(s) AS (SELECT min(ms) FROM e UNION ALL SELECT (SELECT min(ms) FROM e WHERE ms > starts.s + 86400000) FROM starts WHERE starts.s IS NOT NULL),
      placed AS (SELECT e.*, s AS window_start FROM e ASOF JOIN (SELECT s FROM starts WHERE s IS NOT NULL) ON ms >= s),
      capped AS (SELECT *, coalesce(count(*) FILTER (sends) OVER (PARTITION BY window_start ORDER BY ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 20 AS day_full FROM placed)"""
QUERIES = {
    "gap_islands": (gap_islands, f"""WITH g AS (SELECT user_id, event_id, {SEC} AS sec, CASE WHEN {SEC} - lag({SEC}) OVER (PARTITION BY user_id ORDER BY {SEC}) > 21600 THEN 1 ELSE 0 END AS new FROM events),
      i AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS INTEGER) AS island FROM g)
      SELECT user_id, island, count(*) AS n, min(event_id) AS least, max(sec) - min(sec) AS seconds FROM i GROUP BY ALL"""),
    "forward_fill": (forward_fill, f"""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER
      (PARTITION BY user_id ORDER BY {SEC}, event_id ROWS UNBOUNDED PRECEDING) AS last_bought FROM events"""),
    "backward_fill": (backward_fill, f"""SELECT event_id, first_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER
      (PARTITION BY user_id ORDER BY {SEC}, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_high FROM events"""),
    "nearest_column": (nearest_column, """SELECT event_id, CAST(arg_min(c, (abs(value - (10 + 20 * c)), c)) AS INTEGER) AS col_no
      FROM events, (SELECT unnest([0, 1, 2, 3, 4]) AS c) GROUP BY event_id"""),
    "floor_column": (floor_column, """SELECT event_id, CAST(max(c) FILTER (20 + 20 * c <= value + 8) AS INTEGER) AS col_no
      FROM events, (SELECT unnest([0, 1, 2, 3]) AS c) GROUP BY event_id"""),
    "band_join": (band_join, """SELECT event_id, CASE WHEN value BETWEEN 36 AND 38 THEN 'slim' WHEN value BETWEEN 35 AND 60 THEN 'mid'
      WHEN value BETWEEN 10 AND 40 THEN 'low' WHEN value BETWEEN 0 AND 80 THEN 'wide' END AS band FROM events"""),
    "before_gap": (before_gap, f"""WITH g AS (SELECT user_id, event_id, {SEC} AS sec, CASE WHEN {SEC} - lag({SEC}) OVER (PARTITION BY user_id ORDER BY {SEC}) > 172800 THEN 1 ELSE 0 END AS new FROM events),
      i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY sec ROWS UNBOUNDED PRECEDING) AS island FROM g)
      SELECT user_id, count(*) AS n, max(event_id) AS most FROM i WHERE island = 0 GROUP BY user_id"""),
    "modal_type": (modal_type, """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c)
      SELECT user_id, event_type, n FROM r WHERE k = 1"""),
    "rate_limit_window": (rate_limit_window, f"WITH {LIMITED} SELECT event_id, recent, recent > 5 AS limited FROM l"),
    "daily_cap_anchored": (daily_cap_anchored, None),
    "daily_cap_global": (daily_cap_global, f"""WITH RECURSIVE e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, true AS sends FROM events), {CHAIN}
      SELECT event_id, ts, window_start, day_full FROM capped JOIN events USING (event_id)"""),
    "admission_outcome": (admission_outcome, f"""WITH RECURSIVE requests AS ({REQUESTS.format(events="events")}),
      read AS (SELECT *, CASE WHEN body = '' THEN '{{}}' ELSE body END AS b, CASE WHEN trim(split_part(forwarded, ',', 1)) = '' THEN 'unknown' ELSE trim(split_part(forwarded, ',', 1)) END AS sender FROM requests),
      unread AS (SELECT *, CASE WHEN method = 'GET' THEN 'status' WHEN method <> 'POST' THEN 'method'
        WHEN NOT regexp_matches(coalesce(origin, ''), '^$|^https://[a-z0-9-]+[.]example[.]org$|^http://(localhost|127[.]0[.]0[.]1)(:[0-9]+)?$') THEN 'origin'
        WHEN NOT json_valid(b) THEN 'json' WHEN json_type(b) NOT IN ('OBJECT', 'ARRAY') THEN 'json' END AS early FROM read),
      hits AS (SELECT *, count(*) OVER (PARTITION BY sender ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS recent FROM unread WHERE early IS NULL),
      kept AS (SELECT *, CASE WHEN recent > 5 THEN 'rate' WHEN trim(coalesce(json_extract_string(b, '$.website'), '')) <> '' THEN 'honeypot' END AS late FROM hits),
      e AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, length(trim(regexp_replace(coalesce(json_extract_string(b, '$.message'), ''), ' +', ' ', 'g'))) >= 3 AS sends FROM kept WHERE late IS NULL),
      {CHAIN}
      SELECT outcome, count(*) AS n FROM (SELECT early AS outcome FROM unread WHERE early IS NOT NULL UNION ALL SELECT late FROM kept WHERE late IS NOT NULL
        UNION ALL SELECT CASE WHEN day_full THEN 'cap' WHEN sends THEN 'ok' ELSE 'message' END FROM capped) GROUP BY 1"""),
    "year_repair": (year_repair, """WITH y AS (SELECT o_orderkey, 2019 + o_orderkey % 3 AS a, 2020 + o_orderkey % 2 AS b FROM orders),
      f AS (SELECT *, greatest(b, a + 1) AS b2, greatest(2021, greatest(b, a + 1) + 1) AS c2 FROM y)
      SELECT o_orderkey, CASE WHEN b2 - a = 1 AND c2 - b2 = 1 THEN a || ',' || b2 || ',' || c2 ELSE a || ',' || b || ',2021' END AS years FROM f"""),
}
