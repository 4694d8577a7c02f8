import datetime
import random
import time

from pyspark.sql import functions as F

from panelforge.operators import anchored
from panelforge.streaming import admission

T0 = datetime.datetime(2024, 1, 1)


def test_rate_limit_batch_and_stream_agree(spark, tmp_path):
    times = [0, 1, 2, 3, 600, 603.5]
    rows = [(i, T0 + datetime.timedelta(seconds=t), 1) for i, t in enumerate(times)] + [(10, T0, 2)]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, ip long")
    batch = {r.event_id: r.limited for r in admission.limited(events, "ip", "ts", 600, 3).collect()}
    assert batch == {0: False, 1: False, 2: False, 3: True, 4: True, 5: False, 10: False}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = admission.limit_stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "ip", "ts", 600, 3, expire=False)
    query = stream.writeStream.format("memory").queryName("limits").outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    query = query.trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert {r.event_id: r.limited for r in spark.sql("SELECT * FROM limits").collect()} == batch


def test_daily_cap_is_anchored():
    hour = 3_600_000
    base = 10**12
    assert admission.daily_cap([base + h * hour for h in (0, 1, 2, 24, 25, 26)], 2) == [True, True, False, False, True, True]


def test_outcome_order(spark):
    ok = ("POST", "https://a.example.org", False, None, False, "hi")
    rows = [ok, ("GET", *ok[1:]), (ok[0], "http://evil", *ok[2:]), (*ok[:2], True, "x", True, ""), (*ok[:3], "x", True, ""), (*ok[:4], True, ""), (*ok[:5], " "), (None,) * 6]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, method string, origin string, limited boolean, website string, day_full boolean, message string")
    got = [r.o for r in df.select("i", admission.outcome().alias("o")).orderBy("i").collect()]
    assert got == ["ok", "method", "origin", "rate", "honeypot", "cap", "message", "method"]


def cap_by_hand(rows, most, span):
    """Rows (ms, id, counts) in order: {id: (start of the window, full)}."""
    out, since, sent = {}, None, 0
    for ms, key, counts in sorted(rows):
        if since is None or ms - since > span:
            since, sent = ms, 0
        out[key] = (since, sent >= most)
        sent += counts and sent < most
    return out


def test_one_cap_over_all_events_against_a_loop(spark):
    rand = random.Random(2)
    for most, times in (
        (3, [rand.randint(0, 3000) for _ in range(150)]),  # many windows, ties
        (2, [*range(0, 40_000, 1010), 10**7, 10**7 + 1000, 10**7 + 1001, 10**10]),  # every event a window; long silence
        (0, [5, 6, 2000]), (1, [7]), (5, []),
    ):
        rows = [(1_700_000_000_000 + t, i, rand.random() < 0.6) for i, t in enumerate(times)]
        made = [(i, datetime.datetime(1970, 1, 1) + datetime.timedelta(milliseconds=ms), c, "x") for ms, i, c in rows] + [(-1, None, True, "x")]
        events = spark.createDataFrame(made, "event_id long, ts timestamp_ntz, c boolean, stretch string")
        got = anchored.capped_all(events, "ts", "event_id", most, F.col("c"), span=1000, width=64)
        assert got.columns == ["event_id", "ts", "c", "stretch", "window_start", "day_full"]
        found = {r.event_id: (r.window_start, r.day_full) for r in got.collect()}
        assert found.pop(-1) == (None, False)
        assert found == cap_by_hand(rows, most, 1000)


def test_following_looks_beyond_empty_stretches(spark):
    points, probes = [3, 70, 71, 5_000_000, 9 * 10**12], [-(10**9), 2, 3, 64, 70, 71, 72, 10**6, 5_000_000, 9 * 10**12, 10**13]
    frames = [spark.createDataFrame([(x,) for x in xs], "x long") for xs in (points, probes)]
    got = {r.x: r.next for r in anchored.following(*frames, width=8).collect()}
    assert got == {p: min((x for x in points if x > p), default=None) for p in probes}


def admit_by_hand(rows, seconds, most, day_most):
    """Requests in order of time, one after the other."""
    out, seen, since, sent = {}, {}, None, 0
    for key, ts, early, sender, spam, sends in sorted(rows, key=lambda r: (r[1], r[0])):
        if early:
            out[key] = early
            continue
        hits = seen[sender] = [t for t in seen.get(sender, []) if ts - t < seconds] + [ts]
        if len(hits) > most:
            out[key] = "rate"
        elif spam:
            out[key] = "honeypot"
        else:
            if since is None or ts - since > 86400:
                since, sent = ts, 0
            out[key] = "cap" if sent >= day_most else "ok" if sends else "message"
            sent += out[key] == "ok"
    return out


def test_admission_against_a_loop(spark):
    rand = random.Random(3)
    bodies = {  # body: (refused unread, spam, sends)
        '{"message": "hello"}': (None, False, True), '{"message": " a  "}': (None, False, False), "[1]": (None, False, False), "": (None, False, False),
        None: (None, False, False), '{"message": "hello", "website": " x"}': (None, True, True), '{"website": 5, "message": "abc"}': (None, True, True),
        '{"message": "\\r\\n abc"}': (None, False, True), '{"message"': ("json", 0, 0), "3": ("json", 0, 0), '"text"': ("json", 0, 0), "null": ("json", 0, 0),
    }
    rows, plain = [], []
    for i, second in enumerate(sorted(rand.sample(range(400_000), 400))):
        method, origin = rand.choice(["POST"] * 8 + ["GET", "PUT", None]), rand.choice([None, "", "https://a.example.org", "http://127.0.0.1:80", "https://evil.test"])
        sender, body = rand.choice(["a", "b", "c", "", None, "d"]), rand.choice([*bodies, '{"message": "hello"}', '{"message": "hello"}'])
        early, spam, sends = bodies[body]
        early = "status" if method == "GET" else "method" if method != "POST" else "origin" if origin == "https://evil.test" else early
        rows.append((i, T0 + datetime.timedelta(seconds=second), method, origin, sender and f" {sender} , proxy", body, "x"))
        plain.append((i, second, early, sender or "unknown", spam, sends))
    frame = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, method string, origin string, forwarded string, body string, outcome string")
    got = {r.event_id: r.outcome for r in admission.admit(frame, 9000, 2, 6).collect()}
    assert got == admit_by_hand(plain, 9000, 2, 6)
    assert set(got.values()) == {"status", "method", "origin", "json", "rate", "honeypot", "cap", "message", "ok"}
    off = {r.outcome for r in admission.admit(frame, configured=False).collect()}
    assert off == {"status", "method", "origin", "config"}


def test_stream_of_limits_and_caps_goes_on_after_a_restart(spark, tmp_path):
    rand = random.Random(7)
    times = sorted(rand.sample(range(5000), 240))
    rows = [(i, T0 + datetime.timedelta(seconds=t), rand.choice([1, 1, 1, 2, 3])) for i, t in enumerate(times)]
    schema = "event_id long, ts timestamp_ntz, ip long"
    whole = spark.createDataFrame(rows, schema)
    limited = {r.event_id: (r.recent, r.limited) for r in admission.limited(whole, "ip", "ts", 600, 12).collect()}
    full = dict.fromkeys(limited, False)
    for ip in (1, 2, 3):
        passed = [(i, ts) for i, ts, k in rows if k == ip and not limited[i][1]]
        told = admission.daily_cap([int(ts.replace(tzinfo=datetime.timezone.utc).timestamp() * 1000) for _, ts in passed], 9, 1_500_000)
        full |= {i: not ok for (i, _), ok in zip(passed, told)}
    assert any(full.values()) and any(x for _, x in limited.values())
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for n, part in enumerate((rows[:90], rows[90:150], rows[150:] + [(999, None, 1), (998, T0, None)])):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
            made = admission.admission_stream(stream, "ip", "ts", 600, 12, 9, day=1_500_000)
            query = made.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
            query = query.trigger(processingTime="1 second").start()  # such a query runs on to see its timers
            try:
                for _ in range(60):
                    if sum(p.numInputRows for p in query.recentProgress):
                        break
                    time.sleep(1)
                assert query.exception() is None
            finally:
                query.stop()
            assert spark.read.parquet(str(tmp_path / "out")).count() == (90, 150, 240)[n]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = {r.event_id: (r.recent, r.limited, r.day_full) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {i: (*limited[i], full[i]) for i in limited}


def test_delivered_batches_are_written_once(spark, tmp_path):
    rows = [(i, T0 + datetime.timedelta(seconds=i), 1) for i in range(5)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, ip long").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz, ip long").parquet(str(tmp_path / "in"))
    query = admission.deliver(stream.withColumn("limited", F.col("event_id") > 2), str(tmp_path / "out"), str(tmp_path / "c"))
    query.processAllAvailable()
    query.stop()
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [0, 1, 2]
