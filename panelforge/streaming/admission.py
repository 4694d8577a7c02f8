"""Admission of requests: a sliding limit by address, an anchored cap for all, and an ordered list of reasons."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from panelforge.functions.text import one_line, paragraphs
from panelforge.operators.anchored import capped_all
from panelforge.plans.stored import stored


def limited(events: DataFrame, key: str, ts: str, seconds: int, most: int) -> DataFrame:
    """Add ``recent`` (events of the key in the last ``seconds``, itself included, the far end excluded) and ``limited``.

    Refused events count as well. Time is cut into stretches of that length, and each stretch of a key is a group of its own, so
    the events of a busy key are dealt, too. An event counts in its stretch from its time on and in the next one until it is
    ``seconds`` old: both are running counts, and no event is looked at again for each that follows.
    """
    span = seconds * 1_000_000
    timed = events.withColumns({"_at": F.unix_micros(F.col(ts).cast("timestamp")), "_own": F.lit(True)})
    ended = timed.select(F.col(key), (F.col("_at") + span).alias("_at"), F.lit(False).alias("_own"))
    both = timed.unionByName(ended, allowMissingColumns=True).withColumn("_stretch", F.col("_at") - F.pmod("_at", F.lit(span)))
    stretch = Window.partitionBy(key, "_stretch")
    so_far = stretch.orderBy("_at").rangeBetween(Window.unboundedPreceding, 0)
    begun, ends = F.count_if(F.col("_own")), F.count_if(~F.col("_own"))
    counted = both.withColumn("recent", begun.over(so_far) + ends.over(stretch) - ends.over(so_far)).where("_own")
    return counted.drop("_at", "_own", "_stretch").withColumn("limited", F.col("recent") > most)


def daily_cap(times: list[int], most: int, day: int = 86_400_000) -> list[bool]:
    """Which requests (ms, in order) are let through: the window starts anew with the first one after it has run out,
    and only what was let through counts."""
    since, sent, out = 0, 0, []
    for t in times:
        if t - since > day:
            since, sent = t, 0
        out.append(sent < most)
        sent += sent < most
    return out


def capped(events: DataFrame, key: str, ts: str, most: int) -> DataFrame:
    """(key, event_id, ok) by ``daily_cap``: an ordered fold over each key. The key is the sending site, few events each."""

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ms", "event_id"])
        return pd.DataFrame({key: frame[key], "event_id": frame["event_id"], "ok": daily_cap(frame["ms"].tolist(), most)})

    rows = events.select(F.col(key).cast("bigint").alias(key), "event_id", F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return rows.groupBy(key).applyInPandas(fold, f"{key} bigint, event_id bigint, ok boolean")


def outcome(max_message: int = 4000) -> Column:
    """The first reason to refuse, in order: method, origin, rate, honeypot, cap, message; else ok.

    Needs columns method, origin, limited, website, day_full, message.
    """
    allowed = F.coalesce(F.col("origin").rlike(r"^(https://[a-z0-9-]+\.example\.org|http://(localhost|127\.0\.0\.1)(:[0-9]+)?)$"), F.lit(False))
    empty = F.trim(F.coalesce("message", F.lit(""))) == ""
    return (
        F.when(F.coalesce("method", F.lit("")) != "POST", "method")
        .when(~allowed, "origin")
        .when(F.col("limited"), "rate")
        .when(F.coalesce("website", F.lit("")) != "", "honeypot")
        .when(F.col("day_full"), "cap")
        .when(empty | (F.length("message") > max_message), "message")
        .otherwise("ok")
    )


OWN_SITES = r"^https://[a-z0-9-]+\.example\.org$"
LOCAL_SITES = r"^http://(localhost|127\.0\.0\.1)(:[0-9]+)?$"


def refused_unread(configured: bool = True, own: str = OWN_SITES) -> Column:
    """Why a request is refused before its sender is counted, null if it is not: status (a GET is answered), method, origin
    (absent is allowed), config (nowhere to deliver to), json (neither an object nor a list; an empty body is an object).

    Needs columns method, origin, body.
    """
    method, origin = F.coalesce("method", F.lit("")), F.coalesce("origin", F.lit(""))
    body = F.coalesce(F.nullif(F.col("body"), F.lit("")), F.lit("{}"))
    readable = F.try_parse_json(body).isNotNull() & body.rlike(r"^\s*[{\[]")
    return (
        F.when(method == "GET", "status")
        .when(method != "POST", "method")
        .when((origin != "") & ~origin.rlike(own) & ~origin.rlike(LOCAL_SITES), "origin")
        .when(F.lit(not configured), "config")
        .when(~readable, "json")
    )


def field(name: str) -> Column:
    """A field of the body as text; null where the body is a list or has none."""
    return F.get_json_object("body", f"$.{name}")


def admit(
    requests: DataFrame, seconds: int = 600, most: int = 3, day_most: int = 80, configured: bool = True, own: str = OWN_SITES
) -> DataFrame:
    """(event_id, outcome) of every request (event_id, ts, method, origin, forwarded, body), with one rule after the other.

    Requests that can be read count against their sender, also if they are refused for that; what a sender may still send
    meets the honeypot, then the day's cap, which is one for all senders and counts messages that are sent on. So each rule
    sees only what the rules before it have left: rates are windows over a sender's requests, the cap is ``capped_all``.
    """
    sender = F.trim(F.get(F.split(F.coalesce("forwarded", F.lit("")), ","), F.lit(0)))
    message = F.length(paragraphs(field("message"), 4000)) >= 3
    # bodies are read once; what is left of a request is small
    read = requests.select(
        "event_id", "ts", F.coalesce(F.nullif(sender, F.lit("")), F.lit("unknown")).alias("sender"), refused_unread(configured, own).alias("outcome"),
        (one_line(field("website"), 50) != "").alias("honeypot"), message.alias("sends"),
    )
    read = stored(read, "requests")
    counted = limited(read.where("outcome is null"), "sender", "ts", seconds, most)
    counted = counted.select("event_id", "ts", F.when(F.col("limited"), "rate").when(F.col("honeypot"), "honeypot").alias("outcome"), "sends")
    counted = stored(counted, "counted")
    capped = capped_all(counted.where("outcome is null"), "ts", "event_id", day_most, F.col("sends"))
    last = F.when(F.col("day_full"), "cap").when(~F.col("sends"), "message").otherwise("ok")
    parts = (read.where("outcome is not null"), counted.where("outcome is not null"), capped.withColumn("outcome", last))
    return reduce(DataFrame.unionByName, [p.select("event_id", "outcome") for p in parts])


STATE = "hits array<bigint>"


def limit_stream(events: DataFrame, key: str, ts: str, seconds: int, most: int, expire: bool = True) -> DataFrame:
    """The sliding limit on a stream: (key, event_id, recent, limited), with the recent times of each key as state.

    With ``expire``, state is dropped when a key has been quiet for the window, so it is bounded by the keys that are
    active; such a query runs on without input to see timeouts. Without it, a key keeps its last few times.
    """
    span = seconds * 1000

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = list(state.get[0]) if state.exists else []
        for frame in frames:
            counts = []
            frame = frame.sort_values(["ms", "event_id"])
            for t in frame["ms"].tolist():
                hits = [h for h in hits if t - h < span] + [t]
                counts.append(len(hits))
            yield pd.DataFrame({key: frame[key], "event_id": frame["event_id"], "recent": counts, "limited": [c > most for c in counts]})
        state.update((hits,))
        if expire:
            state.setTimeoutDuration(span)

    rows = events.select(F.col(key).cast("bigint").alias(key), "event_id", F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} bigint, event_id bigint, recent bigint, limited boolean", STATE, "append",
        GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout,
    )


class Limiter(StatefulProcessor):
    """State of one sender: its requests within the window, counted by millisecond, and its day's beginning and number sent.

    Times in the list expire one by one, ``keep`` ms after they were written; a timer then wakes a sender that has gone quiet,
    so that what remains of its state goes too.
    """

    def __init__(self, key: str, span: int, most: int, day_most: int, day: int, keep: int):
        self.key, self.span, self.most, self.day_most, self.day, self.keep = key, span, most, day_most, day, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "ms bigint, n bigint", ttlDurationMs=self.keep)
        self.cap = handle.getValueState("cap", "since bigint, sent bigint", ttlDurationMs=self.keep + self.day)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values(["ms", "event_id"], ignore_index=True)  # of one sender in one micro-batch
        held = deque(sorted((ms, n) for ms, n in self.hits.get()))
        total = sum(n for _, n in held)
        since, sent = self.cap.get() if self.cap.exists() else (None, 0)
        recent, full = [], []
        for t in frame["ms"].tolist():
            while held and t - held[0][0] >= self.span:
                total -= held.popleft()[1]
            if held and held[-1][0] == t:
                held[-1] = (t, held[-1][1] + 1)
            else:
                held.append((t, 1))
            total += 1
            recent.append(total)
            if total > self.most:
                full.append(False)
                continue
            if since is None or t - since > self.day:
                since, sent = t, 0
            full.append(sent >= self.day_most)
            sent += sent < self.day_most
        self.hits.put(list(held))
        if since is not None:
            self.cap.update((since, sent))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep + self.day)
        yield pd.DataFrame(
            {self.key: frame[self.key], "event_id": frame["event_id"], "recent": recent, "limited": [n > self.most for n in recent], "day_full": full}
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.hits.clear()
        self.cap.clear()
        return iter(())

    def close(self) -> None:
        pass


def admission_stream(
    events: DataFrame, key: str, ts: str, seconds: int, most: int, day_most: int, day: int = 86_400_000, lag: int = 600_000
) -> DataFrame:
    """(key, event_id, recent, limited, day_full) of a stream: the sliding limit and then each sender's own anchored cap.

    Requests of one millisecond come in order of their id, where ``limited`` counts all of them for each. Requests that are
    limited do not count towards the cap. Requests carry the time of their arrival and are read at most ``lag``
    ms later; entries are kept for the window and this lag, so one that expires is out of every window to come. A request
    that comes in a later batch than a newer one of its sender is taken as it comes. Requests without a sender or a time are
    left out. Needs the RocksDB state store, and a query that runs on to see timers.
    """
    rows = events.select(F.col(key).cast("bigint").alias(key), "event_id", F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    return rows.where(F.col(key).isNotNull() & F.col("ms").isNotNull()).groupBy(key).transformWithStateInPandas(
        Limiter(key, seconds * 1000, most, day_most, day, seconds * 1000 + lag),
        f"{key} bigint, event_id bigint, recent bigint, limited boolean, day_full boolean", "append", "ProcessingTime",
    )


def deliver(stream: DataFrame, path: str, checkpoint: str):
    """Write what was let through, each micro-batch once; sending it on is left to whoever reads the table."""

    def batch(rows: DataFrame, epoch: int) -> None:
        rows.where("not limited").write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(batch).start()
