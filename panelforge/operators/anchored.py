"""Windows anchored at events: each begins with the first event after the one before has run out.

Where a window begins depends on where the one before began, so the windows are a chain through all events. It is followed
without an ordered pass over all rows: every time points to the first time after its window would end, and pointers are
doubled (one join a round) until they have reached the end of the chain. What is chained is times to the millisecond, so a
day has at most 86 million, however many events it has; rounds grow with the logarithm of the number of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.plans.stored import stored

DAY = 86_400_000
WIDTH = 60_000  # of the smallest stretch of time that one task orders
FAN = 1024


def following(points: DataFrame, probes: DataFrame, width: int = WIDTH) -> DataFrame:
    """(x, next): of each ``probes.x`` the smallest ``points.x`` above it, null if there is none. Both are whole numbers.

    Numbers are dealt to stretches of ``width``. A probe with no point above it in its own stretch takes the least point of
    the next stretch that has one, which is the same question about far fewer numbers.
    """
    marked = points.select("x", F.lit(1).alias("point")).unionByName(probes.select("x", F.lit(0).alias("point"))).distinct()
    marked = marked.withColumn("stretch", F.floor(F.col("x") / F.lit(width)))
    # from the largest down; a probe that equals a point comes first, so it does not see it
    above = Window.partitionBy("stretch").orderBy(F.desc("x"), "point").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = marked.withColumn("next", F.last(F.when(F.col("point") == 1, F.col("x")), ignorenulls=True).over(above)).where("point = 0")
    seen = stored(seen.select("x", "stretch", "next"), "following")
    least = stored(
        points.groupBy(F.floor(F.col("x") / F.lit(width)).alias("stretch")).agg(F.min("x").alias("least")), "stretches"
    )
    found = seen.select("x", "next").where("next is not null")
    open_probes = seen.where("next is null")
    low, high = least.agg(F.min("stretch"), F.max("stretch")).first()
    if low is None:
        return open_probes.select("x", "next")
    # numbers of stretches from 0: the largest shrinks by FAN with each turn, until no probe is below it
    at = F.col("stretch") - F.lit(low)
    least = least.select(at.alias("stretch"), "least")
    open_probes = open_probes.select("x", F.greatest(at, F.lit(-1)).alias("stretch"))
    inside = open_probes.where(F.col("stretch") < high - low).select(F.col("stretch").alias("x")).distinct()
    later = following(least.select(F.col("stretch").alias("x")), inside, FAN) if high > low else inside.withColumn("next", F.lit(0).cast("bigint"))
    later = later.join(least, F.col("next") == F.col("stretch")).select(F.col("x").alias("stretch"), "least")
    return found.unionByName(open_probes.join(later, "stretch", "left").select("x", F.col("least").alias("next")))


def window_starts(times: DataFrame, span: int = DAY, width: int = WIDTH) -> DataFrame:
    """(start): of the chain of windows through ``times`` (ms); a time more than ``span`` after a start begins the next."""
    times = stored(times.where("ms is not null").select(F.col("ms").alias("x")).distinct(), "times")
    ends = following(times, times.select((F.col("x") + span).alias("x")), width)
    jump = stored(ends.where("next is not null").select((F.col("x") - span).alias("at"), F.col("next").alias("to")), "jumps")
    starts = times.agg(F.min("x").alias("start")).where("start is not null")
    known = starts.count()
    while known:
        ahead = stored(starts.join(jump, F.col("start") == F.col("at")).select(F.col("to").alias("start")), "starts")
        reached = ahead.count()
        starts = stored(starts.unionByName(ahead), "starts")
        if reached < known:  # the chain has ended
            break
        known += reached
        nearer, farther = jump.alias("nearer"), jump.alias("farther")
        jump = stored(
            nearer.join(farther, F.col("nearer.to") == F.col("farther.at")).select(F.col("nearer.at"), F.col("farther.to")), "jumps"
        )
    return starts


def capped_all(events: DataFrame, ts: str, order: str, most: int, counts: Column | None = None, span: int = DAY, width: int = WIDTH) -> DataFrame:
    """Add ``window_start`` (ms) and ``day_full``: whether ``most`` events of the same window have been let through before.

    One cap for all events, in the order of time (ms) and ``order``. ``counts`` tells which events use up the cap once they
    are let through; all of them by default. An event is let through until ``most`` that count have been, so the window's
    ``most``-th event that counts is all that must be known of it; tasks keep their first ``most`` of a window before rows
    are moved. An event without a time is in no window and never full; no events give an empty result.
    """
    counts = F.lit(True) if counts is None else F.coalesce(counts, F.lit(False))
    timed = events.withColumns({"_ms": F.unix_millis(F.col(ts).cast("timestamp")), "_counts": counts})
    starts = window_starts(timed.select(F.col("_ms").alias("ms")), span, width)
    # a window ends with the span, so an event's is one that starts in its own stretch of that length or the one before,
    # and each stretch has one start at most
    stretch = lambda x: F.floor(x / F.lit(span))
    near = starts.select(F.col("start").alias("window_start"), F.explode(F.array(stretch(F.col("start")), stretch(F.col("start")) + 1)).alias("_stretch"))
    near = stored(near, "windows")
    inside = (F.col("_ms") >= F.col("window_start")) & (F.col("_ms") <= F.col("window_start") + span)
    counted = timed.where("_counts").withColumn("_stretch", stretch(F.col("_ms"))).join(near, "_stretch").where(inside)
    first = F.row_number().over(Window.partitionBy("window_start").orderBy("_ms", order))
    last = counted.select("window_start", "_ms", order, first.alias("_k")).where(F.col("_k") <= most).where(F.col("_k") == most)
    last = last.select("window_start", F.struct(F.col("_ms").alias("ms"), F.col(order).alias("id")).alias("_last"))
    windows = stored(near.join(last, "window_start", "left"), "windows")
    own = F.struct(F.col("_ms").alias("ms"), F.col(order).alias("id"))
    # the condition is part of the join: an event whose two stretches hold no window of its own stays, as an event without time
    joined = timed.withColumn("_own", stretch(F.col("_ms"))).join(windows, (F.col("_own") == F.col("_stretch")) & inside, "left")
    full = F.coalesce(own > F.col("_last"), F.lit(False)) if most > 0 else F.col("window_start").isNotNull()
    return joined.withColumn("day_full", full).drop("_ms", "_counts", "_own", "_stretch", "_last")
