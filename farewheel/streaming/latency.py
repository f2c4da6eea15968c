"""How soon after the end of a ride its nudge was shown: a join of two streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farewheel.params import CASUAL, CTA_SHOWN
from farewheel.streaming.runtime import utc_as_wall_clock, wall_clock_as_utc

# What is promised is 30 seconds.
CLASSES = ((30, "within 30 s"), (120, "within 2 min"), (600, "within 10 min"))
NOT_SHOWN = "not shown"


def latency_class(seconds: Column) -> Column:
    out = None
    for limit, name in CLASSES:
        out = F.when(seconds <= limit, name) if out is None else out.when(seconds <= limit, name)
    return F.when(seconds.isNull(), NOT_SHOWN).otherwise(out)


def stream_nudge_latency(rides: DataFrame, events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Every casual ride with every nudge that its rider was shown up to ten minutes after it, or
    with none. ``rides`` has user_id, ride_id, user_type and ended_at, ``events`` has user_id,
    event_type and event_at, both times without zone.

    Both sides have a watermark, so a ride waits in state for ten minutes and the lateness, and a
    nudge for as long as a ride it may belong to can still come; then they are evicted. A ride
    without a nudge comes out when none can come any more.
    """
    ends = rides.filter((F.col("user_type") == CASUAL) & F.col("user_id").isNotNull()).select(
        "user_id", "ride_id", wall_clock_as_utc("ended_at").alias("end_at")).withWatermark("end_at", lateness)
    shown = events.filter(F.col("event_type") == CTA_SHOWN).select(
        F.col("user_id").alias("shown_to"), wall_clock_as_utc("event_at").alias("shown_at")).withWatermark("shown_at", lateness)
    longest = CLASSES[-1][0]
    near = F.expr(f"user_id = shown_to AND shown_at >= end_at AND shown_at <= end_at + INTERVAL {longest} SECONDS")
    joined = ends.join(shown, near, "leftOuter")
    seconds = (F.unix_micros("shown_at") - F.unix_micros("end_at")) / 1_000_000.0
    return joined.select(
        "user_id", "ride_id", utc_as_wall_clock(F.col("end_at")).alias("ended_at"), utc_as_wall_clock(F.col("shown_at")).alias("shown_at"),
        seconds.alias("latency_seconds"))


def first_nudges(pairs: DataFrame) -> DataFrame:
    """One row per ride: the first nudge after it, and its class."""
    first = pairs.groupBy("user_id", "ride_id", "ended_at").agg(F.min("latency_seconds").alias("latency_seconds"))
    return first.withColumn("latency_class", latency_class(F.col("latency_seconds")))
