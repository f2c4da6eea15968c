"""Streams over the event table: step counts, sign-up sessions, delivery duplicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farewheel.functions.columns import flag
from farewheel.operators.profiles import is_event
from farewheel.params import (
    CTA_CLICKED, CTA_SHOWN, SIGNUP_ABANDONED, SIGNUP_COMPLETED, SIGNUP_STARTED, STEP_COMPLETED,
)
from farewheel.streaming.runtime import LATENESS, event_day, utc_as_wall_clock, wall_clock_as_utc

# Activity name in the event table -> event type of the funnel.
ACTIVITY = {
    "view": CTA_SHOWN,
    "click": CTA_CLICKED,
    "signup": SIGNUP_STARTED,
    "purchase": SIGNUP_COMPLETED,
    "error": SIGNUP_ABANDONED,
}


def funnel_events(events: DataFrame) -> DataFrame:
    """The raw activity table in funnel terms, with an event time for watermarks."""
    kind = F.create_map(*[F.lit(x) for pair in ACTIVITY.items() for x in pair])
    return events.select(
        "event_id", "user_id",
        F.try_element_at(kind, F.col("event_type")).alias("event_type"),
        F.get_json_object("props", "$.k").alias("step"),
        wall_clock_as_utc("ts").alias("event_at"),
    ).filter(F.col("event_type").isNotNull())


def stream_funnel(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Distinct riders per day and step, exact.

    A stream cannot count distinct, so the first event of each rider, step and day is
    kept and these are counted. Two events of one day are less than a day apart, hence
    with a lateness of a day the first one is always still remembered.
    """
    day_start = event_day("event_at")
    return (
        events.withWatermark("event_at", lateness)
        .withColumn("event_day", day_start)
        .dropDuplicatesWithinWatermark(["user_id", "event_type", "event_day"])
        .groupBy(F.window("event_at", "1 day"), "event_day", "event_type")
        .agg(F.count(F.lit(1)).alias("riders"))
        .select("event_day", "event_type", "riders")
    )


def stream_signup_sessions(
    events: DataFrame, gap: str = "30 minutes", lateness: str = LATENESS
) -> DataFrame:
    """Sign-up sessions, closed by a gap; started without completion is abandoned."""
    flow = is_event(SIGNUP_STARTED, STEP_COMPLETED, SIGNUP_ABANDONED, SIGNUP_COMPLETED)
    sessions = (
        events.filter(flow).withWatermark("event_at", lateness)
        .groupBy(F.session_window("event_at", gap), "user_id")
        .agg(
            F.count(F.lit(1)).alias("events"),
            F.max(flag(is_event(SIGNUP_STARTED))).alias("started"),
            F.max(flag(is_event(SIGNUP_COMPLETED))).alias("completed"),
        )
    )
    return sessions.filter("started = 1").select(
        "user_id",
        utc_as_wall_clock(F.col("session_window.start")).alias("session_start"),
        utc_as_wall_clock(F.col("session_window.end")).alias("session_end"),
        "events",
        (F.col("completed") == 0).alias("abandoned"),
    )


def stream_event_dedup(events: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each event once, however often it is delivered within the lateness."""
    return events.withWatermark("event_at", lateness).dropDuplicatesWithinWatermark(["event_id"]).select(
        "event_id", "user_id", "event_type", utc_as_wall_clock(F.col("event_at")).alias("event_at")
    )
