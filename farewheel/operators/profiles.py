"""Per-rider summaries that several operators join.

Joining raw rides with raw events on the rider multiplies both sides. Each side is
reduced to one row per rider first (map-side combined, so a rider with very many rows
costs no more than any other), and operators that must keep the multiplied numbers
get them back as counts times ``event_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farewheel.functions.columns import cents, flag, millis
from farewheel.params import (
    CTA_CLICKED, CTA_SHOWN, EBIKE, SIGNUP_COMPLETED,
)


def is_event(*types: str) -> Column:
    return F.col("event_type").isin(*types)


def ride_totals(rides: DataFrame) -> DataFrame:
    return rides.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rides"),
        F.count("duration_min").alias("timed_rides"),
        F.count("ride_cost_cad").alias("priced_rides"),
        F.sum(millis(F.col("duration_min"))).alias("millis"),
        F.sum(cents(F.col("ride_cost_cad"))).alias("cents"),
        F.sum(flag(F.col("bike_type") == EBIKE)).alias("ebike_rides"),
        F.max("started_at").alias("last_ride_at"),
    )


def event_totals(events: DataFrame) -> DataFrame:
    """Flags per rider over all given events; ``event_rows`` is the join multiplicity."""
    return events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_rows"),
        F.max(flag(is_event(CTA_SHOWN))).alias("shown"),
        F.max(flag(is_event(CTA_CLICKED))).alias("clicked"),
        F.max(flag(is_event(SIGNUP_COMPLETED))).alias("completed"),
    )


def first_conversion(events: DataFrame) -> DataFrame:
    return (
        events.filter(is_event(SIGNUP_COMPLETED))
        .groupBy("user_id").agg(F.min("event_at").alias("converted_at"))
    )


def zero(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0))
