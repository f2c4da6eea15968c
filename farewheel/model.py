"""Schemas of the canonical tables and the bundle that operators receive."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, types as T

RIDES = T.StructType([
    T.StructField("ride_id", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("started_at", T.TimestampNTZType()),
    T.StructField("ended_at", T.TimestampNTZType()),
    T.StructField("duration_min", T.DoubleType()),
    T.StructField("user_type", T.StringType()),
    T.StructField("bike_type", T.StringType()),
    T.StructField("station_id", T.LongType()),
    T.StructField("ride_cost_cad", T.DecimalType(10, 2)),
])

MEMBERSHIP_EVENTS = T.StructType([
    T.StructField("event_id", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_at", T.TimestampNTZType()),
    T.StructField("membership_tier", T.StringType()),
    T.StructField("price_cad", T.DecimalType(10, 2)),
    T.StructField("source_channel", T.StringType()),
    T.StructField("nudge_variant", T.StringType()),
    T.StructField("event_metadata", T.StringType()),
])

USERS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("first_ride_at", T.TimestampNTZType()),
    T.StructField("user_type", T.StringType()),
    T.StructField("persona_segment", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("registration_channel", T.StringType()),
])

APP_EVENTS = T.StructType([
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("event_at", T.TimestampNTZType()),
])

@dataclass(frozen=True)
class Tables:
    """The four canonical tables. ``rides`` and the two event tables may carry a
    month partition column next to the columns of their schema."""

    rides: DataFrame
    membership_events: DataFrame
    users: DataFrame
    app_events: DataFrame
