"""Derives the canonical tables from the order-processing star schema.

One line item is one ride; the customer of its order is the rider. All other
attributes are integer arithmetic on the keys, so any engine gets the same rows.
Every function takes and returns DataFrames and works on streams as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farewheel.params import SIGNUP_COMPLETED

RIDE_KEYS = ["ok", "ln", "pk", "sk", "h"]


def ride_numbers(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """What a ride is made of, numbers only: everything else about it follows row by row in
    ``rides_of_numbers``, so this is what travels."""
    return lineitem.select(
        F.col("l_orderkey").alias("ok"),
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").alias("pk"),
        F.col("l_suppkey").alias("sk"),
        F.col("l_quantity").alias("duration_min"),
        F.expr("l_returnflag = 'A'").alias("member"),
    ).join(
        orders.select(F.col("o_orderkey").alias("ok"), F.col("o_custkey").alias("user_id")), "ok"
    ).withColumn("start_offset", F.expr("(user_id * 37) % 640")).select(
        "ok", "ln", "pk", "sk", "user_id", "duration_min", "member",
        F.expr("""timestampadd(MINUTE,
            CAST((start_offset + (ok * 31 + ln * 17 + pk * 7) % (730 - start_offset)) * 1440
                 + ((ok * 7 + ln * 5) % 18 + 5) * 60 + pk % 60 AS INT),
            TIMESTAMP_NTZ'2022-01-01 00:00:00')""").alias("started_at"),
    )


def rides_of_numbers(numbers: DataFrame) -> DataFrame:
    """Rides plus the source keys from which the event tables are derived, row by row; columns
    that are not of a ride stay behind its own."""
    own = ["ok", "ln", "pk", "sk", "user_id", "duration_min", "member", "started_at"]
    return numbers.withColumn("ebike", F.expr("pk % 5 = 0 OR user_id % 11 = 0")).select(
        F.concat_ws("-", "ok", "ln", "pk", "sk").alias("ride_id"),
        "user_id",
        "started_at",
        "duration_min",
        F.expr("CASE WHEN member THEN 'Annual Member' ELSE 'Casual Member' END").alias("user_type"),
        F.expr("CASE WHEN ebike THEN 'EFIT' ELSE 'ICONIC' END").alias("bike_type"),
        F.col("sk").alias("station_id"),
        F.expr("""CAST(CASE
            WHEN member AND ebike THEN 0.10 * CAST(duration_min AS DECIMAL(10,1))
            WHEN member THEN 0
            WHEN ebike THEN 1.00 + 0.20 * CAST(duration_min AS DECIMAL(10,1))
            ELSE 1.00 + 0.12 * CAST(duration_min AS DECIMAL(10,1)) END
            AS DECIMAL(10,2))""").alias("ride_cost_cad"),
        "ok", "ln", "pk", "sk",
        F.expr("(ok * 3 + ln * 7 + pk) % 60").alias("h"),
        F.expr("timestampadd(MINUTE, CAST(duration_min AS INT), started_at)").alias("ended_at"),
        *[c for c in numbers.columns if c not in own],
    )


def rides_with_keys(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    """Rides plus the source keys from which the event tables are derived."""
    return rides_of_numbers(ride_numbers(lineitem, orders))


def event_numbers(keyed_rides: DataFrame) -> DataFrame:
    """What an event is made of, like ``ride_numbers``."""
    return keyed_rides.filter("h < 37").select(
        "ok", "ln", "pk", "sk", "h", "user_id", F.col("ended_at").alias("event_at"))


def events_of_numbers(numbers: DataFrame) -> DataFrame:
    own = ["ok", "ln", "pk", "sk", "h", "user_id", "event_at"]
    return numbers.select(
        F.concat_ws("-", "ok", "ln", "pk", "sk").alias("event_id"),
        "user_id",
        F.expr("""CASE WHEN h < 14 THEN 'cta_shown' WHEN h < 22 THEN 'cta_clicked'
            WHEN h < 27 THEN 'signup_started' WHEN h < 32 THEN 'signup_step_completed'
            WHEN h < 36 THEN 'signup_abandoned' ELSE 'signup_completed' END""").alias("event_type"),
        "event_at",
        F.expr("CASE WHEN h = 36 THEN IF(sk % 3 = 0, 'weekend', 'annual') END").alias("membership_tier"),
        F.expr("CASE WHEN h = 36 THEN CAST(IF(sk % 3 = 0, 63, 105) AS DECIMAL(10,2)) END").alias("price_cad"),
        F.expr("""CASE ok % 4 WHEN 0 THEN 'post_ride_nudge' WHEN 1 THEN 'email'
            WHEN 2 THEN 'geo_offer' ELSE 'organic' END""").alias("source_channel"),
        F.expr("IF(user_id % 2 = 0, 'control', 'treatment')").alias("nudge_variant"),
        F.expr("""concat('{"step": "', pk % 3 + 2, '"}')""").alias("event_metadata"),
        *[c for c in numbers.columns if c not in own],
    )


def membership_events(keyed_rides: DataFrame) -> DataFrame:
    return events_of_numbers(event_numbers(keyed_rides))


def app_events(keyed_rides: DataFrame) -> DataFrame:
    return keyed_rides.filter("(pk + ln) % 4 = 0").select(
        "user_id",
        F.expr("IF(pk % 25 = 0, 'app_uninstall', 'app_open')").alias("event_type"),
        F.col("started_at").alias("event_at"),
    )


def users(customer: DataFrame, nation: DataFrame, rides: DataFrame, events: DataFrame) -> DataFrame:
    first_rides = rides.groupBy("user_id").agg(F.min("started_at").alias("first_ride_at"))
    members = events.filter(F.col("event_type") == SIGNUP_COMPLETED).select("user_id").distinct()
    return (
        customer.join(nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        .select(
            F.col("c_custkey").alias("user_id"),
            F.expr("""CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Weekend Explorer'
                WHEN 'BUILDING' THEN 'Reluctant Commuter' WHEN 'FURNITURE' THEN 'Seasonal Visitor'
                WHEN 'HOUSEHOLD' THEN 'E-bike Adopter' END""").alias("persona_segment"),
            F.col("n_name").alias("city"),
            F.expr("CASE c_custkey % 3 WHEN 0 THEN 'app' WHEN 1 THEN 'web' ELSE 'kiosk' END")
            .alias("registration_channel"),
        )
        .join(first_rides, "user_id", "left")
        .join(members.withColumn("_member", F.lit(True)), "user_id", "left")
        .select(
            "user_id", "first_ride_at",
            F.expr("IF(_member, 'Annual Member', 'Casual Member')").alias("user_type"),
            "persona_segment", "city", "registration_channel",
        )
    )
