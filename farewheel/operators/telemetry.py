"""Event attributes that depend on a rider's history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from farewheel.functions.blocks import ROWS_PER_USER, previous_and_running_max, running_sums, running_sums_of_users
from farewheel.functions.columns import cents, money, seconds_between
from farewheel.functions.horizon import until_as_of
from farewheel.operators.profiles import is_event
from farewheel.params import (
    SIGNUP_ABANDONED, SIGNUP_COMPLETED, SIGNUP_STARTED, STEP_COMPLETED,
)


@until_as_of
def hashed_user_events(
    rides: DataFrame, users: DataFrame, events: DataFrame, salt: str, days: int = 30, rows_per_user: int = ROWS_PER_USER
) -> DataFrame:
    """Events with a hashed rider, persona, and rides and spend of the ``days`` before.
    The ``salt`` is a secret of the caller: without one, small numbers can be hashed until
    one fits.

    A ride counts from its start until ``days`` later, both ends included: it enters as
    +1 and leaves as -1, and the running sum at the event is the answer. Rides and events
    are dealt by rider once, and a ride becomes two changes after that. Riders with more than
    ``rows_per_user`` rows are cut into hour blocks, so no such history is in one task.
    """
    history = events.select(
        "user_id", F.col("event_at").alias("at"), "event_id", "event_type", F.lit(None).cast("long").alias("cents"),
    ).unionByName(rides.select(
        "user_id", F.col("started_at").alias("at"),
        F.coalesce(cents(F.col("ride_cost_cad")), F.lit(0).cast("long")).alias("cents"),
    ), allowMissingColumns=True).filter("user_id IS NOT NULL AND at IS NOT NULL")
    hot = history.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_user).select("user_id")
    few = history.join(F.broadcast(hot), "user_id", "left_anti").repartition("user_id")
    many = history.join(F.broadcast(hot), "user_id", "left_semi")

    def change(at: Column, rank: int, sign: int) -> Column:
        return F.struct(at.alias("at"), F.lit(rank).alias("rank"), F.lit(sign).alias("ride"),
                        (F.coalesce("cents", F.lit(0).cast("long")) * sign).alias("spend"))

    left = F.col("at") + F.expr(f"INTERVAL '{days}' DAY")
    changes = F.when(F.col("cents").isNull(), F.array(change(F.col("at"), 1, 0))).otherwise(
        F.array(change(F.col("at"), 0, 1), change(left, 2, -1)))

    def summed(part: DataFrame, sums: Callable[..., DataFrame]) -> DataFrame:
        timeline = part.select("user_id", "event_id", "event_type", F.explode(changes).alias("c")).select(
            "user_id", "event_id", "event_type", "c.*")
        return sums(
            timeline, "user_id", "at", [F.col("at"), F.col("rank")],
            {"rides_before": "ride", "spend_before": "spend"},
            attach=users.select("user_id", "persona_segment"),
        ).filter(F.col("rank") == 1)

    return summed(few, running_sums_of_users).unionByName(summed(many, running_sums)).select(
        "event_id", "event_type", F.col("at").alias("event_at"),
        F.sha2(F.concat(F.lit(salt), F.col("user_id").cast("string")), 256).alias("user_hash"),
        "persona_segment",
        F.col("rides_before").alias("ride_count_30d"),
        money(F.col("spend_before")).alias("cumulative_spend_30d"),
    )


@until_as_of
def time_in_step(events: DataFrame) -> DataFrame:
    """Seconds since the step before and since the start of the flow, per sign-up event.
    A flow begins with the latest start; events before any start have no times."""
    flow = events.filter(
        is_event(SIGNUP_STARTED, STEP_COMPLETED, SIGNUP_ABANDONED, SIGNUP_COMPLETED)
    ).select(
        "user_id", "event_id", "event_type", "event_at",
        F.when(is_event(SIGNUP_STARTED), F.col("event_at")).alias("start_at"),
    )
    timed = previous_and_running_max(
        flow, "user_id", "event_at", ["event_at", "event_id"],
        previous="previous_at", running={"flow_started_at": "start_at"},
    )
    same_flow = F.col("previous_at") >= F.col("flow_started_at")
    begins = is_event(SIGNUP_STARTED)
    return timed.select(
        "user_id", "event_id", "event_type", "event_at",
        F.when(same_flow & ~begins, seconds_between(F.col("previous_at"), F.col("event_at")).cast("double"))
        .alias("time_on_step_seconds"),
        seconds_between(F.col("flow_started_at"), F.col("event_at")).cast("double").alias("time_in_flow_seconds"),
    )
