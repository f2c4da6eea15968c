"""Conversion funnel operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.functions.columns import (
    cents, flag, minutes, money, ratio, rnd, seconds_between, since, ts, whole_days_between,
)
from farewheel.functions.horizon import until_as_of
from farewheel.functions.skew import ROWS_PER_TASK, join_hot_keys
from farewheel.operators.profiles import (
    event_totals, first_conversion, is_event, ride_totals, zero,
)
from farewheel.params import (
    CASUAL, CTA_CLICKED, CTA_SHOWN, DEFAULTS, Params, SIGNUP_ABANDONED, SIGNUP_COMPLETED,
    SIGNUP_STARTED, STEP_COMPLETED,
)

STEPS = ["cta_shown", "cta_clicked", "signup_started", "signup_completed"]


def daily_step_counts(rides: DataFrame, events: DataFrame, p: Params, lookback: int) -> DataFrame:
    """Distinct riders per event date and step; ride days without an event that day
    share the NULL date.

    Both sides shrink to one row per rider and day before they meet, so the join can
    never multiply, and distinct counts become plain sums of flags.
    """
    start = p.days_ago(lookback)
    ride_days = since(rides, "started_at", start).groupBy(
        "user_id", F.to_date("started_at").alias("event_day")
    ).agg(F.max(flag((F.col("user_type") == CASUAL) & F.col("user_id").isNotNull())).alias("casual_riders"))
    event_days = since(events, "event_at", start).groupBy(
        "user_id", F.to_date("event_at").alias("event_day")
    ).agg(*[F.max(flag(is_event(step))).alias(step) for step in STEPS])
    matched = ride_days.join(
        event_days.withColumn("event_date", F.col("event_day")), ["user_id", "event_day"], "left"
    )
    per_rider = matched.groupBy("event_date", "user_id").agg(
        F.max("casual_riders").alias("casual_riders"),
        *[F.coalesce(F.max(step), F.lit(0)).alias(step) for step in STEPS],
    )
    return per_rider.groupBy("event_date").agg(
        *[F.sum(name).alias(name) for name in ["casual_riders", *STEPS]]
    )


@until_as_of
def funnel_daily(
    rides: DataFrame, events: DataFrame, p: Params = DEFAULTS, lookback: int = 30
) -> DataFrame:
    daily = daily_step_counts(rides, events, p, lookback)
    # one row per day: an unpartitioned window is small whatever the ride volume
    last_seven_rows = Window.orderBy(F.col("event_date").asc_nulls_last()).rowsBetween(-6, 0)
    conversion = ratio(F.col("signup_completed"), F.col("casual_riders"))
    return daily.select(
        "event_date", "casual_riders", *STEPS,
        rnd(ratio(F.col("cta_shown"), F.col("casual_riders")), 4).alias("exposure_rate"),
        rnd(ratio(F.col("cta_clicked"), F.col("cta_shown")), 4).alias("cta_ctr"),
        rnd(ratio(F.col("signup_started"), F.col("cta_clicked")), 4).alias("click_to_start"),
        rnd(ratio(F.col("signup_completed"), F.col("signup_started")), 4).alias("start_to_complete"),
        rnd(conversion, 4).alias("conversion_rate"),
        rnd(F.avg(conversion).over(last_seven_rows), 4).alias("conversion_rate_7d_avg"),
    ).orderBy(F.col("event_date").desc_nulls_last())


@until_as_of
def funnel_by_persona(
    rides: DataFrame, users: DataFrame, events: DataFrame, p: Params = DEFAULTS,
    lookback: int = 90, grain_safe: bool = False,
) -> DataFrame:
    """Funnel per persona. As written, ride means are weighted by the rider's event
    rows; ``grain_safe`` weights every ride once."""
    casual = since(rides, "started_at", p.days_ago(lookback)).filter(F.col("user_type") == CASUAL)
    riders = (
        ride_totals(casual)
        .join(users.select("user_id", "persona_segment"), "user_id")
        .join(event_totals(events), "user_id", "left")
    )
    weight = F.lit(1) if grain_safe else F.greatest(zero("event_rows"), F.lit(1))
    per_persona = riders.groupBy("persona_segment").agg(
        F.count(F.lit(1)).alias("casual_riders"),
        F.sum(zero("shown")).alias("cta_shown"),
        F.sum(zero("clicked")).alias("cta_clicked"),
        F.sum(zero("completed")).alias("converted"),
        rnd(ratio(minutes(F.sum(F.col("millis") * weight)), F.sum(F.col("timed_rides") * weight)), 1)
        .alias("avg_ride_duration"),
        rnd(ratio(money(F.sum(F.col("cents") * weight)), F.sum(F.col("priced_rides") * weight)), 2)
        .alias("avg_ride_cost"),
    )
    conversion = ratio(F.col("converted"), F.col("casual_riders"))
    return per_persona.select(
        "persona_segment", "casual_riders", "cta_shown", "cta_clicked", "converted",
        "avg_ride_duration", "avg_ride_cost",
        rnd(ratio(F.lit(p.pricing.annual_fee), F.col("avg_ride_cost"))).alias("breakeven_rides"),
        rnd(ratio(F.col("cta_clicked"), F.col("cta_shown")), 3).alias("cta_ctr"),
        rnd(conversion, 4).alias("conversion_rate"),
        F.rank().over(Window.orderBy(conversion.desc_nulls_last())).cast("long").alias("conversion_rank"),
    ).orderBy(F.col("conversion_rate").desc_nulls_last())


def channel_exposure(events: DataFrame, p: Params, window_days: int) -> DataFrame:
    """One row per rider, channel and variant with the window's flags, for riders who
    were ever shown the call to action. One scan serves the all-time first touch and
    the test window."""
    start = p.days_ago(window_days)
    recent = F.col("event_at") >= ts(start)
    done = recent & is_event(SIGNUP_COMPLETED)
    per_cell = events.filter(F.col("user_id").isNotNull()).groupBy("user_id", "source_channel", "nudge_variant").agg(
        F.min(F.when(is_event(CTA_SHOWN), F.col("event_at"))).alias("shown_at"),
        F.max(flag(recent)).alias("exposed"),
        F.max(flag(recent & is_event(CTA_CLICKED))).alias("clicked"),
        F.max(flag(done)).alias("converted"),
        F.sum(flag(done)).alias("completions"),
        F.sum(F.when(done, seconds_between(ts(start), F.col("event_at")))).alias("done_sec"),
    )
    rider = Window.partitionBy("user_id")
    return per_cell.withColumn("first_at", F.min("shown_at").over(rider)).filter(
        F.col("first_at").isNotNull() & (F.col("exposed") == 1)
    ).withColumn(
        "sec_to_convert",
        F.col("done_sec") - F.col("completions") * seconds_between(ts(start), F.col("first_at")),
    )


@until_as_of
def funnel_by_channel_variant(
    events: DataFrame, p: Params = DEFAULTS, window_days: int = 28
) -> DataFrame:
    cells = channel_exposure(events, p, window_days).groupBy("source_channel", "nudge_variant").agg(
        F.count(F.lit(1)).alias("users_exposed"),
        F.sum("clicked").alias("cta_clicks"),
        F.sum("converted").alias("conversions"),
        ratio(F.sum("sec_to_convert").cast("double") / 86400.0, F.sum("completions")).alias("days"),
    )
    conversion = ratio(F.col("conversions"), F.col("users_exposed"))
    return cells.select(
        "source_channel", "nudge_variant", "users_exposed", "cta_clicks", "conversions",
        rnd(ratio(F.col("cta_clicks"), F.col("users_exposed")), 4).alias("ctr"),
        rnd(conversion, 4).alias("conversion_rate"),
        rnd(F.col("days"), 1).alias("avg_days_to_convert"),
        rnd(conversion * (p.monthly_base * p.pricing.annual_fee * 12 / 1000)).alias("projected_annual_arr_k"),
    ).orderBy(F.col("conversion_rate").desc_nulls_last())


def json_step() -> Column:
    """Step label of an event; NULL when the metadata is missing or malformed."""
    return F.get_json_object("event_metadata", "$.step")


def rider_steps(events: DataFrame, p: Params, lookback: int) -> DataFrame:
    """Sign-up flags per rider and variant."""
    def at(*types: str) -> Column:
        return F.min(F.when(is_event(*types), F.col("event_at")))

    def reached(step: str) -> Column:
        return F.max(flag(is_event(STEP_COMPLETED) & (json_step() == step)))

    return since(events, "event_at", p.days_ago(lookback)).groupBy("user_id", "nudge_variant").agg(
        F.max(flag(is_event(SIGNUP_STARTED))).alias("step_1"),
        reached("2").alias("step_2"),
        reached("3").alias("step_3"),
        F.max(flag(is_event(SIGNUP_COMPLETED))).alias("done"),
        F.max(F.when(is_event(SIGNUP_ABANDONED), json_step())).alias("abandoned_at_step"),
        seconds_between(at(SIGNUP_STARTED), at(SIGNUP_COMPLETED)).alias("flow_sec"),
    )


@until_as_of
def signup_step_dropoff(
    events: DataFrame, p: Params = DEFAULTS, lookback: int = 30, grain_safe: bool = False
) -> DataFrame:
    """Losses per sign-up step. ``median_completion_min`` is a mean, as in the source
    definition; ``grain_safe`` adds the true median next to it."""
    steps = rider_steps(events, p, lookback)
    timed = F.col("flow_sec").isNotNull()
    per_label = steps.groupBy("nudge_variant", "abandoned_at_step").agg(
        F.count(F.lit(1)).alias("riders"),
        *[F.sum(c).alias(c) for c in ["step_1", "step_2", "step_3", "done"]],
        F.sum("flow_sec").alias("flow_sec"),
        F.sum(flag(timed)).alias("timed"),
    )
    label = F.col("abandoned_at_step")
    per_variant = per_label.groupBy("nudge_variant").agg(
        *[F.sum(c).alias(c) for c in ["step_1", "step_2", "step_3", "done"]],
        ratio(F.sum("flow_sec").cast("double") / 60.0, F.sum("timed")).alias("mean_min"),
        # most frequent label, the smallest one on ties, labels that are NULL left out
        F.min_by(label, F.when(label.isNotNull(), F.struct(-F.col("riders"), label)))
        .alias("most_common_abandon_step"),
    )

    def drop(before: str, after: str) -> Column:
        return rnd(ratio(F.col(before) - F.col(after), F.col(before)), 3)

    out = per_variant.select(
        "nudge_variant",
        F.col("step_1").alias("entered_flow"),
        F.col("step_2").alias("reached_step_2"),
        F.col("step_3").alias("reached_step_3"),
        F.col("done").alias("completed"),
        drop("step_1", "step_2").alias("drop_step_1"),
        drop("step_2", "step_3").alias("drop_step_2"),
        drop("step_3", "done").alias("drop_step_3"),
        rnd(ratio(F.col("done"), F.col("step_1")), 3).alias("flow_completion_rate"),
        rnd(F.col("mean_min"), 1).alias("median_completion_min"),
        "most_common_abandon_step",
    )
    if grain_safe:
        # frequencies per second inside a fixed window bound what the percentile holds
        seconds = F.col("flow_sec").cast("long")
        median = (
            steps.filter(timed).groupBy("nudge_variant", seconds.alias("sec"))
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy("nudge_variant")
            .agg(rnd(F.percentile("sec", 0.5, F.col("n")) / 60.0, 1).alias("true_median_completion_min"))
        )
        out = _attach(out, median)
    return out.orderBy(F.col("flow_completion_rate").desc_nulls_last(), "nudge_variant")


def _attach(report: DataFrame, extra: DataFrame) -> DataFrame:
    """Left join on the variant, NULL variants included."""
    extra = extra.withColumnRenamed("nudge_variant", "_variant")
    return report.join(
        extra, report["nudge_variant"].eqNullSafe(extra["_variant"]), "left"
    ).drop("_variant")


def conversion_journeys(
    users: DataFrame, events: DataFrame, rides: DataFrame, p: Params, lookback: int,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per recent rider who converted after at least one casual ride."""
    converted = (
        users.filter(F.col("first_ride_at") >= ts(p.days_ago(lookback)))
        .select("user_id", "persona_segment", "first_ride_at")
        .join(first_conversion(events), "user_id")
    )
    # who first rode in the window has no earlier rides
    recent = since(rides, "started_at", p.days_ago(lookback)).filter(F.col("user_type") == CASUAL)
    casual = recent.select("user_id", "ride_id", "started_at", "ride_cost_cad")
    before = join_hot_keys(
        casual, converted, "user_id", ["ride_id", "started_at"], rows_per_task
    ).filter(F.col("started_at") < F.col("converted_at"))
    per_day = before.groupBy(
        "user_id", "persona_segment", "first_ride_at", "converted_at",
        F.to_date("started_at").alias("ride_day"),
    ).agg(F.sum(cents(F.col("ride_cost_cad"))).alias("cents"))
    return per_day.groupBy("user_id", "persona_segment", "first_ride_at", "converted_at").agg(
        F.count(F.lit(1)).alias("ride_days"), F.sum("cents").alias("cents")
    ).withColumn("days", whole_days_between(F.col("first_ride_at"), F.col("converted_at")))


@until_as_of
def time_to_convert(
    users: DataFrame, events: DataFrame, rides: DataFrame, p: Params = DEFAULTS, lookback: int = 180
) -> DataFrame:
    """Days from first ride to first completed sign-up. Percentiles run over day
    frequencies, of which a window of ``lookback`` days has at most that many."""
    per_day_count = conversion_journeys(users, events, rides, p, lookback).groupBy(
        "persona_segment", "days"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("ride_days").alias("ride_days"),
        F.sum("cents").alias("cents"),
        F.count("cents").alias("spenders"),
    )
    per_persona = per_day_count.groupBy("persona_segment").agg(
        F.sum("n").alias("conversions"),
        ratio(F.sum(F.col("days") * F.col("n")), F.sum("n")).alias("mean_days"),
        F.percentile("days", F.array(*[F.lit(q) for q in (0.25, 0.5, 0.75, 0.9)]), F.col("n")).alias("q"),
        ratio(F.sum("ride_days"), F.sum("n")).alias("mean_ride_days"),
        ratio(money(F.sum("cents")), F.sum("spenders")).alias("mean_spend"),
    )
    return per_persona.select(
        "persona_segment", "conversions",
        rnd(F.col("mean_days"), 1).alias("avg_days_to_convert"),
        *[rnd(F.col("q")[i], 6).alias(name)
          for i, name in enumerate(["p25_days", "median_days", "p75_days", "p90_days"])],
        rnd(F.col("mean_ride_days"), 1).alias("avg_ride_days_before_convert"),
        rnd(F.col("mean_spend"), 2).alias("avg_spend_before_convert_cad"),
        rnd(ratio(F.lit(p.pricing.annual_fee), ratio(F.col("mean_spend"), F.col("mean_ride_days"))))
        .alias("est_breakeven_rides"),
    ).orderBy(F.col("median_days").asc_nulls_last(), "persona_segment")
