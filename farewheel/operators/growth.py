"""Growth metrics: north star, exposure, click-through, activity, renewals, tiers."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.functions.columns import (
    day, flag, month_of, ratio, rnd, since, ts,
)
from farewheel.functions.horizon import until_as_of
from farewheel.functions.skew import ROWS_PER_TASK, join_hot_keys
from farewheel.operators.funnel import json_step
from farewheel.operators.profiles import first_conversion, is_event, zero
from farewheel.params import (
    CASUAL, CTA_CLICKED, CTA_SHOWN, DEFAULTS, Params, SEASONAL_VISITOR, SIGNUP_COMPLETED,
    SIGNUP_STARTED, STEP_COMPLETED,
)
from farewheel.operators.retention import nudge_days


@until_as_of
def north_star_90d(
    rides: DataFrame, users: DataFrame, events: DataFrame, p: Params = DEFAULTS, days: int = 90
) -> DataFrame:
    """Casual riders who convert within ``days`` of their first ride, per month of the
    first ride and overall (NULL month). Riders whose time is not over yet are left out."""
    casual = rides.filter(F.col("user_type") == CASUAL).select("user_id").distinct()
    first = F.col("first_ride_at")
    riders = (
        users.filter(first <= ts(p.days_ago(days))).select("user_id", "first_ride_at")
        .join(casual, "user_id", "left_semi")
        .join(first_conversion(events), "user_id", "left")
    )
    in_time = F.col("converted_at").between(first, first + F.expr(f"INTERVAL '{days}' DAY"))
    return riders.rollup(month_of(first).alias("first_ride_month")).agg(
        F.count(F.lit(1)).alias("riders"), F.sum(flag(in_time)).alias("converted")
    ).select(
        "first_ride_month", "riders", "converted",
        rnd(ratio(F.col("converted"), F.col("riders")), 4).alias("conversion_rate"),
    ).orderBy(F.col("first_ride_month").asc_nulls_first())


@until_as_of
def cta_exposure_monthly(rides: DataFrame, events: DataFrame) -> DataFrame:
    """Share of a month's casual riders who saw the call to action in that month."""
    casual = rides.filter((F.col("user_type") == CASUAL) & F.col("user_id").isNotNull()).select(
        "user_id", month_of(F.col("started_at")).alias("month")
    ).distinct()
    shown = events.filter(is_event(CTA_SHOWN)).select(
        "user_id", month_of(F.col("event_at")).alias("month")
    ).distinct().withColumn("seen", F.lit(1))
    return casual.join(shown, ["user_id", "month"], "left").groupBy("month").agg(
        F.count(F.lit(1)).alias("casual_riders"), F.sum(zero("seen")).alias("exposed_riders")
    ).select(
        "month", "casual_riders", "exposed_riders",
        rnd(ratio(F.col("exposed_riders"), F.col("casual_riders")), 4).alias("exposure_rate"),
    ).orderBy("month")


@until_as_of
def ctr_by_surface(events: DataFrame) -> DataFrame:
    """Clicks per impression and clicking riders per reached rider, by channel."""
    shown, clicked = is_event(CTA_SHOWN), is_event(CTA_CLICKED)
    per_rider = events.groupBy("source_channel", "user_id").agg(
        F.sum(flag(shown)).alias("impressions"), F.sum(flag(clicked)).alias("clicks")
    )
    sums = per_rider.groupBy("source_channel").agg(
        F.sum("impressions").alias("impressions"),
        F.sum("clicks").alias("clicks"),
        # events without a rider count, but are nobody
        F.sum(flag((F.col("impressions") > 0) & F.col("user_id").isNotNull())).alias("users_shown"),
        F.sum(flag((F.col("clicks") > 0) & F.col("user_id").isNotNull())).alias("users_clicked"),
    )
    return sums.select(
        "*",
        rnd(ratio(F.col("clicks"), F.col("impressions")), 4).alias("ctr"),
        rnd(ratio(F.col("users_clicked"), F.col("users_shown")), 4).alias("user_ctr"),
    ).orderBy("source_channel")


@until_as_of
def step_completion(events: DataFrame, p: Params = DEFAULTS, lookback: int = 30) -> DataFrame:
    """Riders who enter and finish each sign-up step. Starting is entering step 1, a
    completed step event names the step that was reached, completion ends step 4."""
    reached = (
        F.when(is_event(SIGNUP_STARTED), 1)
        .when(is_event(STEP_COMPLETED) & json_step().isin("2", "3", "4"), json_step().try_cast("int"))
        .when(is_event(SIGNUP_COMPLETED), 5)
    )
    per_step = (
        since(events, "event_at", p.days_ago(lookback))
        .select("user_id", reached.alias("step")).filter(F.col("step").isNotNull() & F.col("user_id").isNotNull())
        .distinct().groupBy("step").agg(F.count(F.lit(1)).alias("riders"))
    )
    wide = per_step.agg(*[
        F.coalesce(F.sum(F.when(F.col("step") == s, F.col("riders"))), F.lit(0)).alias(f"s{s}") for s in range(1, 6)
    ])
    stages = [("1", "s1", "s2"), ("2", "s2", "s3"), ("3", "s3", "s4"), ("4", "s4", "s5"), ("overall", "s1", "s5")]
    return wide.select(F.explode(F.array(*[
        F.struct(F.lit(n).alias("step"), F.col(a).alias("users_in"), F.col(b).alias("users_out"))
        for n, a, b in stages
    ])).alias("r")).select(
        "r.*", rnd(ratio(F.col("r.users_out"), F.col("r.users_in")), 4).alias("completion_rate")
    ).orderBy("step")


@until_as_of
def conversion_by_persona(
    rides: DataFrame, users: DataFrame, events: DataFrame, p: Params = DEFAULTS, lookback: int = 90
) -> DataFrame:
    """Conversion per persona and per channel, without the seasonal visitors."""
    start = p.days_ago(lookback)
    kept = users.filter(F.col("persona_segment") != SEASONAL_VISITOR).select("user_id", "persona_segment")
    casual = since(rides, "started_at", start).filter(F.col("user_type") == CASUAL).select("user_id").distinct()
    recent = since(events, "event_at", start).groupBy("user_id", "source_channel").agg(
        F.max(flag(is_event(SIGNUP_COMPLETED))).alias("converted")
    )
    riders = kept.join(casual, "user_id", "left_semi").join(recent, "user_id", "left")
    # one row per rider and channel counts for its persona and for its channel
    views = riders.select("user_id", "source_channel", zero("converted").alias("converted"), F.explode(F.array(
        F.struct(F.lit("persona").alias("dimension"), F.col("persona_segment").alias("segment")),
        F.struct(F.lit("channel").alias("dimension"), F.col("source_channel").alias("segment")),
    )).alias("v")).filter((F.col("v.dimension") == "persona") | F.col("source_channel").isNotNull())
    return views.groupBy("v.dimension", "v.segment", "user_id").agg(
        F.max("converted").alias("converted")
    ).groupBy("dimension", "segment").agg(
        F.count(F.lit(1)).alias("riders"), F.sum("converted").alias("converted")
    ).select(
        "*", rnd(ratio(F.col("converted"), F.col("riders")), 4).alias("conversion_rate")
    ).orderBy("dimension", "segment")


@until_as_of
def active_members(
    rides: DataFrame, users: DataFrame, events: DataFrame, p: Params = DEFAULTS, lookback: int = 30
) -> DataFrame:
    """Members with a ride in the window, apart from all members, per persona."""
    members = events.filter(is_event(SIGNUP_COMPLETED)).select("user_id").distinct()
    riding = since(rides, "started_at", p.days_ago(lookback)).select("user_id").distinct().withColumn(
        "active", F.lit(1)
    )
    return (
        users.select("user_id", "persona_segment")
        .join(members, "user_id", "left_semi").join(riding, "user_id", "left")
        .groupBy("persona_segment")
        .agg(F.count(F.lit(1)).alias("total_members"), F.sum(zero("active")).alias("active_members"))
        .select("*", rnd(ratio(F.col("active_members"), F.col("total_members")), 4).alias("active_share"))
        .orderBy(F.col("persona_segment").asc_nulls_last())
    )


def renewals(events: DataFrame, p: Params, first_day: int, last_day: int) -> DataFrame:
    """One row per member whose renewal window has passed. Sign-ups are reduced to days
    per rider, so the look-ahead touches at most one row per day."""
    per_day = events.filter(is_event(SIGNUP_COMPLETED)).groupBy(
        "user_id", F.to_date("event_at").alias("on_day")
    ).agg(F.lit(1).alias("x"))
    first = F.min("on_day").over(Window.partitionBy("user_id"))
    again = F.datediff("on_day", "first_day").between(first_day, last_day)
    return (
        per_day.withColumn("first_day", first)
        .groupBy("user_id", "first_day").agg(F.max(flag(again)).alias("renewed"))
        .filter(F.datediff(day(p.as_of), F.col("first_day")) >= last_day)
    )


@until_as_of
def renewal_rate(
    events: DataFrame, p: Params = DEFAULTS, first_day: int = 330, last_day: int = 400
) -> DataFrame:
    """Members who complete sign-up again about a year after the first time."""
    return renewals(events, p, first_day, last_day).groupBy(
        F.trunc("first_day", "month").alias("cohort_month")
    ).agg(
        F.count(F.lit(1)).alias("members"), F.sum("renewed").alias("renewed")
    ).select(
        "*", rnd(ratio(F.col("renewed"), F.col("members")), 4).alias("renewal_rate")
    ).orderBy("cohort_month")


@until_as_of
def post_conversion_rides_90d(
    rides: DataFrame, users: DataFrame, events: DataFrame, p: Params = DEFAULTS,
    days: int = 90, target: int = 12, rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Rides in the first ``days`` after conversion and the share of members who reach
    ``target``, over members whose window is complete."""
    members = first_conversion(events).filter(F.col("converted_at") <= ts(p.days_ago(days)))
    start, end = F.col("converted_at"), F.col("converted_at") + F.expr(f"INTERVAL '{days}' DAY")
    taken = join_hot_keys(
        rides.select("user_id", "ride_id", "started_at"), members, "user_id", ["ride_id", "started_at"], rows_per_task
    ).filter((F.col("started_at") >= start) & (F.col("started_at") < end)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rides")
    )
    return (
        members.select("user_id").join(taken, "user_id", "left")
        .join(users.select("user_id", "persona_segment"), "user_id")
        .groupBy("persona_segment")
        .agg(
            F.count(F.lit(1)).alias("members"),
            F.sum(zero("rides")).alias("rides"),
            F.sum(flag(zero("rides") >= target)).alias("members_at_target"),
        )
        .select(
            "persona_segment", "members",
            rnd(ratio(F.col("rides"), F.col("members")), 2).alias("avg_rides_90d"),
            "members_at_target",
            rnd(ratio(F.col("members_at_target"), F.col("members")), 4).alias("share_at_target"),
        )
        .orderBy(F.col("persona_segment").asc_nulls_last())
    )


@until_as_of
def guardrail_thresholds(
    events: DataFrame, rides: DataFrame, app_events: DataFrame, p: Params = DEFAULTS,
    window_days: int = 28, treatment: str = "treatment", control: str = "control",
) -> DataFrame:
    """Guardrails with a source table, one row each: uninstalls relative to control,
    casual volume against the month before, members lost after a year."""
    variant = nudge_days(events, rides, app_events, p, window_days, grain_safe=True).groupBy(
        "nudge_variant", "user_id"
    ).agg(F.max("uninstalled").alias("u")).groupBy("nudge_variant").agg(
        ratio(F.sum("u"), F.count(F.lit(1))).alias("rate")
    )

    def rate(name: str) -> Column:
        return F.max(F.when(F.col("nudge_variant") == name, F.col("rate")))

    uninstall = variant.agg(rate(treatment).alias("t"), rate(control).alias("c")).select(
        F.lit("uninstall_rate_vs_control").alias("metric"),
        ratio(F.col("t") - F.col("c"), F.col("c")).alias("value"),
        F.lit(0.05).alias("threshold"), F.lit(1).alias("sign"),
    )
    last_month = (p.month_start - timedelta(days=1)).replace(day=1)
    monthly = since(rides, "started_at", last_month).filter(F.col("user_type") == CASUAL).groupBy(
        month_of(F.col("started_at")).alias("month")
    ).agg(F.count(F.lit(1)).alias("n"))
    before = F.lag("n").over(Window.orderBy("month"))
    volume = monthly.withColumn("before", before).filter(F.col("month") == day(p.month_start)).select(
        F.lit("casual_volume_vs_previous_month").alias("metric"),
        ratio(F.col("n") - F.col("before"), F.col("before")).alias("value"),
        F.lit(-0.10).alias("threshold"), F.lit(-1).alias("sign"),
    )
    churn = renewals(events, p, 330, 400).agg(
        (1.0 - ratio(F.sum("renewed"), F.count(F.lit(1)))).alias("value")
    ).select(
        F.lit("member_year_1_churn").alias("metric"), "value",
        F.lit(0.35).alias("threshold"), F.lit(1).alias("sign"),
    )
    breached = F.col("value") * F.col("sign") > F.col("threshold") * F.col("sign")
    return uninstall.unionByName(volume).unionByName(churn).select(
        "metric", rnd(F.col("value"), 4).alias("value"), "threshold",
        F.when(F.col("value").isNull(), "NO DATA").when(breached, "BREACH").otherwise("OK").alias("status"),
    ).orderBy("metric")


@until_as_of
def tier_cannibalisation(events: DataFrame, p: Params = DEFAULTS, lookback: int = 365) -> DataFrame:
    """Mix of annual and weekend memberships per test arm."""
    done = is_event(SIGNUP_COMPLETED)
    known = since(events, "event_at", p.days_ago(lookback)).filter(F.col("user_id").isNotNull())
    per_rider = known.groupBy("nudge_variant", "user_id").agg(
        F.max(flag(done)).alias("converted"),
        F.sum(flag(done & (F.col("membership_tier") == "annual"))).alias("annual"),
        F.sum(flag(done & (F.col("membership_tier") == "weekend"))).alias("weekend"),
    )
    sums = per_rider.groupBy("nudge_variant").agg(
        F.count(F.lit(1)).alias("users"), F.sum("converted").alias("converted"),
        F.sum("annual").alias("annual_signups"), F.sum("weekend").alias("weekend_signups"),
    )
    return sums.select(
        "*",
        rnd(ratio(F.col("converted"), F.col("users")), 4).alias("conversion_rate"),
        rnd(ratio(F.col("weekend_signups"), F.col("annual_signups") + F.col("weekend_signups")), 4)
        .alias("weekend_share"),
    ).orderBy("nudge_variant")
