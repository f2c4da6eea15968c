"""What happens after the conversion: cohorts, churn, savings, guardrails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.functions.columns import (
    day, flag, millis, minutes, month_of, months_between_firsts, ratio, rnd, since, ts,
)
from farewheel.functions.horizon import until_as_of
from farewheel.operators.profiles import is_event, zero
from farewheel.operators.segmentation import days_since, whole
from farewheel.params import (
    APP_UNINSTALL, CLASSIC, CTA_SHOWN, DEFAULTS, EBIKE, MEMBER, Params, SIGNUP_COMPLETED,
)


def monthly_rides(rides: DataFrame) -> DataFrame:
    """Member rides per rider and month."""
    return rides.filter(F.col("user_type") == MEMBER).groupBy(
        "user_id", month_of(F.col("started_at")).alias("activity_month")
    ).agg(F.count(F.lit(1)).alias("rides_in_month"))


def signup_cohorts(events: DataFrame) -> DataFrame:
    return events.filter(is_event(SIGNUP_COMPLETED)).groupBy("user_id").agg(
        month_of(F.min("event_at")).alias("cohort_month")
    )


@until_as_of
def cohort_retention(events: DataFrame, rides: DataFrame, grain_safe: bool = False) -> DataFrame:
    """Active members per cohort and month since sign-up.

    As written the denominator is the cohort's best month, and silent members vanish.
    ``grain_safe`` divides by the sign-ups of the cohort and keeps every cohort's month 0.
    """
    cohorts = signup_cohorts(events)
    since_month = months_between_firsts(F.col("cohort_month"), F.col("activity_month"))
    active = cohorts.join(monthly_rides(rides), "user_id").filter(
        F.col("activity_month") >= F.col("cohort_month")
    ).groupBy("cohort_month", since_month.alias("months_since_conversion")).agg(
        F.count(F.lit(1)).alias("active_members"),
        ratio(F.sum("rides_in_month"), F.count(F.lit(1))).alias("mean_rides"),
    )
    if grain_safe:
        sizes = cohorts.groupBy("cohort_month").agg(F.count(F.lit(1)).alias("cohort_size"))
        starts = sizes.select("cohort_month", F.lit(0).cast("long").alias("months_since_conversion"))
        active = (
            starts.join(active, ["cohort_month", "months_since_conversion"], "full")
            .join(sizes, "cohort_month")
            .withColumn("active_members", zero("active_members"))
        )
    else:
        best = F.max("active_members").over(Window.partitionBy("cohort_month"))
        active = active.withColumn("cohort_size", best)
    return active.select(
        "cohort_month", "months_since_conversion", "active_members", "cohort_size",
        rnd(ratio(F.col("active_members") * 100, F.col("cohort_size")), 1).alias("retention_pct"),
        rnd(F.col("mean_rides"), 1).alias("avg_rides_per_active_member"),
    ).orderBy("cohort_month", "months_since_conversion")


@until_as_of
def retention_by_persona(
    events: DataFrame, users: DataFrame, rides: DataFrame, p: Params = DEFAULTS, horizon: int = 6
) -> DataFrame:
    """Retention per persona over the sign-ups of the last twelve months. A rider with
    sign-ups through several channels belongs to one cohort per channel."""
    cohort_start = day(p.as_of) - F.expr("INTERVAL '12' MONTH")
    cohorts = (
        events.filter(is_event(SIGNUP_COMPLETED) & (F.col("event_at") >= cohort_start.cast("timestamp_ntz")))
        .groupBy("user_id", "source_channel")
        .agg(month_of(F.min("event_at")).alias("cohort_month"))
        .join(users.select("user_id", "persona_segment"), "user_id")
    )
    months = months_between_firsts(F.col("cohort_month"), F.col("activity_month"))
    reached = cohorts.join(monthly_rides(rides), "user_id").withColumn(
        "months_since_conversion", months
    ).filter(F.col("months_since_conversion").between(0, horizon))
    per_rider = reached.groupBy("persona_segment", "months_since_conversion", "user_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("rides_in_month").alias("rides")
    )
    cells = per_rider.groupBy("persona_segment", "months_since_conversion").agg(
        F.count(F.lit(1)).alias("active_members"),
        rnd(ratio(F.sum("rides"), F.sum("rows")), 1).alias("avg_rides"),
    )
    best = F.max("active_members").over(Window.partitionBy("persona_segment"))
    return cells.withColumn(
        "retention_pct", rnd(ratio(F.col("active_members") * 100, best), 1)
    ).orderBy("persona_segment", "months_since_conversion")


# Risk classes and actions, most urgent first.
RISK_DORMANT = "High — dormant + renewal imminent"
RISK_DECLINING = "Medium — declining engagement near renewal"
RISK_INACTIVE = "Medium — extended inactivity"
RISK_RENEWAL = "Low — renewal soon, monitor"
RISK_NONE = "Active — no risk signal"
ACTION_WIN_BACK = "Win-back: personalised re-engagement email with nearest station"
ACTION_RE_ENGAGE = "Re-engage: highlight member perks + upcoming local events"
ACTION_REMIND = "Renewal reminder: show YTD savings vs casual rate"


@until_as_of
def churn_early_warning(
    rides: DataFrame, users: DataFrame, events: DataFrame, p: Params = DEFAULTS
) -> DataFrame:
    """Members close to renewal whose riding fell off. The two 30-day windows leave out
    the day 31 days back after midnight, as in the source definition."""
    started = F.col("started_at")
    prior = started.between(ts(p.days_ago(60)), ts(p.days_ago(31)))
    trend = since(rides, "started_at", p.days_ago(60)).filter(F.col("user_type") == MEMBER).groupBy(
        "user_id"
    ).agg(
        F.sum(flag(prior)).alias("rides_prior_30d"),
        F.sum(flag(started >= ts(p.days_ago(30)))).alias("rides_recent_30d"),
        days_since(F.max("started_at"), p).alias("days_since_last_ride"),
    )
    renewal = events.filter(is_event(SIGNUP_COMPLETED)).groupBy("user_id").agg(
        (F.max("event_at") + F.expr("INTERVAL '1' YEAR")).alias("renewal_date")
    ).withColumn("days_to_renewal", F.datediff(F.to_date("renewal_date"), day(p.as_of)).cast("long"))

    idle, left = F.col("days_since_last_ride"), F.col("days_to_renewal")
    declining = F.col("rides_recent_30d") < F.col("rides_prior_30d") * 0.5
    risk = (
        F.when((idle >= 21) & (left <= 60), RISK_DORMANT)
        .when(declining & (left <= 90), RISK_DECLINING)
        .when(idle >= 14, RISK_INACTIVE)
        .when(left <= 30, RISK_RENEWAL)
        .otherwise(RISK_NONE)
    )
    action = (
        F.when(idle >= 21, ACTION_WIN_BACK)
        .when(declining, ACTION_RE_ENGAGE)
        .when(left <= 30, ACTION_REMIND)
    )
    urgency = (
        F.when(F.col("churn_risk") == RISK_DORMANT, 1)
        .when(F.col("churn_risk") == RISK_DECLINING, 2)
        .when(F.col("churn_risk") == RISK_INACTIVE, 3)
        .otherwise(4)
    )
    change = ratio(F.col("rides_recent_30d") - F.col("rides_prior_30d"), F.col("rides_prior_30d")) * 100
    return (
        trend.filter((idle >= 14) | declining)
        .join(renewal.filter(left.between(0, 90)), "user_id")
        .join(users.select("user_id", "persona_segment"), "user_id")
        .select(
            "user_id", "persona_segment", "renewal_date", "days_to_renewal",
            "rides_prior_30d", "rides_recent_30d", "days_since_last_ride",
            rnd(change).alias("ride_frequency_change_pct"),
            risk.alias("churn_risk"),
            action.alias("recommended_action"),
        )
        .orderBy(urgency, "days_to_renewal", "user_id")
    )


# Renewal message texts.
SAVED_TEXT = ("High value: saved C$", " — strong renewal message")
PAID_OFF_TEXT = "Positive ROI: membership has paid off — remind at renewal"
LOW_USE_TEXT = "Low usage — at-risk rider, send re-engagement first"


@until_as_of
def member_ytd_savings(
    rides: DataFrame, users: DataFrame, events: DataFrame, p: Params = DEFAULTS, grain_safe: bool = False
) -> DataFrame:
    """Member cost against casual cost this year. As written every completed sign-up of
    the rider repeats the rides; ``grain_safe`` counts them once."""
    price = p.pricing
    per_bike = since(rides, "started_at", p.year_start).filter(F.col("user_type") == MEMBER)
    length = millis(F.col("duration_min"))
    ebike, classic = F.col("bike_type") == EBIKE, F.col("bike_type") == CLASSIC
    totals = per_bike.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("rides"),
        F.sum(length).alias("millis"),
        F.sum(F.when(ebike, length).otherwise(0)).alias("ebike_millis"),
        F.sum(F.when(classic, length).otherwise(0)).alias("classic_millis"),
        # a ride without duration has no price, not even the unlock fee
        F.sum(flag((ebike | classic) & F.col("duration_min").isNotNull())).alias("priced"),
    )
    signups = events.filter(is_event(SIGNUP_COMPLETED)).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("signups")
    )
    weight = F.lit(1) if grain_safe else F.col("signups")
    fee = price.annual_fee
    sums = (
        totals.join(signups, "user_id")
        .join(users.select("user_id", "persona_segment"), "user_id")
        .select(
            "user_id", "persona_segment",
            (F.col("rides") * weight).alias("ytd_rides"),
            minutes(F.col("millis") * weight).alias("min"),
            (minutes(F.col("ebike_millis") * weight) * price.member_ebike_per_min).alias("charges"),
            (
                F.col("priced") * weight * price.unlock
                + minutes(F.col("classic_millis") * weight) * price.classic_per_min
                + minutes(F.col("ebike_millis") * weight) * price.ebike_per_min
            ).alias("casual_cost"),
        )
        .withColumn("member_cost", F.col("charges") + fee)
        .withColumn("net", F.col("casual_cost") - F.col("member_cost"))
    )
    message = (
        F.when(F.col("net") >= 50, F.concat(F.lit(SAVED_TEXT[0]), whole(F.col("net")), F.lit(SAVED_TEXT[1])))
        .when(F.col("net") >= 0, PAID_OFF_TEXT)
        .otherwise(LOW_USE_TEXT)
    )
    return sums.select(
        "user_id", "persona_segment", "ytd_rides",
        rnd(F.col("min") / 60.0, 1).alias("ytd_hours_ridden"),
        rnd(F.col("charges"), 2).alias("actual_ebike_charges_cad"),
        F.lit(fee).alias("annual_membership_fee"),
        rnd(F.col("member_cost"), 2).alias("total_member_cost_cad"),
        rnd(F.col("casual_cost"), 2).alias("equivalent_casual_cost_cad"),
        rnd(F.col("net"), 2).alias("net_savings_cad"),
        rnd(ratio(F.col("casual_cost"), F.col("member_cost")), 2).alias("savings_multiple"),
        message.alias("renewal_message_tier"),
    ).orderBy(F.col("net_savings_cad").desc_nulls_last(), "user_id")


# Guardrail verdicts.
BREACH_RIDES = "BREACH — ride frequency down >10% — pause nudge"
BREACH_UNINSTALL = "BREACH — uninstall rate >5% — pause nudge"
WITHIN = "OK — within guardrail thresholds"


def nudge_days(
    events: DataFrame, rides: DataFrame, app_events: DataFrame, p: Params, window_days: int, grain_safe: bool
) -> DataFrame:
    """One row per rider, variant and nudge day with rides before and after.

    Rides are counted per rider and day first; range windows over those day rows then
    give the two 14-day counts, so no ride is ever paired with a nudge. Both windows
    end at midnight of their last day: of that day only rides at exactly 0:00 count.
    """
    start = p.days_ago(window_days)
    nudges = since(events, "event_at", start).filter(is_event(CTA_SHOWN)).groupBy(
        "user_id", "nudge_variant", F.to_date("event_at").alias("on_day")
    ).agg(F.count(F.lit(1)).alias("times"))
    midnight = F.col("started_at") == F.to_date("started_at").cast("timestamp_ntz")
    ride_days = since(rides, "started_at", p.days_ago(window_days + 14)).groupBy(
        "user_id", F.to_date("started_at").alias("on_day")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(flag(midnight)).alias("at_midnight"))

    timeline = nudges.withColumns({"n": F.lit(0), "at_midnight": F.lit(0)}).unionByName(
        ride_days.withColumns({"nudge_variant": F.lit(None).cast("string"), "times": F.lit(0)})
    ).withColumn("d", F.datediff("on_day", day("1970-01-01")))

    def within(column: str, first: int, last: int) -> Column:
        frame = Window.partitionBy("user_id").orderBy("d").rangeBetween(first, last)
        return F.coalesce(F.sum(column).over(frame), F.lit(0))

    if grain_safe:
        pre, post = within("n", -14, -1), within("n", 0, 13)
    else:
        pre = within("n", -14, -2) + within("at_midnight", -1, -1)
        post = within("n", 0, 12) + within("at_midnight", 13, 13)
    if grain_safe:
        # only uninstalls since the window began can matter; as written, every app event counts
        app_events = since(app_events, "event_at", start).filter(is_event(APP_UNINSTALL))
    app = app_events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("app_rows"),
        F.max(F.when(is_event(APP_UNINSTALL), F.col("event_at"))).alias("uninstalled_at"),
    )
    return (
        timeline.withColumns({"pre": pre, "post": post})
        .filter(F.col("times") > 0)
        .join(app, "user_id", "left")
        .select(
            "user_id", "nudge_variant", "times", "pre", "post",
            F.greatest(zero("app_rows"), F.lit(1)).alias("app_rows"),
            F.coalesce(flag(F.col("uninstalled_at") >= F.col("on_day").cast("timestamp_ntz")), F.lit(0)).alias("uninstalled"),
        )
    )


@until_as_of
def nudge_guardrails(
    events: DataFrame, rides: DataFrame, app_events: DataFrame, p: Params = DEFAULTS, window_days: int = 28
) -> DataFrame:
    """Ride frequency and uninstalls around the nudge, with the as-written join
    multiplicities: impressions of the day times app event rows of the rider."""
    per_rider = nudge_days(events, rides, app_events, p, window_days, grain_safe=False).groupBy(
        "nudge_variant", "user_id"
    ).agg(
        F.count(F.lit(1)).alias("days"),
        F.sum(F.col("pre") * F.col("times") * F.col("app_rows")).alias("pre"),
        F.sum(F.col("post") * F.col("times") * F.col("app_rows")).alias("post"),
        F.sum("uninstalled").alias("uninstalled"),
    )
    sums = per_rider.groupBy("nudge_variant").agg(
        F.count(F.lit(1)).alias("users"),
        ratio(F.sum("pre"), F.sum("days")).alias("pre"),
        ratio(F.sum("post"), F.sum("days")).alias("post"),
        ratio(F.sum("uninstalled") * 100, F.count(F.lit(1))).alias("uninstall_pct"),
    )
    change = ratio(F.col("post") - F.col("pre"), F.col("pre"))
    return sums.select(
        "nudge_variant", "users",
        rnd(F.col("pre"), 2).alias("avg_rides_pre_nudge"),
        rnd(F.col("post"), 2).alias("avg_rides_post_nudge"),
        rnd(change * 100, 1).alias("ride_freq_change_pct"),
        rnd(F.col("uninstall_pct"), 2).alias("uninstall_rate_pct"),
        F.when(change < -0.10, BREACH_RIDES)
        .when(F.col("uninstall_pct") > 5.0, BREACH_UNINSTALL)
        .otherwise(WITHIN).alias("guardrail_status"),
    ).orderBy("nudge_variant")


@until_as_of
def nudge_guardrails_grain_safe(
    events: DataFrame, rides: DataFrame, app_events: DataFrame, p: Params = DEFAULTS,
    window_days: int = 28, control: str = "control",
) -> DataFrame:
    """The same guardrails as the documents define them: every ride counts once, windows
    cover whole days, a rider uninstalls once, and the uninstall test is relative to
    the control variant."""
    per_rider = nudge_days(events, rides, app_events, p, window_days, grain_safe=True).groupBy(
        "nudge_variant", "user_id"
    ).agg(
        F.count(F.lit(1)).alias("days"), F.sum("pre").alias("pre"), F.sum("post").alias("post"),
        F.max("uninstalled").alias("uninstalled"),
    )
    sums = per_rider.groupBy("nudge_variant").agg(
        F.count(F.lit(1)).alias("users"),
        ratio(F.sum("pre"), F.sum("days")).alias("pre"),
        ratio(F.sum("post"), F.sum("days")).alias("post"),
        ratio(F.sum("uninstalled") * 100, F.count(F.lit(1))).alias("uninstall_pct"),
    )
    everyone = Window.partitionBy()
    base = F.max(F.when(F.col("nudge_variant") == control, F.col("uninstall_pct"))).over(everyone)
    change = ratio(F.col("post") - F.col("pre"), F.col("pre"))
    relative = ratio(F.col("uninstall_pct") - F.col("base"), F.col("base"))
    return sums.withColumn("base", base).select(
        "nudge_variant", "users",
        rnd(F.col("pre"), 2).alias("avg_rides_pre_nudge"),
        rnd(F.col("post"), 2).alias("avg_rides_post_nudge"),
        rnd(change * 100, 1).alias("ride_freq_change_pct"),
        rnd(F.col("uninstall_pct"), 2).alias("uninstall_rate_pct"),
        rnd(relative * 100, 1).alias("uninstall_vs_control_pct"),
        F.when(change < -0.10, BREACH_RIDES)
        .when(relative > 0.05, BREACH_UNINSTALL)
        .otherwise(WITHIN).alias("guardrail_status"),
    ).orderBy("nudge_variant")
