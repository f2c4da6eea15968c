"""Who gets a nudge, what it says, and what a membership would save or grant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from farewheel.functions.columns import (
    cents, day, flag, is_weekend, money, month_of, ratio, rnd, since, ts,
)
from farewheel.functions.horizon import until_as_of
from farewheel.operators.profiles import is_event, zero
from farewheel.operators.segmentation import whole
from farewheel.params import CASUAL, CTA_SHOWN, DEFAULTS, MEMBER, Params, SIGNUP_COMPLETED

# The event log names no dismissal event; the event plan does.
DISMISSED = "cta_dismissed"


def contact_history(events: DataFrame, dismissed: str) -> DataFrame:
    away = is_event(dismissed)
    return events.groupBy("user_id").agg(
        F.sum(flag(is_event(CTA_SHOWN))).alias("impressions"),
        F.sum(flag(away)).alias("dismissals"),
        F.max(F.when(away, F.col("event_at"))).alias("last_dismissed_at"),
        F.max(flag(is_event(SIGNUP_COMPLETED))).alias("is_member"),
    )


def recent_spend(rides: DataFrame, p: Params, lookback: int) -> DataFrame:
    return since(rides, "started_at", p.days_ago(lookback)).filter(F.col("user_type") == CASUAL).groupBy(
        "user_id"
    ).agg(
        F.count(F.lit(1)).alias("rides_30d"),
        F.coalesce(F.sum(cents(F.col("ride_cost_cad"))), F.lit(0)).alias("cents"),
    )


@until_as_of
def nudge_eligibility(
    rides: DataFrame, events: DataFrame, p: Params = DEFAULTS, lookback: int = 30,
    dismissed: str = DISMISSED, min_rides: int = 2, impression_cap: int = 3,
    snooze_days: int = 7, dismissal_cap: int = 3,
) -> DataFrame:
    """Every recent casual rider with the first rule that suppresses the nudge, or none."""
    snoozed_until = F.col("last_dismissed_at") + F.expr(f"INTERVAL '{snooze_days}' DAY")
    reason = (
        F.when(zero("is_member") == 1, "member")
        .when(zero("dismissals") >= dismissal_cap, "dismissed")
        .when(zero("impressions") >= impression_cap, "impression_cap")
        .when(snoozed_until > ts(p.as_of), "snoozed")
        .when(F.col("rides_30d") < min_rides, "too_few_rides")
    )
    return recent_spend(rides, p, lookback).join(
        contact_history(events, dismissed), "user_id", "left"
    ).select(
        "user_id", "rides_30d", money(F.col("cents")).alias("spend_30d"),
        zero("impressions").alias("impressions"), zero("dismissals").alias("dismissals"),
        reason.isNull().alias("eligible"), reason.alias("suppressed_by"),
    )


# Where a nudge goes.
IN_APP, RECEIPT = "in_app", "email_receipt"


@until_as_of
def nudge_channels(
    rides: DataFrame, events: DataFrame, p: Params = DEFAULTS, lookback: int = 30, dismissed: str = DISMISSED, test_salt: str = ""
) -> DataFrame:
    """Recent casual riders with the channel that may address them and their arm of the test.

    Eligible riders are nudged in the app. Who has dismissed the nudge for good gets the other
    call to action in the receipt of a ride, unless they are members. Riders keep the arm they
    were first seen in; new ones are dealt by a hash of ``test_salt`` and their id.
    """
    arm = events.filter(F.col("nudge_variant").isNotNull()).groupBy("user_id").agg(
        F.min(F.struct("event_at", "nudge_variant"))["nudge_variant"].alias("known"))
    dealt = F.conv(F.substring(F.md5(F.concat(F.lit(test_salt), F.col("user_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % 2
    channel = F.when(F.col("eligible"), IN_APP).when(F.col("suppressed_by") == "dismissed", RECEIPT)
    return nudge_eligibility(rides, events, p, lookback, dismissed).join(arm, "user_id", "left").select(
        "user_id", "rides_30d", "spend_30d", "dismissals", channel.alias("channel"),
        F.coalesce("known", F.when(dealt == 0, "control").otherwise("treatment")).alias("ab_variant"))


# Message texts of the nudge.
SPENT_MORE_TEXT = "You've already spent more than a membership costs this year"
REMAINING_TEXT = ("Annual membership: $", "/month. You're ", " rides from breaking even.")
SAVING_TEXT = ("At this pace a membership saves you $", " a year")
NO_SAVING_TEXT = ("At this pace single rides cost $", " a year")


@until_as_of
def nudge_message(
    rides: DataFrame, events: DataFrame, p: Params = DEFAULTS, lookback: int = 30
) -> DataFrame:
    """Break-even text per casual rider who is not a member yet. After a single ride the
    text projects the savings of a year; a rider who spent nothing has no break-even."""
    members = events.filter(is_event(SIGNUP_COMPLETED)).select("user_id").distinct()
    fee = p.pricing.annual_fee
    spend, n = money(F.col("cents")), F.col("rides_30d")
    remaining = F.ceil(ratio(F.lit(fee) - spend, ratio(spend, n)))
    per_year = spend * 365.0 / float(lookback)
    text = (
        F.when(spend > fee, SPENT_MORE_TEXT)
        .when((n == 1) & (per_year > fee), F.concat(F.lit(SAVING_TEXT[0]), whole(per_year - fee), F.lit(SAVING_TEXT[1])))
        .when(n == 1, F.concat(F.lit(NO_SAVING_TEXT[0]), whole(per_year), F.lit(NO_SAVING_TEXT[1])))
        .when(spend == 0, F.concat(F.lit(NO_SAVING_TEXT[0]), whole(per_year), F.lit(NO_SAVING_TEXT[1])))
        .otherwise(F.concat(
            F.lit(f"{REMAINING_TEXT[0]}{fee / 12:.2f}{REMAINING_TEXT[1]}"), remaining.cast("string"), F.lit(REMAINING_TEXT[2])))
    )
    return recent_spend(rides, p, lookback).join(members, "user_id", "left_anti").select(
        "user_id", "rides_30d", spend.alias("spend_30d"),
        rnd(F.lit(fee / 12), 2).alias("membership_per_month"),
        F.when(remaining.isNotNull(), F.greatest(remaining, F.lit(0))).alias("rides_to_breakeven"),
        text.alias("message"),
    )


@until_as_of
def breakeven_calculator(
    rides: DataFrame, p: Params = DEFAULTS, lookback: int = 30, most_per_week: int = 7
) -> DataFrame:
    """Payback and savings for 1..7 rides a week at the rider's own mean cost; the row
    closest to the rider's present frequency is marked."""
    fee = p.pricing.annual_fee
    cost = ratio(money(F.col("cents")), F.col("rides_30d"))
    riders = recent_spend(rides, p, lookback).select(
        "user_id", cost.alias("cost"),
        F.least(F.greatest(rnd(F.col("rides_30d") * 7 / float(lookback)), F.lit(1.0)), F.lit(float(most_per_week)))
        .cast("long").alias("usual"),
    )
    per_week = F.col("rides_per_week")
    yearly = F.col("cost") * per_week * 52
    return riders.select(
        "*", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(most_per_week).cast("long"))).alias("rides_per_week")
    ).select(
        "user_id", "rides_per_week",
        (per_week == F.col("usual")).alias("prefilled"),
        rnd(F.col("cost"), 2).alias("avg_ride_cost"),
        F.ceil(ratio(F.lit(fee), F.col("cost") * per_week)).alias("payback_weeks"),
        rnd((yearly - fee) / 12.0, 2).alias("monthly_savings"),
        rnd(yearly - fee, 2).alias("annual_savings"),
    )


@until_as_of
def weekday_credit_balance(
    rides: DataFrame, events: DataFrame, p: Params = DEFAULTS, monthly_credits: int = 10
) -> DataFrame:
    """Weekday credits of weekend members by month. Weekend rides are free; unused
    credits of a month can be spent in the next one and then lapse.

    The balance depends on the month before, so a rider's months (a few dozen at most)
    are folded in order inside one row; months without rides are filled in.
    """
    members = events.filter(
        is_event(SIGNUP_COMPLETED) & (F.col("membership_tier") == "weekend")
    ).groupBy("user_id").agg(month_of(F.min("event_at")).alias("start_month"))
    used = rides.filter(
        (F.col("user_type") == MEMBER) & ~is_weekend(F.col("started_at"))
    ).groupBy("user_id", month_of(F.col("started_at")).alias("month")).agg(F.count(F.lit(1)).alias("used"))
    per_rider = members.join(
        used.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("month", "used"))).alias("usage")),
        "user_id", "left",
    )
    months = F.sequence("start_month", day(p.month_start), F.expr("INTERVAL '1' MONTH"))

    def step(acc: Column, month: Column) -> Column:
        rides_used = F.coalesce(F.try_element_at(F.col("usage"), month), F.lit(0).cast("long"))
        carry_in = acc["carry"]
        from_fresh = F.greatest(rides_used - carry_in, F.lit(0).cast("long"))
        carry_out = F.greatest(F.lit(monthly_credits).cast("long") - from_fresh, F.lit(0).cast("long"))
        over = F.greatest(from_fresh - monthly_credits, F.lit(0).cast("long"))
        row = F.struct(
            month.alias("month"), rides_used.alias("weekday_rides"), carry_in.alias("carried_in"),
            over.alias("rides_over"), carry_out.alias("carried_out"),
        )
        return F.struct(carry_out.alias("carry"), F.concat(acc["rows"], F.array(row)).alias("rows"))

    empty = F.array().cast(
        "array<struct<month:date,weekday_rides:bigint,carried_in:bigint,rides_over:bigint,carried_out:bigint>>"
    )
    start = F.struct(F.lit(0).cast("long").alias("carry"), empty.alias("rows"))
    return per_rider.select(
        "user_id", F.inline(F.aggregate(months, start, step, lambda acc: acc["rows"]))
    )
