"""Persona classification and targeting operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.functions.columns import (
    cents, day, flag, is_commute, is_weekend, millis, minutes, money, ratio, rnd, since, ts,
)
from farewheel.functions.horizon import until_as_of
from farewheel.operators.profiles import is_event, ride_totals, zero
from farewheel.params import (
    CASUAL, CTA_SHOWN, DEFAULTS, EBIKE, EBIKE_ADOPTER, Params, RELUCTANT_COMMUTER,
    SEASONAL_VISITOR, SIGNUP_COMPLETED, WEEKEND_EXPLORER,
)

TOO_FEW = "Insufficient data"
UNCLASSIFIED = "Unclassified"

# revenue potential: thousands a year if this percentage of riders converts
MONTHS = 12
CONVERTED_PCT = 5
THOUSAND = 1000.0


def days_since(last: Column, p: Params) -> Column:
    return F.datediff(day(p.as_of), F.to_date(last)).cast("long")


def behaviour_sums(casual: DataFrame, *more: Column) -> DataFrame:
    """Sums per rider that profiles are made of; all can be added and subtracted. ``more`` are
    further aggregates of the same pass."""
    started = F.col("started_at")
    return casual.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_rides"),
        F.sum(millis(F.col("duration_min"))).alias("millis"),
        F.count("duration_min").alias("timed"),
        F.sum(cents(F.col("ride_cost_cad"))).alias("cents"),
        F.count("ride_cost_cad").alias("priced"),
        F.sum(flag(is_weekend(started))).alias("weekend"),
        F.sum(flag(is_commute(started))).alias("commute"),
        F.sum(flag(F.col("bike_type") == EBIKE)).alias("ebike"),
        *more,
    )


def _patterns() -> tuple[Column, Column]:
    """What no sum tells: active months, as bits of one integer, so that the distinct count
    needs no second aggregation level; and the last ride."""
    months = F.bit_count(F.bit_or(F.expr("shiftleft(1, month(started_at))"))).cast("long")
    return months.alias("distinct_months_active"), F.max("started_at").alias("last_ride_at")


def profiles_of(sums: DataFrame, p: Params) -> DataFrame:
    """Profiles from sums. Shares and means are rounded here because the rules compare the
    rounded values."""
    n = F.col("total_rides")
    return sums.select(
        "user_id", "total_rides",
        rnd(ratio(minutes(F.col("millis")), F.col("timed")), 1).alias("avg_duration_min"),
        rnd(ratio(money(F.col("cents")), F.col("priced")), 2).alias("avg_ride_cost"),
        money(F.col("cents")).alias("total_spend_60d"),
        rnd(ratio(F.col("weekend"), n), 3).alias("pct_weekend"),
        rnd(ratio(F.col("commute"), n), 3).alias("pct_commute_hours"),
        rnd(ratio(F.col("ebike"), n), 3).alias("pct_ebike"),
        "distinct_months_active",
        "days_since_last_ride",
        rnd(money(F.col("cents")) / p.pricing.annual_fee, 3).alias("spend_to_membership_ratio"),
    )


def rider_profiles(rides: DataFrame, p: Params, lookback: int) -> DataFrame:
    """Trailing behaviour per casual rider in one shuffle."""
    casual = since(rides, "started_at", p.days_ago(lookback)).filter(F.col("user_type") == CASUAL)
    sums = behaviour_sums(casual, *_patterns())
    return profiles_of(sums.withColumn("days_since_last_ride", days_since(F.col("last_ride_at"), p)), p)


def persona_rule() -> Column:
    """First matching rule wins; e-bike preference comes before the other habits."""
    return (
        F.when(F.col("total_rides") < 3, TOO_FEW)
        .when(F.col("pct_ebike") >= 0.50, EBIKE_ADOPTER)
        .when((F.col("pct_weekend") >= 0.60) & (F.col("avg_duration_min") >= 20), WEEKEND_EXPLORER)
        .when((F.col("pct_commute_hours") >= 0.40) & (F.col("avg_duration_min") <= 15), RELUCTANT_COMMUTER)
        .when((F.col("total_rides") <= 6) & (F.col("distinct_months_active") <= 2), SEASONAL_VISITOR)
        .otherwise(UNCLASSIFIED)
    )


@until_as_of
def score_riders(rides: DataFrame, p: Params = DEFAULTS, lookback: int = 60) -> DataFrame:
    """Persona and conversion score of every rider with at least three rides, unsorted
    as the nightly job writes it."""
    return score_profiles(rider_profiles(rides, p, lookback))


def score_profiles(profiles: DataFrame) -> DataFrame:
    frequency = F.when(F.col("total_rides") >= 8, 0.20).otherwise(F.col("total_rides") * 0.025)
    recency = F.when(F.col("days_since_last_ride") <= 7, 0.10).otherwise(0.0)
    score = (
        F.col("pct_commute_hours") * 0.30
        + F.col("spend_to_membership_ratio") * 0.40
        + frequency
        + recency
    )
    return (
        profiles.withColumn("persona_segment", persona_rule())
        .withColumn("conversion_priority_score", rnd(score, 3))
        .filter(F.col("persona_segment") != TOO_FEW)
    )


@until_as_of
def classify_riders(rides: DataFrame, p: Params = DEFAULTS, lookback: int = 60) -> DataFrame:
    return score_riders(rides, p, lookback).orderBy(F.col("conversion_priority_score").desc_nulls_last())


# The tier that fits a persona's habits; others go by their weekend share.
TIERS = {
    WEEKEND_EXPLORER: "weekend", RELUCTANT_COMMUTER: "annual", EBIKE_ADOPTER: "annual", SEASONAL_VISITOR: "day_pass",
}


@until_as_of
def tier_recommendation(
    rides: DataFrame, p: Params = DEFAULTS, lookback: int = 60, weekend_share: float = 0.5
) -> DataFrame:
    """The membership to recommend to each classified rider. The weekend tier is hidden
    from riders who mostly ride on weekdays, commuters among them."""
    mostly_weekend = F.col("pct_weekend") >= weekend_share
    shown = mostly_weekend & (F.col("persona_segment") != RELUCTANT_COMMUTER)
    fitting = F.element_at(F.create_map(*[F.lit(x) for pair in TIERS.items() for x in pair]), F.col("persona_segment"))
    tier = F.coalesce(fitting, F.when(mostly_weekend, "weekend").otherwise("annual"))
    return score_riders(rides, p, lookback).select(
        "user_id", "persona_segment", "pct_weekend", shown.alias("weekend_tier_shown"),
        F.when((tier == "weekend") & ~shown, "annual").otherwise(tier).alias("recommended_tier"),
    )


def users_with_personas(users: DataFrame, personas: DataFrame) -> DataFrame:
    """Users with the persona of the latest classification; riders it did not cover
    have none. ``personas`` has one row per rider."""
    return users.drop("persona_segment").join(
        personas.select("user_id", "persona_segment"), "user_id", "left"
    ).select(users.columns)


@until_as_of
def persona_summary(
    users: DataFrame, rides: DataFrame, p: Params = DEFAULTS, lookback: int = 90
) -> DataFrame:
    """Size, behaviour and revenue potential per persona (riders without one left out)."""
    casual = since(rides, "started_at", p.days_ago(lookback)).filter(F.col("user_type") == CASUAL)
    riders = ride_totals(casual).join(
        users.filter(F.col("persona_segment").isNotNull()).select("user_id", "persona_segment"), "user_id"
    ).select(
        "persona_segment", "rides", "cents",
        rnd(ratio(minutes(F.col("millis")), F.col("timed_rides")), 1).alias("avg_duration"),
        rnd(ratio(money(F.col("cents")), F.col("priced_rides")), 2).alias("avg_cost"),
    )
    # the rounded means are carried as whole milliseconds and cents, so their sums are exact
    sums = riders.groupBy("persona_segment").agg(
        F.count(F.lit(1)).alias("rider_count"),
        ratio(F.sum("rides"), F.count(F.lit(1))).alias("mean_rides"),
        ratio(minutes(F.sum(millis(F.col("avg_duration")))), F.count("avg_duration")).alias("mean_duration"),
        ratio(money(F.sum(cents(F.col("avg_cost")))), F.count("avg_cost")).alias("mean_cost"),
        ratio(money(F.sum("cents")), F.count("cents")).alias("mean_spend"),
    )
    everyone = Window.partitionBy()
    fee = p.pricing.annual_fee
    return sums.select(
        "persona_segment", "rider_count",
        rnd(ratio(F.col("rider_count") * 100, F.sum("rider_count").over(everyone)), 1)
        .alias("pct_of_casual_base"),
        rnd(F.col("mean_rides"), 1).alias("avg_rides_per_rider_90d"),
        rnd(F.col("mean_duration"), 1).alias("avg_trip_duration_min"),
        rnd(F.col("mean_cost"), 2).alias("avg_ride_cost_cad"),
        rnd(F.col("mean_spend"), 2).alias("avg_spend_90d_cad"),
        rnd(ratio(F.lit(fee), F.col("mean_cost"))).alias("breakeven_rides"),
        rnd(ratio(F.lit(fee), F.col("mean_cost") * F.col("mean_rides") / 3.0), 1).alias("months_to_breakeven"),
        rnd(F.col("rider_count") * fee * MONTHS * CONVERTED_PCT / (100 * THOUSAND)).alias("arr_opportunity_at_5pct_k"),
    ).orderBy(F.col("arr_opportunity_at_5pct_k").desc_nulls_last())


@until_as_of
def ebike_savings(rides: DataFrame, p: Params = DEFAULTS, lookback: int = 90) -> DataFrame:
    """Casual against member price of the e-bike rides actually taken. Costs are linear
    in minutes, so they follow from ride and minute totals."""
    price = p.pricing
    sums = since(rides, "started_at", p.days_ago(lookback)).filter(F.col("bike_type") == EBIKE).groupBy(
        "user_type"
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("duration_min").alias("timed"),
        minutes(F.sum(millis(F.col("duration_min")))).alias("min"),
    )
    casual = F.col("user_type") == CASUAL
    mean_min = ratio(F.col("min"), F.col("timed"))
    saving = F.when(casual, price.unlock + mean_min * (price.ebike_per_min - price.member_ebike_per_min)).otherwise(0.0)
    return sums.select(
        "user_type",
        F.col("n").alias("ebike_rides"),
        rnd(mean_min, 1).alias("avg_duration_min"),
        rnd(F.when(casual, price.unlock + mean_min * price.ebike_per_min).otherwise(0.0), 2)
        .alias("avg_casual_cost_cad"),
        rnd(mean_min * price.member_ebike_per_min, 2).alias("avg_member_cost_cad"),
        rnd(saving, 2).alias("avg_savings_per_ride"),
        rnd(saving * F.col("n") / lookback * 365, 2).alias("projected_annual_savings_cad"),
        rnd(ratio(F.lit(price.annual_fee), saving)).alias("ebike_breakeven_rides"),
    )


# Texts shown to the rider, with the numbers put between them.
EBIKE_HINT = ("E-bike nudge: Member rate saves ~C$", "/mo")
SPEND_HINT = ("Spend nudge: C$", " spent — membership = C$", "/mo")
COMMUTER_HINT = ("Commuter nudge: ", " rides → break-even in ", " more rides")
STANDARD_HINT = "Standard membership CTA"


def whole(value: Column) -> Column:
    """A rounded number as digits only, so that it prints the same everywhere."""
    return rnd(value).cast("long").cast("string")


@until_as_of
def priority_nudge_targets(
    rides: DataFrame, users: DataFrame, events: DataFrame, p: Params = DEFAULTS,
    lookback: int = 30, limit: int = 10_000, grain_safe: bool = False,
) -> DataFrame:
    """The riders to contact this week. As written, ride count and spend grow with the
    rider's event rows; ``grain_safe`` counts every ride once."""
    casual = since(rides, "started_at", p.days_ago(lookback)).filter(F.col("user_type") == CASUAL)
    shown_now = is_event(CTA_SHOWN) & (F.col("event_at") >= ts(p.month_start))
    contact = events.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("event_rows"),
        F.max(flag(shown_now)).alias("nudged_this_month"),
        F.max(flag(is_event(SIGNUP_COMPLETED))).alias("is_member"),
    )
    weight = F.lit(1) if grain_safe else F.greatest(zero("event_rows"), F.lit(1))
    signals = (
        ride_totals(casual)
        .join(contact, "user_id", "left")
        .filter((zero("is_member") == 0) & (zero("nudged_this_month") == 0))
        .withColumn("total_rides_30d", F.col("rides") * weight)
        .filter(F.col("total_rides_30d") >= 3)
        .join(users.select("user_id", "persona_segment"), "user_id")
        .select(
            "user_id", "persona_segment", "total_rides_30d",
            money(F.col("cents") * weight).alias("spend"),
            days_since(F.col("last_ride_at"), p).alias("days_since_last_ride"),
            rnd(ratio(minutes(F.col("millis")), F.col("timed_rides")), 1).alias("avg_duration"),
            rnd(ratio(F.col("ebike_rides"), F.col("rides")), 2).alias("pct_ebike"),
        )
    )
    price = p.pricing
    spend, n = F.col("spend"), F.col("total_rides_30d")
    member_gain = price.ebike_per_min - price.member_ebike_per_min
    hint = (
        F.when(
            F.col("pct_ebike") >= 0.50,
            F.concat(F.lit(EBIKE_HINT[0]), whole((price.unlock + F.col("avg_duration") * member_gain) * n), F.lit(EBIKE_HINT[1])),
        )
        .when(spend >= 30, F.concat(F.lit(SPEND_HINT[0]), whole(spend), F.lit(f"{SPEND_HINT[1]}{price.annual_fee / MONTHS:.2f}{SPEND_HINT[2]}")))
        .when(
            F.col("persona_segment") == RELUCTANT_COMMUTER,
            F.concat(F.lit(COMMUTER_HINT[0]), n.cast("string"), F.lit(COMMUTER_HINT[1]),
                     whole(ratio(F.lit(price.annual_fee), spend / n)), F.lit(COMMUTER_HINT[2])),
        )
        .otherwise(STANDARD_HINT)
    )
    recency = (
        F.when(F.col("days_since_last_ride") <= 3, 20)
        .when(F.col("days_since_last_ride") <= 7, 15)
        .when(F.col("days_since_last_ride") <= 14, 5)
        .otherwise(0)
    )
    score = (
        F.least(spend / price.annual_fee, F.lit(1.0)) * 40
        + F.least(n / 10.0, F.lit(1.0)) * 25
        + recency
        + F.col("pct_ebike") * 15
    )
    return signals.select(
        "user_id", "persona_segment", "total_rides_30d",
        rnd(spend, 2).alias("total_spend_30d_cad"),
        "days_since_last_ride", "avg_duration", "pct_ebike",
        rnd(spend / price.annual_fee * 100).alias("pct_of_membership_spent"),
        hint.alias("recommended_nudge_message"),
        rnd(score).alias("priority_score"),
    ).orderBy(F.col("priority_score").desc_nulls_last(), "user_id").limit(limit)
