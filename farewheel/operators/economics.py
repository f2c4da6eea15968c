"""Revenue and break-even comparisons across operators of bike networks."""

from __future__ import annotations

from datetime import timedelta
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.functions.columns import cents, minutes, money, ratio, rnd, since
from farewheel.functions.horizon import until_as_of
from farewheel.operators.exploration import casual_only
from farewheel.operators.funnel import STEPS
from farewheel.operators.profiles import is_event
from farewheel.params import CASUAL, DEFAULTS, EBIKE, Params

class Operator(NamedTuple):
    id: str
    city: str
    currency: str
    annual_price: float
    casual_ride_cost: float
    day_pass: float
    second_annual_price: float | None = None


# Published profiles of four operators.
OPERATORS = [
    Operator("toronto", "Toronto, ON", "CAD", 105.0, 4.48, 15.0, 120.0),
    Operator("divvy", "Chicago, IL", "USD", 105.0, 3.30, 15.0),
    Operator("citibike", "New York, NY", "USD", 179.0, 4.50, 15.0),
    Operator("santander", "London, UK", "GBP", 120.0, 3.20, 18.0),
]

# Conversion scenarios.
SCENARIOS = [
    ("Current (2.8%)", 0.028),
    ("Post-nudge (4.2%)", 0.042),
    ("Q3 target (5.0%)", 0.050),
    ("Stretch (7.5%)", 0.075),
]


def _as_rows(names: list[str], rows: list[tuple]) -> Column:
    """A short constant list as an array column, to be exploded next to one result row."""
    return F.array(*[
        F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row)]) for row in rows
    ])


@until_as_of
def funnel_shares(
    rides: DataFrame, events: DataFrame, p: Params = DEFAULTS, lookback: int = 30
) -> DataFrame:
    """Riders per funnel stage over the whole window, share of the base, loss per stage."""
    start = p.days_ago(lookback)
    casual = since(rides, "started_at", start).filter((F.col("user_type") == CASUAL) & F.col("user_id").isNotNull())
    base = casual.groupBy("user_id").agg(F.lit(1).alias("casual_riders"))
    reached = since(events, "event_at", start).groupBy("user_id").agg(
        *[F.max(is_event(step).cast("int")).alias(step) for step in STEPS]
    )
    stages = ["casual_riders", *STEPS]
    totals = base.join(reached, "user_id", "left").agg(
        *[F.coalesce(F.sum(s), F.lit(0)).alias(s) for s in stages]
    )
    rows = totals.select(F.posexplode(F.array(*[
        F.struct(F.lit(s).alias("stage"), F.col(s).alias("riders")) for s in stages
    ])).alias("pos", "s")).select(
        (F.col("pos") + 1).cast("long").alias("stage_no"), "s.stage", "s.riders"
    )
    order = Window.orderBy("stage_no")
    return rows.select(
        "stage_no", "stage", "riders",
        rnd(ratio(F.col("riders"), F.first("riders").over(order)), 4).alias("share_of_base"),
        rnd(1.0 - ratio(F.col("riders"), F.lag("riders").over(order)), 4).alias("drop_from_previous"),
    ).orderBy("stage_no")


@until_as_of
def arr_scenarios(rides: DataFrame, p: Params = DEFAULTS, months: int = 12) -> DataFrame:
    """Annual revenue per operator price and scenario at the casual volume of the last
    ``months`` months, and what a scenario adds to the first one, the current rate."""
    volume = casual_only(since(rides, "started_at", p.months_ago(months) + timedelta(days=1))).agg(
        (F.count(F.lit(1)) / F.lit(float(months))).alias("monthly")
    )
    grid = volume.select(
        "monthly",
        F.explode(_as_rows(["operator", "price"], [(o.id, o.annual_price) for o in OPERATORS])).alias("o"),
    ).select("monthly", "o.*", F.explode(_as_rows(["scenario", "rate"], SCENARIOS)).alias("s"))
    members = F.floor(F.col("monthly") * F.col("s.rate"))
    now = F.floor(F.col("monthly") * F.lit(SCENARIOS[0][1]))
    return grid.select(
        "operator", "s.scenario", "s.rate",
        rnd(F.col("monthly"), 1).alias("monthly_casual_rides"),
        members.alias("members_per_month"),
        rnd(members * F.col("price") * 12 / 1000.0, 3).alias("arr_k"),
        (members - now).alias("incremental_members_per_month"),
        rnd((members - now) * F.col("price") * 12 / 1000.0, 3).alias("incremental_arr_k"),
    ).orderBy("operator", "rate")


@until_as_of
def price_ladder(rides: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """From the single ride to the annual memberships, per operator, with the rides that
    pay each step back at the ride cost observed."""
    share = p.pricing.weekend_tier_share
    steps = [
        (o.id, number, step, price)
        for o in OPERATORS
        for number, (step, price) in enumerate([
            ("single_ride", o.casual_ride_cost), ("day_pass", o.day_pass), ("weekend", o.annual_price * share),
            ("annual", o.annual_price), ("annual_plus", o.second_annual_price)], 1)
        if price is not None
    ]
    observed = casual_only(rides).agg(
        ratio(money(F.sum(cents(F.col("ride_cost_cad")))), F.count("ride_cost_cad")).alias("cost")
    )
    return observed.select("cost", F.inline(_as_rows(["operator", "step_no", "step", "price"], steps))).select(
        "operator", F.col("step_no").cast("long").alias("step_no"), "step", rnd(F.col("price"), 2).alias("price"),
        F.ceil(ratio(F.col("price"), F.col("cost"))).alias("rides_to_pay_back"),
    ).orderBy("operator", "step_no")


@until_as_of
def operator_breakeven(rides: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Break-even rides of each operator at its published and at the observed ride cost,
    and the price of its weekend tier."""
    observed = casual_only(rides).agg(
        ratio(money(F.sum(cents(F.col("ride_cost_cad")))), F.count("ride_cost_cad")).alias("cost")
    )
    names = ["operator", "city", "currency", "annual_price", "ride_cost"]
    price = F.col("annual_price")
    return observed.select(
        "cost", F.inline(_as_rows(names, [(o.id, o.city, o.currency, o.annual_price, o.casual_ride_cost) for o in OPERATORS]))
    ).select(
        "operator", "city", "currency", "annual_price",
        F.ceil(price / F.col("ride_cost")).alias("breakeven_rides_published"),
        rnd(F.col("cost"), 2).alias("observed_ride_cost"),
        F.ceil(ratio(price, F.col("cost"))).alias("breakeven_rides_observed"),
        rnd(price * p.pricing.weekend_tier_share).alias("weekend_tier_price"),
    ).orderBy("operator")


@until_as_of
def ebike_price_gap(rides: DataFrame, p: Params = DEFAULTS) -> DataFrame:
    """Casual and member price by e-bike ride length, over the lengths really ridden."""
    price = p.pricing
    lengths = rides.filter(F.col("bike_type") == EBIKE).groupBy("duration_min").agg(F.count(F.lit(1)).alias("rides"))
    length = F.col("duration_min")
    casual, member = length * price.ebike_per_min, length * price.member_ebike_per_min
    return lengths.filter(length.isNotNull()).select(
        "duration_min", "rides",
        rnd(casual, 2).alias("casual_cost"),
        rnd(member, 2).alias("member_cost"),
        rnd(casual - member, 2).alias("gap"),
        rnd(ratio(F.lit(price.annual_fee), casual), 1).alias("breakeven_rides"),
    ).orderBy("duration_min")
