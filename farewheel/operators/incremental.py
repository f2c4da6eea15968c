"""Trailing rider profiles kept up to date by the two days that change each night.

The state holds, per rider with a ride in the window, sums that can be added and subtracted and
one bit per day on which they rode (a window of at most 63 days fits one number, by day number
modulo 64). A night adds the day that enters and subtracts the day that leaves, for the riders of
these two days alone. Active months and the last ride, which no subtraction gives back, are read
from the bits. The state is a versioned table, so a night can be repeated or die half way.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, functions as F

from farewheel.functions.columns import day, since, ts
from farewheel.operators.segmentation import behaviour_sums, profiles_of
from farewheel.params import CASUAL, DEFAULTS, Params
from farewheel.sources.versioned import VersionedTable

SUMS = ("total_rides", "millis", "timed", "cents", "priced", "weekend", "commute", "ebike")
LONGEST = 62
_EPOCH = date(1970, 1, 1)


def _days_between(rides: DataFrame, first: date, last: date) -> DataFrame:
    """Casual rides of whole days; stored months outside are not read."""
    kept = since(rides, "started_at", first).filter((F.col("started_at") < ts(last + timedelta(days=1))) & (F.col("user_type") == CASUAL))
    if "started_at_month" in kept.columns:
        kept = kept.filter(F.col("started_at_month") <= day(last.replace(day=1)))
    return kept.filter(F.col("user_id").isNotNull())


def _sums(rides: DataFrame) -> DataFrame:
    bit = F.expr("bit_or(shiftleft(1L, CAST(pmod(datediff(to_date(started_at), DATE'1970-01-01'), 64) AS INT)))")
    sums = behaviour_sums(rides, bit.alias("ride_days"))
    return sums.select("user_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in SUMS], "ride_days")


def _bit(of: date) -> int:
    value = 1 << (of - _EPOCH).days % 64
    return value - (1 << 64) if value >> 63 else value


def start_profiles(rides: DataFrame, path: str, p: Params = DEFAULTS, lookback: int = 60, buckets: int = 64) -> VersionedTable:
    """The state at ``p.as_of``, from all rides of the window."""
    if lookback > LONGEST:
        raise ValueError(f"one number holds the days of {LONGEST} days of lookback at most")
    rows = _sums(_days_between(rides, p.days_ago(lookback), p.as_of))
    return VersionedTable.create(rows, path, "user_id", str(p.as_of), buckets)


def advance_profiles(state: VersionedTable, rides: DataFrame, p: Params = DEFAULTS, lookback: int = 60) -> int:
    """The night of ``p.as_of``: reads the rides of that day and of the one that leaves the window,
    and returns the state's version. A night that is done changes nothing; nights come in order.
    Rides that are recorded after their night has run are not seen."""
    done = state.manifest()["run"]
    if done == str(p.as_of):
        return state.version()
    if done != str(p.days_ago(1)):
        raise ValueError(f"the state is of {done}, the night before {p.as_of} is missing")
    leaving = p.days_ago(lookback + 1)
    enters, leaves = (_sums(_days_between(rides, d, d)) for d in (p.as_of, leaving))
    signed = enters.union(leaves.select("user_id", *[(-F.col(c)).alias(c) for c in SUMS], F.lit(0).cast("long").alias("ride_days")))
    change = signed.groupBy("user_id").agg(*[F.sum(c).alias(f"d_{c}") for c in SUMS], F.bit_or("ride_days").alias("d_days"))
    old = state.read()
    zero = F.lit(0).cast("long")
    days = F.coalesce("ride_days", zero).bitwiseAND(F.lit(~_bit(leaving)).cast("long")).bitwiseOR(F.col("d_days"))
    rows = change.join(old, "user_id", "left").select(
        "user_id", *[(F.coalesce(F.col(c), zero) + F.col(f"d_{c}")).alias(c) for c in SUMS], days.alias("ride_days"))
    return state.upsert(rows, str(p.as_of))


def _months_ridden(p: Params, lookback: int) -> Column:
    months: dict[tuple[int, int], int] = {}
    for i in range(lookback + 1):
        d = p.days_ago(i)
        months[d.year, d.month] = months.get((d.year, d.month), 0) | _bit(d) % (1 << 64)
    signed = [m - (1 << 64) if m >> 63 else m for m in months.values()]
    flags = [F.col("ride_days").bitwiseAND(F.lit(m).cast("long")) != 0 for m in signed]
    return sum((f.cast("long") for f in flags[1:]), flags[0].cast("long"))


def _days_since_last(p: Params) -> Column:
    """Places from the bit of ``as_of`` down to the first day with a ride."""
    to_top = 63 - (p.as_of - _EPOCH).days % 64
    turned = F.shiftleft("ride_days", to_top).bitwiseOR(F.shiftrightunsigned("ride_days", 64 - to_top)) if to_top else F.col("ride_days")
    return (F.lit(64) - F.length(F.bin(turned))).cast("long")


def profiles_from_state(state: DataFrame, p: Params = DEFAULTS, lookback: int = 60) -> DataFrame:
    """The rows of ``rider_profiles`` from the state of the night of ``p.as_of``."""
    riding = state.filter("total_rides > 0").withColumns({
        "millis": F.when(F.col("timed") > 0, F.col("millis")), "cents": F.when(F.col("priced") > 0, F.col("cents")),
        "distinct_months_active": _months_ridden(p, lookback), "days_since_last_ride": _days_since_last(p)})
    return profiles_of(riding, p)
