"""Column helpers: exact sums, guarded ratios, half-up rounding, zone-free time."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, functions as F


def rnd(value: Column, digits: int = 0) -> Column:
    """Round half away from zero on doubles, the same digits in any engine.

    The built-in round works on the shortest decimal text of a double, which
    other engines do not; plain IEEE steps are reproducible everywhere.
    """
    scale = float(10**digits)
    x = value.cast("double")
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + 0.0


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when the denominator is zero."""
    return num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))


def flag(condition: Column) -> Column:
    return F.when(condition, 1).otherwise(0)


def cents(amount: Column) -> Column:
    """Money as whole cents: sums stay exact and order-free in one long."""
    return F.round(amount * 100).cast("long")


def millis(minutes: Column) -> Column:
    """Minutes as whole milliseconds: finer than any clock that trips are timed with, and
    sums stay exact and order-free in one long."""
    return F.round(minutes * 60_000).cast("long")


def money(cents_col: Column) -> Column:
    return cents_col.cast("double") / 100.0


def minutes(millis_col: Column) -> Column:
    return millis_col.cast("double") / 60_000.0


def ts(day: date | str) -> Column:
    """Midnight of a day as a timestamp without zone."""
    return F.lit(str(day)).cast("timestamp_ntz")


def day(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")


def month_of(when: Column) -> Column:
    """First day of the month as DATE (date_trunc would return a zoned timestamp)."""
    return F.trunc(F.to_date(when), "month")


def months_between_firsts(earlier: Column, later: Column) -> Column:
    """Calendar months from one month start to another."""
    return ((F.year(later) - F.year(earlier)) * 12 + F.month(later) - F.month(earlier)).cast("long")


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds as decimal(20,6), without touching the session time zone."""
    return (end - start).cast("interval second").cast("decimal(20,6)")


def whole_days_between(start: Column, end: Column) -> Column:
    """Completed days of 24 hours."""
    return F.extract(F.lit("DAY"), end - start).cast("long")


def is_weekend(when: Column) -> Column:
    return F.dayofweek(when).isin(1, 7)


def is_commute(when: Column) -> Column:
    """Weekday, 7:00-9:59 or 16:00-18:59."""
    hour = F.hour(when)
    return ~is_weekend(when) & (hour.between(7, 9) | hour.between(16, 18))


def since(df: DataFrame, time_col: str, start: date) -> DataFrame:
    """Keep rows from midnight of ``start`` on.

    When the table is stored by month the same bound is put on the partition
    column, so older directories are never listed or read.
    """
    kept = df.filter(F.col(time_col) >= ts(start))
    part = f"{time_col}_month"
    if part in df.columns:
        kept = kept.filter(F.col(part) >= day(start.replace(day=1)))
    return kept
