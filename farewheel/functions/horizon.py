"""Nothing after ``as_of``: the one place where "today" ends the data."""

from __future__ import annotations

import functools
import inspect
from datetime import date, timedelta

from pyspark.sql import DataFrame, functions as F

from farewheel.functions.columns import day, ts
from farewheel.params import DEFAULTS

# columns that say when a row of a fact table happened
TIMES = ("started_at", "event_at")


def known_by(df: DataFrame, as_of: date) -> DataFrame:
    """Rows of a fact table that were there at the end of ``as_of``; rows without a time
    stay. Stored tables get the bound on their month column too, so later directories are
    not read. A rider's first ride is unknown until it has happened."""
    end = ts(as_of + timedelta(days=1))
    for column in TIMES:
        if column in df.columns:
            df = df.filter(F.col(column).isNull() | (F.col(column) < end))
            month = f"{column}_month"
            if month in df.columns:
                df = df.filter(F.col(month).isNull() | (F.col(month) <= day(as_of.replace(day=1))))
    if "first_ride_at" in df.columns:
        df = df.withColumn("first_ride_at", F.when(F.col("first_ride_at") < end, F.col("first_ride_at")))
    return df


def until_as_of(operator):
    """Cut every table that an operator receives at its ``p.as_of``. Operators without
    parameters take ``as_of`` as a keyword."""
    signature = inspect.signature(operator)

    @functools.wraps(operator)
    def run(*args, as_of: date | None = None, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        last = as_of or bound.arguments.get("p", DEFAULTS).as_of
        for name, value in bound.arguments.items():
            if isinstance(value, DataFrame):
                bound.arguments[name] = known_by(value, last)
        return operator(*bound.args, **bound.kwargs)

    return run
