"""Which channel a conversion is owed to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farewheel.functions.asof import join_latest
from farewheel.functions.columns import ratio, rnd, seconds_between
from farewheel.functions.horizon import until_as_of
from farewheel.operators.profiles import first_conversion, is_event
from farewheel.params import CTA_CLICKED, CTA_SHOWN, DEFAULTS, Params

NO_TOUCH = "no touch"


@until_as_of
def conversion_by_last_touch(events: DataFrame, p: Params = DEFAULTS, lookback: int = 30) -> DataFrame:
    """First conversions by the channel of the last call to action that the rider saw or clicked
    in the ``lookback`` days before, with the riders that each channel touched at all."""
    touches = events.filter(is_event(CTA_SHOWN, CTA_CLICKED)).select(
        "user_id", F.col("event_at").alias("touched_at"), F.coalesce("source_channel", F.lit("unknown")).alias("channel"))
    found = join_latest(first_conversion(events), touches, "user_id", "converted_at", "touched_at", ["channel"])
    fresh = F.col("touched_at") >= F.col("converted_at") - F.make_dt_interval(F.lit(lookback))
    owed = found.withColumn("channel", F.when(fresh, F.col("channel")).otherwise(NO_TOUCH)).groupBy("channel").agg(
        F.count("*").alias("conversions"),
        F.sum(F.when(fresh, seconds_between(F.col("touched_at"), F.col("converted_at")))).alias("seconds"))
    # one row per rider and channel first: distinct riders are a plain count
    touched = touches.filter("user_id IS NOT NULL").select("user_id", "channel").distinct().groupBy("channel").agg(F.count("*").alias("riders_touched"))
    return owed.join(touched, "channel", "full").select(
        F.col("channel").alias("last_touch_channel"), F.coalesce("conversions", F.lit(0)).alias("conversions"),
        F.coalesce("riders_touched", F.lit(0)).alias("riders_touched"),
        rnd(ratio(F.coalesce("conversions", F.lit(0)), F.col("riders_touched")), 4).alias("conversion_rate"),
        rnd(ratio(F.col("seconds"), F.col("conversions") * 3600), 1).alias("avg_hours_from_touch"),
    )
