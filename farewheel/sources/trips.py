"""Published trip CSV files, in and out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from farewheel.functions.columns import seconds_between
from farewheel.model import RIDES
from farewheel.params import DEFAULTS, EBIKE, MEMBER, Params

# Published header name -> canonical name.
TRIP_COLUMNS = {
    "Trip Id": "ride_id",
    "Trip Duration": "duration_sec",
    "Start Station Id": "station_id",
    "Start Time": "started_at",
    "Stop Time": "ended_at",
    "User Type": "user_type",
    "Bike Id": "bike_id",
    "Model": "bike_type",
}


def ride_cost(p: Params = DEFAULTS) -> Column:
    """Price of a ride by rider type, bike and minutes, in cents. NULL without a duration."""
    price, ebike, member = p.pricing, F.col("bike_type") == EBIKE, F.col("user_type") == MEMBER
    per_min = (
        F.when(member & ebike, price.member_ebike_per_min).when(member, 0.0)
        .when(ebike, price.ebike_per_min).otherwise(price.classic_per_min)
    )
    unlock = F.when(member, 0.0).otherwise(price.unlock)
    exact = unlock.cast("decimal(6,2)") + per_min.cast("decimal(6,4)") * F.col("duration_min").cast("decimal(18,6)")
    return F.round(exact, 2).cast("decimal(10,2)")


def _when(name: str) -> Column:
    """ISO times, and month/day/year with hour and minute; anything else is NULL."""
    iso = F.regexp_replace(F.col(name), r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    padded = F.regexp_replace(F.regexp_replace(iso, r"-(\d)(?=\D)", "-0$1"), r" (\d:)", " 0$1")
    return padded.try_cast("timestamp_ntz")


def read_trips(
    spark: SparkSession, path: str, bikes: DataFrame | None = None, riders: DataFrame | None = None, p: Params = DEFAULTS
) -> DataFrame:
    """Monthly CSV files as the ``rides`` table that every operator takes.

    Files are matched by header name, so columns may come in any order, and columns that a
    file lacks are NULL. Values that cannot be read are NULL; rows without a trip id or a
    start are dropped. The kind of bike comes from the file's Model, else from ``bikes``
    (bike_id, bike_type); public files name no rider, so ``riders`` (ride_id, user_id) may
    bring them. Prices follow from the duration in seconds.
    """
    raw = spark.read.option("header", True).csv(path)
    text = {to: F.trim(F.col(f"`{name}`")) if name in raw.columns else F.lit(None).cast("string") for name, to in TRIP_COLUMNS.items()}
    trips = raw.select(*[column.alias(to) for to, column in text.items()]).filter("ride_id IS NOT NULL").select(
        "ride_id", _when("started_at").alias("started_at"), _when("ended_at").alias("ended_at"),
        (F.col("duration_sec").try_cast("double") / 60.0).alias("duration_min"), "user_type", "bike_id", "bike_type",
        F.col("station_id").try_cast("double").cast("long").alias("station_id"),
    ).filter("started_at IS NOT NULL")
    if bikes is not None:
        known = bikes.select("bike_id", F.col("bike_type").alias("_type"))
        trips = trips.join(known, "bike_id", "left").withColumn("bike_type", F.coalesce("bike_type", "_type"))
    if riders is not None:
        trips = trips.join(riders.select("ride_id", "user_id"), "ride_id", "left")
    else:
        trips = trips.withColumn("user_id", F.lit(None).cast("long"))
    return trips.withColumn("ride_cost_cad", ride_cost(p)).select(*[F.col(f.name).cast(f.dataType) for f in RIDES])


def write_trips(rides: DataFrame, path: str) -> None:
    """Rides in the published layout, one file per task."""
    published: dict[str, Column] = {
        "Trip Id": F.col("ride_id"),
        "Trip Duration": seconds_between(F.col("started_at"), F.col("ended_at")).cast("long"),
        "Start Station Id": F.col("station_id"),
        "Start Time": F.col("started_at"),
        "Stop Time": F.col("ended_at"),
        "User Type": F.col("user_type"),
        "Model": F.col("bike_type"),
    }
    rides.select(*[column.alias(name) for name, column in published.items()]).write.option("header", True).csv(path)
