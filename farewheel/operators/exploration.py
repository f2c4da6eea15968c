"""Descriptive statistics of rides: distributions, calendars, shares, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.functions.columns import cents, is_weekend, millis, minutes, money, ratio, rnd
from farewheel.functions.horizon import until_as_of
from farewheel.params import CASUAL, CLASSIC, DEFAULTS, EBIKE, MEMBER, Params

RIDER_TYPES = [MEMBER, CASUAL]


def value_counts(rows: DataFrame, group: str, value: Column) -> DataFrame:
    """Rows per group and value.

    Durations are timed in seconds and costs in cents, so the number of distinct values
    is set by that precision and the longest ride, not by the ride volume. Percentiles
    and histograms run on these counts; the scan of the rides is one map-side combined
    aggregate. Values that are NULL are left out.
    """
    return rows.filter(value.isNotNull()).groupBy(group, value.alias("v")).agg(
        F.count(F.lit(1)).alias("n")
    )


def percentiles(value: str, n: str, *points: float) -> Column:
    return F.percentile(value, F.array(*[F.lit(q) for q in points]), F.col(n))


def casual_only(rides: DataFrame) -> DataFrame:
    return rides.filter(F.col("user_type") == CASUAL)


@until_as_of
def duration_stats(rides: DataFrame) -> DataFrame:
    """Count, mean, quantiles and sample deviation of the duration per rider type."""
    counts = value_counts(rides, "user_type", millis(F.col("duration_min")))
    n, total = F.sum("n"), F.sum(F.col("v") * F.col("n"))
    squares = F.sum((F.col("v") * F.col("v") * F.col("n")).cast("decimal(38,0)"))
    # n * sum(v^2) - sum(v)^2 is exact in integers; one division and one root follow
    spread = F.col("n") * F.col("sq") - F.col("total") * F.col("total")
    q = percentiles("v", "n", 0.5, 0.25, 0.75, 0.95)
    return counts.groupBy("user_type").agg(
        n.cast("decimal(12,0)").alias("n"), total.cast("decimal(18,0)").alias("total"),
        squares.cast("decimal(25,0)").alias("sq"), q.alias("q"),
    ).select(
        "user_type",
        F.col("n").cast("long").alias("count"),
        rnd(minutes(ratio(F.col("total"), F.col("n"))), 2).alias("mean"),
        rnd(minutes(F.col("q")[0]), 2).alias("median"),
        rnd(minutes(F.sqrt(ratio(spread, F.col("n") * (F.col("n") - 1)))), 2).alias("std"),
        rnd(minutes(F.col("q")[1]), 2).alias("p25"),
        rnd(minutes(F.col("q")[2]), 2).alias("p75"),
        rnd(minutes(F.col("q")[3]), 2).alias("p95"),
    ).orderBy("user_type")


@until_as_of
def casual_cost_by_bike(rides: DataFrame) -> DataFrame:
    counts = value_counts(casual_only(rides), "bike_type", cents(F.col("ride_cost_cad")))
    total = F.sum(F.col("v") * F.col("n"))
    return counts.groupBy("bike_type").agg(
        rnd(ratio(money(total), F.sum("n")), 2).alias("mean"),
        rnd(F.percentile("v", 0.5, F.col("n")) / 100.0, 2).alias("median"),
        rnd(money(total), 2).alias("total"),
    ).orderBy("bike_type")


@until_as_of
def breakeven(rides: DataFrame, p: Params = DEFAULTS, rides_per_month: int = 8) -> DataFrame:
    """Rides until the annual fee is paid back, over all bikes and per bike type."""
    sums = casual_only(rides).groupBy("bike_type").agg(
        F.sum(cents(F.col("ride_cost_cad"))).alias("cents"), F.count("ride_cost_cad").alias("n")
    ).rollup("bike_type").agg(
        ratio(money(F.sum("cents")), F.sum("n")).alias("cost"), F.grouping("bike_type").alias("all_bikes")
    )
    needed = ratio(F.lit(p.pricing.annual_fee), F.col("cost"))
    return sums.select(
        F.when(F.col("all_bikes") == 1, "ALL").otherwise(F.col("bike_type")).alias("bike_type"),
        rnd(F.col("cost"), 2).alias("avg_ride_cost_cad"),
        rnd(needed, 1).alias("breakeven_rides"),
        rnd(needed / float(rides_per_month), 1).alias("breakeven_months"),
    ).orderBy("bike_type")


def clip(value: Column, top: int) -> Column:
    """0..top; NULL stays NULL (least and greatest would skip it)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(0)), F.lit(top).cast("long")))


def histogram(rows: DataFrame, group: str, value: Column, top: float, bins: int, per_unit: int) -> DataFrame:
    """Density histogram per group after clipping to 0..top.

    ``value`` is whole, ``per_unit`` of them make one (milliseconds in a minute, cents).
    Bins are equal between the group's own minimum and maximum; the maximum falls into
    the last bin. NULL values are in no bin.
    """
    clipped = clip(value, round(top * per_unit))
    per_group = Window.partitionBy(group)
    counts = value_counts(rows, group, clipped)
    bounds = counts.groupBy(group).agg(
        F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("rows")
    )
    span = F.col("hi") - F.col("lo")
    # integer division keeps bin edges exact
    position = F.when(span == 0, F.lit(0)).otherwise(
        F.least(F.floor(F.try_divide((F.col("v") - F.col("lo")) * bins, span)), F.lit(bins - 1))
    ).cast("long")
    width = span / F.lit(float(per_unit)) / F.lit(float(bins))
    return (
        counts.join(bounds, group)
        .groupBy(group, "lo", "hi", "rows", position.alias("bin"))
        .agg(F.sum("n").alias("rides"))
        .select(
            group, "bin",
            rnd(F.col("lo") / F.lit(float(per_unit)) + F.col("bin") * width, 6).alias("bin_start"),
            "rides",
            rnd(ratio(F.col("rides"), F.col("rows") * width), 6).alias("density"),
        )
        .orderBy(group, "bin")
    )


@until_as_of
def duration_histogram(rides: DataFrame, top: float = 60.0, bins: int = 60) -> DataFrame:
    return histogram(rides, "user_type", millis(F.col("duration_min")), top, bins, 60_000)


@until_as_of
def cost_histogram(rides: DataFrame, top: float = 15.0, bins: int = 40) -> DataFrame:
    return histogram(casual_only(rides), "bike_type", cents(F.col("ride_cost_cad")), top, bins, 100)


@until_as_of
def duration_box(rides: DataFrame, top: float = 60.0) -> DataFrame:
    """Box plot numbers per rider type: quartiles, whiskers at the last value inside
    1.5 interquartile ranges, mean, and the number of values outside."""
    clipped = clip(millis(F.col("duration_min")), round(top * 60_000))
    counts = value_counts(rides, "user_type", clipped)
    boxes = counts.groupBy("user_type").agg(
        percentiles("v", "n", 0.25, 0.5, 0.75).alias("q"),
        ratio(F.sum(F.col("v") * F.col("n")), F.sum("n")).alias("mean"),
    ).select(
        "user_type", "mean",
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"),
    )
    reach = (F.col("q3") - F.col("q1")) * 1.5
    inside = F.col("v").between(F.col("q1") - reach, F.col("q3") + reach)
    return counts.join(boxes, "user_type").groupBy("user_type", "mean", "q1", "q2", "q3").agg(
        F.min(F.when(inside, F.col("v"))).alias("low"),
        F.max(F.when(inside, F.col("v"))).alias("high"),
        F.sum(F.when(~inside, F.col("n")).otherwise(0)).alias("outliers"),
    ).select(
        "user_type",
        *[rnd(minutes(F.col(c)), 2).alias(name) for c, name in [
            ("q1", "q1"), ("q2", "median"), ("q3", "q3"), ("low", "whisker_low"), ("high", "whisker_high"), ("mean", "mean"),
        ]],
        "outliers",
    ).orderBy("user_type")


def rides_by(rides: DataFrame, *keys: Column) -> DataFrame:
    """Counts per key and rider type side by side, zero filled. The rider types are
    given, so the pivot needs no pass to find them."""
    return (
        rides.groupBy(*keys).pivot("user_type", RIDER_TYPES).agg(F.count(F.lit(1)))
        .withColumnsRenamed({MEMBER: "annual_member", CASUAL: "casual_member"})
        .fillna(0, ["annual_member", "casual_member"])
    )


@until_as_of
def rides_by_month(rides: DataFrame) -> DataFrame:
    started = F.col("started_at")
    return rides_by(rides, F.month(started).cast("long").alias("month_no")).select(
        "month_no",
        F.date_format(F.make_date(F.lit(2024), F.col("month_no").cast("int"), F.lit(1)), "MMMM").alias("month_name"),
        "annual_member", "casual_member",
    ).orderBy("month_no")


@until_as_of
def rides_by_weekday(rides: DataFrame) -> DataFrame:
    """Monday is day 1."""
    number = (F.weekday("started_at") + 1).cast("long")
    return rides_by(rides, number.alias("day_no")).select(
        "day_no",
        # 1 January 2024 was a Monday
        F.date_format(F.make_date(F.lit(2024), F.lit(1), F.col("day_no").cast("int")), "EEEE").alias("day_name"),
        "annual_member", "casual_member",
    ).orderBy("day_no")


@until_as_of
def rides_by_hour(rides: DataFrame) -> DataFrame:
    return rides_by(rides, F.hour("started_at").cast("long").alias("hour_of_day")).orderBy("hour_of_day")


@until_as_of
def category_share(rides: DataFrame) -> DataFrame:
    """Percent of rides per rider type and per bike type, from one scan."""
    cells = rides.groupBy("user_type", "bike_type").agg(F.count(F.lit(1)).alias("n"))
    labelled = cells.select(
        F.explode(F.array(
            F.struct(F.lit("user_type").alias("dimension"), F.col("user_type").alias("category")),
            F.struct(F.lit("bike_type").alias("dimension"), F.col("bike_type").alias("category")),
        )).alias("c"), "n",
    ).groupBy("c.dimension", "c.category").agg(F.sum("n").alias("rides"))
    return labelled.select(
        "dimension", "category", "rides",
        rnd(ratio(F.col("rides") * 100, F.sum("rides").over(Window.partitionBy("dimension"))), 1).alias("pct"),
    ).orderBy("dimension", F.col("rides").desc())


@until_as_of
def spend_curve(rides: DataFrame, p: Params = DEFAULTS, first: int = 2, last: int = 19) -> DataFrame:
    """Monthly casual spend by ride frequency against the fee per month."""
    def mean_cost(bike: str) -> Column:
        priced = F.col("bike_type") == bike
        return ratio(money(F.sum(F.when(priced, F.col("cents")))), F.sum(F.when(priced, F.col("n"))))

    means = casual_only(rides).groupBy("bike_type").agg(
        F.sum(cents(F.col("ride_cost_cad"))).alias("cents"), F.count("ride_cost_cad").alias("n")
    ).agg(mean_cost(CLASSIC).alias("classic"), mean_cost(EBIKE).alias("ebike"))
    per_month = F.col("rides_per_month")
    fee = p.pricing.annual_fee / 12
    return means.select(
        "classic", "ebike", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))).alias("rides_per_month")
    ).select(
        "rides_per_month",
        rnd(per_month * F.col("classic"), 2).alias("classic_spend"),
        rnd(per_month * F.col("ebike"), 2).alias("ebike_spend"),
        rnd(F.lit(fee), 2).alias("membership_monthly"),
        (per_month * F.col("classic") > fee).alias("classic_pays_off"),
        (per_month * F.col("ebike") > fee).alias("ebike_pays_off"),
    ).orderBy("rides_per_month")


@until_as_of
def cluster_features(rides: DataFrame) -> DataFrame:
    """The seven clustering features of every casual ride. Peak hours are the morning
    ones only, and the weekday comes from the timestamp."""
    started = F.col("started_at")
    return casual_only(rides).select(
        "ride_id",
        F.col("duration_min"),
        F.hour(started).cast("long").alias("hour_of_day"),
        is_weekend(started).cast("long").alias("is_weekend"),
        (F.col("bike_type") == EBIKE).cast("long").alias("is_ebike"),
        F.month(started).cast("long").alias("month"),
        F.month(started).isin(6, 7, 8).cast("long").alias("is_summer"),
        F.hour(started).between(7, 9).cast("long").alias("is_peak_hr"),
        "ride_cost_cad",
    )
