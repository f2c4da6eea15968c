"""Persona discovery by k-means on the casual rides.

The seven features take few distinct values (durations, hours, months, flags), so equal
rides are merged into one weighted point before any iteration; weighted k-means on the
points has the same objective as plain k-means on the rides. The number of points is set
by that grid: about 600 combinations of the other features for each distinct duration,
so 36,000 for whole minutes up to an hour and 2 million for whole seconds, whatever the
ride volume. Points are written once and every restart reads them. ``lloyd.py`` moves the centres
of all restarts in one job per round, on whole numbers, so a fit has the same digits however
the points are dealt, and plain SQL can repeat it.

Rides with a NULL among the seven features take no part: they have no place in the space.
"""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.functions.columns import cents, millis, money, ratio, rnd
from farewheel.functions.horizon import until_as_of
from farewheel.operators import lloyd
from farewheel.operators.exploration import cluster_features
from farewheel.params import EBIKE_ADOPTER, RELUCTANT_COMMUTER, SEASONAL_VISITOR, WEEKEND_EXPLORER
from farewheel.sources.storage import scratch_dir

FEATURES = ["duration_min", "hour_of_day", "is_weekend", "is_ebike", "month", "is_summer", "is_peak_hr"]


def feature_moments(rows: DataFrame, weight: Column) -> DataFrame:
    """Mean and population deviation of each feature as one row."""
    n = F.sum(weight).cast("double")
    sums = rows.agg(
        n.alias("n"),
        *[F.sum(F.col(f) * weight).cast("double").alias(f"s_{f}") for f in FEATURES],
        *[F.sum(F.col(f) * F.col(f) * weight).cast("double").alias(f"q_{f}") for f in FEATURES],
    )
    out = []
    for f in FEATURES:
        mean = ratio(F.col(f"s_{f}"), F.col("n"))
        out.append(mean.alias(f"mean_{f}"))
        out.append(F.sqrt(F.greatest(ratio(F.col(f"q_{f}"), F.col("n")) - mean * mean, F.lit(0.0))).alias(f"std_{f}"))
    return sums.select(*out)


def with_moments(rows: DataFrame, weight: Column) -> DataFrame:
    """Rows with the moments of all of them as a struct, a scalar subquery run once."""
    moments = feature_moments(rows, weight).select(F.struct("*").alias("m"))
    return rows.withColumn("m", moments.scalar())


def scaled(feature: str) -> Column:
    """z-score; a constant feature becomes 0."""
    return F.coalesce(ratio(F.col(feature) - F.col(f"m.mean_{feature}"), F.col(f"m.std_{feature}")), F.lit(0.0))


@until_as_of
def feature_scaling(rides: DataFrame) -> DataFrame:
    """Every casual ride with its standardised features."""
    return with_moments(cluster_features(rides), F.lit(1)).select(
        "ride_id", *[rnd(scaled(f), 6).alias(f) for f in FEATURES]
    )


# The whole-number columns that fits read in place of the features, and their units.
WHOLE = ["duration_ms", *FEATURES[1:]]
UNITS = [60_000.0] + [1.0] * (len(FEATURES) - 1)


def weighted_points(rides: DataFrame) -> DataFrame:
    """Distinct feature combinations with their ride count, money and scaled features."""
    points = cluster_features(rides).dropna(subset=FEATURES).groupBy(*FEATURES).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(cents(F.col("ride_cost_cad"))).alias("cents"),
        F.count("ride_cost_cad").alias("priced"),
    )
    return with_moments(points, F.col("n")).select(
        *FEATURES, millis(F.col("duration_min")).alias("duration_ms"), "n", "cents", "priced",
        *[scaled(f).alias(f"z_{f}") for f in FEATURES],
    )


RESTARTS, FINAL_RESTARTS = 10, 20
# The grid of points is far smaller than the rides it came from; tasks are sized to it.
POINTS_PER_TASK = 4_000


def cached_points(rides: DataFrame) -> DataFrame:
    """The points, written to the shared folder and kept in few partitions; unpersist them."""
    path = scratch_dir(rides.sparkSession, "cluster_points")
    weighted_points(rides).write.parquet(path)
    points = rides.sparkSession.read.parquet(path)
    return points.repartition(points.count() // POINTS_PER_TASK + 1, *FEATURES).persist(StorageLevel.MEMORY_AND_DISK)


def space_of(points: DataFrame) -> lloyd.Space:
    """The scaled space of the points: one row of deviations reaches the driver."""
    moments = feature_moments(points, F.col("n")).first()
    return lloyd.Space(tuple(WHOLE), tuple(UNITS), tuple(float(moments[f"std_{f}"] or 0.0) for f in FEATURES))


@until_as_of
def cluster_k_sweep(
    rides: DataFrame, ks: range = range(2, 8), n_init: int = RESTARTS, seed: int = 42
) -> DataFrame:
    """Inertia and silhouette per k over all rides, and which k is best. Without rides there
    are no rows."""
    points = cached_points(rides)
    space = space_of(points)
    best = lloyd.best_fits(points, space, list(ks), n_init, seed)
    scores = lloyd.silhouettes(points, space, list(best.values())) if best else []
    points.unpersist()
    rows = [(k, fit.cost / lloyd.MILLIONTHS, score) for (k, fit), score in zip(best.items(), scores)]
    result = rides.sparkSession.createDataFrame(rows, "k long, inertia double, silhouette double").select(
        "k", rnd(F.col("inertia"), 4).alias("inertia"), rnd(F.col("silhouette"), 6).alias("silhouette"))
    return result.withColumn(
        "is_best", F.col("silhouette") == F.max("silhouette").over(Window.partitionBy())
    ).orderBy("k")


def nearest_cluster(centres: list[tuple[int, list[float]]], spread: list[float]) -> Column:
    """Number of the nearest of a few centres to a row's features, the first one on ties."""
    def apart(centre: list[float]) -> Column:
        total = F.lit(0.0)
        for f, at, deviation in zip(FEATURES, centre, spread):
            if deviation:
                step = (F.col(f).cast("double") - F.lit(at)) / F.lit(deviation)
                total = total + step * step
        return total

    distances = F.array(*[apart(c) for _, c in centres])
    numbers = F.array(*[F.lit(number) for number, _ in centres])
    return F.element_at(numbers, F.array_position(distances, F.array_min(distances)).cast("int"))


@until_as_of
def clustered_points(rides: DataFrame, k: int = 4, n_init: int = FINAL_RESTARTS, seed: int = 42) -> DataFrame:
    """The points with the cluster of the best of ``n_init`` fits, that cluster's centre and
    the deviations that scale distances, written once. Centres, profiles, labels, persona
    means and the projection of one run all start from this table."""
    points = cached_points(rides)
    space = space_of(points)
    best = lloyd.best_fits(points, space, [k], n_init, seed)
    centres = [[float(v) for v in row] for row in best[k].centres] if best else [[0.0] * len(FEATURES)] * k
    own = nearest_cluster(list(enumerate(centres)), list(space.spread))
    placed = points.withColumn("cluster", own.cast("long"))
    by_cluster = [F.array(*[F.lit(c[i]) for c in centres]) for i in range(len(FEATURES))]
    path = scratch_dir(rides.sparkSession, "clustered_points")
    placed.select(
        "*",
        *[by_cluster[i][F.col("cluster").cast("int")].alias(f"centre_{f}") for i, f in enumerate(FEATURES)],
        *[F.lit(space.spread[i]).alias(f"std_{f}") for i, f in enumerate(FEATURES)],
    ).write.parquet(path)
    points.unpersist()
    return rides.sparkSession.read.parquet(path)


def cluster_centres(clustered: DataFrame) -> DataFrame:
    """Centre of each cluster in units of the features, its rides, and their mean squared
    scaled distance to it, from ``clustered_points``."""
    apart = F.lit(0.0)
    for f in FEATURES:
        step = F.coalesce(ratio(F.col(f) - F.col(f"centre_{f}"), F.col(f"std_{f}")), F.lit(0.0))
        apart = apart + step * step
    cost = F.floor(F.col("n") * apart * lloyd.MILLIONTHS + 0.5)
    return clustered.groupBy("cluster").agg(
        F.sum("n").alias("rides"), *[F.first(f"centre_{f}").alias(f) for f in FEATURES],
        F.sum(cost).alias("cost"),
    ).select(
        "cluster", "rides", *[rnd(F.col(f), 6).alias(f) for f in FEATURES],
        rnd(ratio(F.col("cost").cast("double") / lloyd.MILLIONTHS, F.col("rides")), 6).alias("mean_square"),
    ).orderBy("cluster")


def weighted_mean(feature: str) -> Column:
    return ratio(F.sum(F.col(feature) * F.col("n")), F.sum("n"))


def _profile(clustered: DataFrame) -> DataFrame:
    sums = clustered.groupBy("cluster").agg(
        F.sum("n").cast("long").alias("rides"),
        *[weighted_mean(f).alias(name) for f, name in [
            ("duration_min", "avg_duration"), ("hour_of_day", "avg_hour"), ("is_weekend", "pct_weekend"),
            ("is_summer", "pct_summer"), ("is_ebike", "pct_ebike"), ("is_peak_hr", "pct_peak_hr"),
        ]],
        ratio(money(F.sum("cents")), F.sum("priced")).alias("avg_cost"),
    )
    means = ["avg_duration", "avg_hour", "pct_weekend", "pct_summer", "pct_ebike", "pct_peak_hr", "avg_cost"]
    return sums.select(
        F.col("cluster").cast("long").alias("cluster"), "rides",
        *[rnd(F.col(m), 2).alias(m) for m in means],
        rnd(ratio(F.col("rides") * 100, F.sum("rides").over(Window.partitionBy())), 1).alias("pct_of_casual"),
    )


def cluster_profiles(clustered: DataFrame) -> DataFrame:
    """Means and shares per cluster, from ``clustered_points``."""
    return _profile(clustered).orderBy("cluster")


# The feature that names a persona, in order of naming.
NAMING = [
    (WEEKEND_EXPLORER, "pct_weekend"),
    (RELUCTANT_COMMUTER, "pct_peak_hr"),
    (SEASONAL_VISITOR, "pct_summer"),
    (EBIKE_ADOPTER, "pct_ebike"),
]


def _labels(profile: DataFrame) -> DataFrame:
    """Each persona goes to the cluster with the largest share of its feature (the first
    on ties); a later persona replaces an earlier one on the same cluster."""
    winners = profile.agg(*[
        F.max_by("cluster", F.struct(F.col(f), -F.col("cluster"))).alias(f"c{i}")
        for i, (_, f) in enumerate(NAMING)
    ])
    named = winners.select(F.inline(F.array(*[
        F.struct(F.col(f"c{i}").alias("cluster"), F.lit(i).alias("turn"), F.lit(name).alias("persona"))
        for i, (name, _) in enumerate(NAMING)
    ])))
    return named.groupBy("cluster").agg(F.max_by("persona", "turn").alias("persona"))


def cluster_labels(clustered: DataFrame) -> DataFrame:
    """Persona per cluster; clusters that win no feature stay without one."""
    profile = _profile(clustered)
    return profile.join(_labels(profile), "cluster", "left").select(
        "cluster", "persona", "rides", "pct_of_casual"
    ).orderBy("cluster")


def persona_feature_profile(clustered: DataFrame) -> DataFrame:
    """Six means per persona on a common 0 to 10 scale."""
    labels = _labels(_profile(clustered))
    return clustered.join(labels, clustered["cluster"] == labels["cluster"]).groupBy("persona").agg(
        F.sum("n").cast("long").alias("rides"),
        rnd(weighted_mean("duration_min") / 3.0, 4).alias("duration"),
        rnd(weighted_mean("hour_of_day") / 2.4, 4).alias("hour"),
        rnd(weighted_mean("is_weekend") * 10, 4).alias("weekend"),
        rnd(weighted_mean("is_summer") * 10, 4).alias("summer"),
        rnd(weighted_mean("is_ebike") * 10, 4).alias("ebike"),
        rnd(ratio(money(F.sum("cents")), F.sum("priced")), 4).alias("cost"),
    ).orderBy("persona")


@until_as_of
def cluster_projection(rides: DataFrame, clustered: DataFrame) -> DataFrame:
    """Every casual ride on the two principal components, with its cluster and persona and
    the share of variance that the components explain. Axes, centres and personas are a few
    numbers that the plan carries, so rides are read once and meet no other table; only the
    7 x 7 matrix of products and one row per cluster reach the driver."""
    points = clustered
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]
    z = [F.col(f"z_{f}") for f in FEATURES]
    products = points.agg(
        F.sum("n").alias("n"), *[F.sum(z[i] * z[j] * F.col("n")).alias(f"p{i}_{j}") for i, j in pairs]
    ).first()
    if not products["n"]:
        empty = "ride_id string, cluster long, persona string, pc1 double, pc2 double, pc1_variance_share double, pc2_variance_share double"
        return rides.sparkSession.createDataFrame([], empty)
    matrix = np.zeros((len(FEATURES), len(FEATURES)))
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = products[f"p{i}_{j}"] / products["n"]
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    share = values[order] / values.sum()

    clusters = clustered.groupBy("cluster").agg(
        *[F.first(f"centre_{f}").alias(f) for f in FEATURES], *[F.first(f"std_{f}").alias(f"std_{f}") for f in FEATURES],
    ).join(_labels(_profile(clustered)), "cluster", "left").orderBy("cluster").collect()
    spread = [clusters[0][f"std_{f}"] for f in FEATURES]
    own = nearest_cluster([(c["cluster"], [c[f] for f in FEATURES]) for c in clusters], spread)
    persona = F.lit(None).cast("string")
    for c in clusters:
        persona = F.when(F.col("cluster") == c["cluster"], F.lit(c["persona"]).cast("string")).otherwise(persona)

    def component(rank: int) -> Column:
        axis = vectors[:, order[rank]]
        axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
        total = z[0] * float(axis[0])
        for weight, column in zip(axis[1:], z[1:]):
            total = total + column * float(weight)
        return total

    moments = feature_moments(clustered, F.col("n")).first().asDict()
    known = F.struct(*[F.lit(float(v)).alias(name) for name, v in moments.items()])
    placed = cluster_features(rides).dropna(subset=FEATURES).withColumn("cluster", own.cast("long")).withColumn("m", known)
    scaled_rides = placed.select("ride_id", "cluster", persona.alias("persona"), *[scaled(f).alias(f"z_{f}") for f in FEATURES])
    return scaled_rides.select(
        "ride_id", "cluster", "persona", rnd(component(0), 6).alias("pc1"), rnd(component(1), 6).alias("pc2"),
        F.lit(round(float(share[0]), 6)).alias("pc1_variance_share"),
        F.lit(round(float(share[1]), 6)).alias("pc2_variance_share"),
    )
