import numpy as np
import pytest
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler

from farewheel.operators import clustering, exploration, lloyd
from farewheel.plans.registry import open_tables
from paths import SMALL

MINUTES = [3.0, 61.5, 12.4, 12.4, 29.9, 45.0, 0.5, 90.0]


@pytest.fixture(scope="module")
def rides(build):
    return build.rides(*[(1, "2023-07-08T08:00", m) for m in MINUTES])


def test_stats_match_numpy(rides):
    row = exploration.duration_stats(rides).collect()[0]
    want = [len(MINUTES), np.mean(MINUTES), np.median(MINUTES), np.std(MINUTES, ddof=1), *np.percentile(MINUTES, [25, 75, 95])]
    got = [row["count"], row["mean"], row["median"], row["std"], row["p25"], row["p75"], row["p95"]]
    assert got == pytest.approx(want, abs=0.0051)


def test_histogram_matches_numpy(rides):
    rows = {r.bin: r for r in exploration.duration_histogram(rides, bins=7).collect()}
    counts, edges = np.histogram(np.clip(MINUTES, 0, 60), bins=7)
    density, _ = np.histogram(np.clip(MINUTES, 0, 60), bins=7, density=True)
    assert {i: int(c) for i, c in enumerate(counts) if c} == {b: r.rides for b, r in rows.items()}
    for b, r in rows.items():
        assert r.density == pytest.approx(density[b], abs=1e-6) and r.bin_start == pytest.approx(edges[b], abs=1e-6)


def test_histogram_of_one_value(build):
    row = exploration.duration_histogram(build.rides((1, "2023-07-08T08:00", 5.0))).collect()[0]
    assert (row.bin, row.rides, row.density) == (0, 1, None)


def test_box_whiskers(rides):
    row = exploration.duration_box(rides).collect()[0]
    clipped = np.clip(MINUTES, 0, 60)
    assert (row.q1, row.median, row.q3) == pytest.approx(tuple(np.percentile(clipped, [25, 50, 75])), abs=0.006)
    assert (row.whisker_low, row.whisker_high, row.outliers) == (0.5, 60.0, 0)


def test_shares_sum_to_100(spark):
    rows = exploration.category_share(open_tables(spark, SMALL).rides).collect()
    for dimension in ("user_type", "bike_type"):
        assert sum(r.pct for r in rows if r.dimension == dimension) == pytest.approx(100)


def test_missing_rider_type_is_zero_filled(rides):
    row = exploration.rides_by_weekday(rides).collect()[0]
    assert (row.day_no, row.day_name, row.annual_member, row.casual_member) == (6, "Saturday", 0, len(MINUTES))


@pytest.fixture(scope="module")
def clustered(spark):
    """The registered fit: its own restarts and iterations."""
    return clustering.clustered_points(open_tables(spark, SMALL).rides)


def test_profile_covers_all_rides(spark, clustered):
    rows = clustering.cluster_profiles(clustered).collect()
    table = open_tables(spark, SMALL).rides
    assert rows == clustering.cluster_profiles(clustering.clustered_points(table)).collect()
    assert sum(r.rides for r in rows) == table.filter("user_type = 'Casual Member'").count()
    assert sum(r.pct_of_casual for r in rows) == pytest.approx(100, abs=0.3)
    labels = {r.cluster: r.persona for r in clustering.cluster_labels(clustered).collect()}
    assert set(labels) == {r.cluster for r in rows}
    means = clustering.persona_feature_profile(clustered).collect()
    assert sum(r.rides for r in means) <= sum(r.rides for r in rows)


def test_points_are_at_their_nearest_centre(clustered):
    rows = clustered.collect()
    x = np.array([[r[f"z_{f}"] for f in clustering.FEATURES] for r in rows])
    n, own = np.array([r.n for r in rows]), np.array([r.cluster for r in rows])
    centres = np.array([np.average(x[own == c], axis=0, weights=n[own == c]) for c in range(4)])
    distance = ((x[:, None] - centres[None]) ** 2).sum(2)
    # at convergence the means of the clusters are the centres that the points were dealt to
    assert np.average(distance.argmin(1) == own, weights=n) > 0.999


@pytest.fixture(scope="module")
def points(spark):
    points = clustering.cached_points(open_tables(spark, SMALL).rides)
    yield points
    points.unpersist()


def test_more_restarts_and_clusters_cost_no_more(spark, points):
    space = clustering.space_of(points)
    one, many = (lloyd.best_fits(points, space, [4], n, 42)[4].cost for n in (1, clustering.FINAL_RESTARTS))
    assert many <= one
    sweep = clustering.cluster_k_sweep(open_tables(spark, SMALL).rides).collect()
    inertia = [r.inertia for r in sweep]
    assert inertia == sorted(inertia, reverse=True)
    assert sum(r.is_best for r in sweep) == 1


def test_fit_is_as_good_as_the_library_and_scored_alike(points):
    space = clustering.space_of(points)
    fits = lloyd.best_fits(points, space, [3, 4], clustering.RESTARTS, 42)
    vectors = VectorAssembler(inputCols=[f"z_{f}" for f in clustering.FEATURES], outputCol="features").transform(points)
    evaluator = ClusteringEvaluator(weightCol="n", metricName="silhouette")
    for (k, fit), score in zip(fits.items(), lloyd.silhouettes(points, space, list(fits.values()))):
        other = min(KMeans(k=k, seed=s, weightCol="n").fit(vectors).summary.trainingCost for s in range(3))
        assert fit.cost / lloyd.MILLIONTHS <= other * 1.01
        own = clustering.nearest_cluster(list(enumerate(fit.centres.tolist())), list(space.spread))
        assert score == pytest.approx(evaluator.evaluate(vectors.withColumn("prediction", own)), abs=1e-4)


def test_fit_does_not_depend_on_how_points_are_dealt(points):
    space = clustering.space_of(points)
    one, other = (lloyd.best_fits(points.repartition(parts, "month"), space, [5], 3, 42)[5] for parts in (1, 7))
    assert (one.centres == other.centres).all() and (one.sums == other.sums).all()


def test_fits_of_odd_tables(spark, build):
    same = build.rides(*[(1, "2023-07-08T08:00", 5.0)] * 3)
    sweep = clustering.cluster_k_sweep(same, range(2, 4), 2).collect()
    assert [(r.inertia, r.silhouette) for r in sweep] == [(0.0, 0.0), (0.0, 0.0)]
    placed = clustering.clustered_points(same)
    assert [(r.cluster, r.rides, r.mean_square) for r in clustering.cluster_centres(placed).collect()] == [(0, 3, 0.0)]
    none = same.limit(0)
    assert clustering.cluster_k_sweep(none, range(2, 4), 2).count() == 0
    empty = clustering.clustered_points(none)
    assert clustering.cluster_centres(empty).count() == 0
    assert clustering.cluster_projection(none, empty).count() == 0


def test_weighted_points_stand_for_all_rides(spark):
    table = open_tables(spark, SMALL).rides
    points = clustering.weighted_points(table).collect()
    rows = np.array([[r[f"z_{f}"] for f in clustering.FEATURES] for r in points])
    n = np.array([r.n for r in points])
    assert n.sum() == table.filter("user_type = 'Casual Member'").count()
    assert (rows * n[:, None]).sum(0) == pytest.approx(np.zeros(7), abs=1e-6)
    assert (rows**2 * n[:, None]).sum(0) / n.sum() == pytest.approx(np.ones(7))


def test_projection_matches_numpy(spark, clustered):
    table = open_tables(spark, SMALL).rides
    scaled = clustering.feature_scaling(table).select(*clustering.FEATURES).toPandas().to_numpy()
    values = np.sort(np.linalg.eigvalsh(np.cov(scaled.T, ddof=0)))[::-1]
    rows = clustering.cluster_projection(table, clustered).collect()
    assert len(rows) == len(scaled)
    assert {r.cluster for r in rows} == {0, 1, 2, 3}
    row = rows[0]
    assert row.pc1_variance_share == pytest.approx(values[0] / values.sum(), abs=1e-4)
    assert row.pc2_variance_share == pytest.approx(values[1] / values.sum(), abs=1e-4)


def test_later_persona_replaces_earlier_on_the_same_cluster(spark):
    profile = spark.createDataFrame(
        [(0, 0.9, 0.8, 0.1, 0.2), (1, 0.1, 0.1, 0.9, 0.1), (2, 0.0, 0.0, 0.0, 0.9), (3, 0.0, 0.0, 0.0, 0.0)],
        "cluster long, pct_weekend double, pct_peak_hr double, pct_summer double, pct_ebike double")
    labels = {r.cluster: r.persona for r in clustering._labels(profile).collect()}
    assert labels == {0: "Reluctant Commuter", 1: "Seasonal Visitor", 2: "E-bike Adopter"}
