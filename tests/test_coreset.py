"""Coresets against the rides they stand for."""

import numpy as np
import pytest

from farewheel.operators import coreset, lloyd
from farewheel.plans.registry import open_tables
from paths import SMALL


@pytest.fixture(scope="module")
def points(spark):
    points = coreset.continuous_features(open_tables(spark, SMALL).rides).persist()
    yield points
    points.unpersist()


@pytest.fixture(scope="module")
def space(points):
    return coreset.space_of(points)


def rows(df):
    table = df.toArrow()
    return table.column("n").to_numpy().astype(float), np.stack([table.column(c).to_numpy() for c in coreset.COLUMNS], 1)


def cost(space, weight, whole, centres):
    return (weight * space.squares(whole / np.array(space.units), centres).min(1)).sum()


@pytest.mark.parametrize("parts", [1, 20])
def test_cost_of_any_centres_stays_within_a_tenth(points, space, parts):
    n, whole = rows(points)
    small = coreset.coreset(points.repartition(parts), space, size=600, leaf=1000)
    weight, kept = rows(small)
    weight = weight / coreset.WEIGHT
    assert len(weight) <= 600 < len(n)
    assert weight.sum() == pytest.approx(len(n), rel=1e-3)
    draw = np.random.default_rng(7)
    for k in (2, 4, 7):
        for _ in range(5):
            centres = whole[draw.choice(len(n), k, replace=False)] / np.array(space.units)
            assert cost(space, weight, kept, centres) == pytest.approx(cost(space, n, whole, centres), rel=0.1)


def test_fit_on_the_coreset_costs_little_more(points, space):
    exact = lloyd.best_fits(points, space, [4], 10, 42)[4].cost / lloyd.MILLIONTHS
    centres = lloyd.best_fits(coreset.coreset(points, space, 600, 1000), space, [4], 10, 42)[4].centres
    assert cost(space, *rows(points), centres) <= exact * 1.05


def test_few_rides_are_kept_as_they_are(spark, build):
    few = coreset.continuous_features(build.rides(*[(1, "2023-07-08T08:00", m) for m in (3.0, 9.5, 9.5, 61.0)]))
    weight, whole = rows(coreset.coreset(few, coreset.space_of(few)))
    assert sorted(whole[:, 0].repeat((weight / coreset.WEIGHT).astype(int))) == [180_000, 570_000, 570_000, 3_660_000]


def test_equal_rides_and_no_rides(spark, build):
    same = build.rides(*[(1, "2023-07-08T08:00", 5.0)] * 50)
    found = coreset.cluster_continuous(same, size=30).collect()
    assert [(r.cluster, r.rides, r.duration_min, r.mean_square) for r in found] == [(0, 50, 5.0, 0.0)]
    assert coreset.cluster_continuous(same.limit(0)).count() == 0


def test_all_rides_are_counted(spark):
    rides = open_tables(spark, SMALL).rides
    found = coreset.cluster_continuous(rides, n_init=2).collect()
    assert sum(r.rides for r in found) == rides.filter("user_type = 'Casual Member'").count()
