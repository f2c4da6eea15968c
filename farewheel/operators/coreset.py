"""k-means on continuous features through a coreset, so that the points of a fit stay bounded.

Times to the second and durations to the millisecond hardly repeat, so equal rides cannot be
merged into points as ``clustering.py`` does. Instead every task reads its rides once and keeps
a tree of samples: ``LEAF`` rides are reduced to ``SIZE`` weighted ones, two samples of one
level are merged and reduced to one of the next. The tasks' samples are merged and reduced
``FAN`` at a time until one is left. No ride is shuffled, and no task holds more than
``LEAF`` rides and a sample per level.

A sample is drawn by sensitivity: a ride's share of the cost around rough centres, plus its
share of its rough cluster. Weights are scaled so that every rough cluster keeps its weight.
The cost of any few centres on the coreset stays near their cost on all rides (tests hold it
within a tenth); counts and costs that are reported come from all rides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from farewheel.functions.columns import is_weekend, millis, ratio, rnd
from farewheel.functions.horizon import until_as_of
from farewheel.operators import lloyd
from farewheel.operators.exploration import casual_only
from farewheel.params import EBIKE
from farewheel.sources.storage import scratch_dir

# executors get this module with the tasks and need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAF, SIZE, FAN = 8192, 2048, 16
ROUGH = 24        # rough centres, some times the clusters that are asked for
WEIGHT = 1000     # weights are whole thousandths of a ride

# Feature name, whole-number column, units of it in one unit of the feature.
CONTINUOUS = [
    ("duration_min", "duration_ms", 60_000.0), ("hour_of_day", "second_of_day", 3600.0),
    ("is_weekend", "is_weekend", 1.0), ("is_ebike", "is_ebike", 1.0), ("day_of_year", "day_of_year", 1.0),
]
COLUMNS = [column for _, column, _ in CONTINUOUS]


def continuous_features(rides: DataFrame) -> DataFrame:
    """Casual rides as whole numbers, each of weight 1; rides without one of them take no part."""
    started = F.col("started_at")
    second = F.hour(started) * 3600 + F.minute(started) * 60 + F.second(started)
    return casual_only(rides).select(
        F.lit(1).cast("long").alias("n"), millis(F.col("duration_min")).alias("duration_ms"), second.cast("long").alias("second_of_day"),
        is_weekend(started).cast("long").alias("is_weekend"), (F.col("bike_type") == EBIKE).cast("long").alias("is_ebike"),
        F.dayofyear(started).cast("long").alias("day_of_year"),
    ).dropna()


def reduced(weight: np.ndarray, whole: np.ndarray, space: lloyd.Space, size: int, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """At most ``size`` weighted rows that stand for the given ones; as many rows as that, or
    fewer, stay as they are."""
    if len(weight) <= size:
        return weight, whole
    draw = np.random.default_rng(seed)
    x = whole / np.array(space.units)
    total = weight.sum()
    chosen = [int(draw.choice(len(x), p=weight / total))]
    near, own = space.squares(x, x[chosen])[:, 0], np.zeros(len(x), np.int64)
    while len(chosen) < ROUGH and (mass := weight * near).sum() > 0:
        chosen.append(int(draw.choice(len(x), p=mass / mass.sum())))
        distance = space.squares(x, x[chosen[-1:]])[:, 0]
        own = np.where(distance < near, len(chosen) - 1, own)
        near = np.minimum(near, distance)
    held = np.bincount(own, weight, len(chosen))
    cost = (weight * near).sum()
    share = weight / held[own] / len(chosen) + (weight * near / cost if cost else 0.0)
    share /= share.sum()
    # a row of every rough cluster goes in, so that each can keep its weight
    room = size - len(chosen)
    picked = np.concatenate([draw.choice(len(x), room, p=share), chosen])
    given = np.concatenate([weight[picked[:room]] / share[picked[:room]] / max(room, 1), np.full(len(chosen), 1e-9)])
    kept = np.bincount(own[picked], given, len(chosen))
    given *= np.where(kept > 0, held / np.where(kept > 0, kept, 1), 0)[own[picked]]
    rows, place = np.unique(picked, return_inverse=True)
    return np.bincount(place, given, len(rows)), whole[rows]


class Tree:
    """Samples by level; two of one level make one of the next."""

    def __init__(self, space: lloyd.Space, size: int, seed: int):
        self.space, self.size, self.seed, self.levels, self.drawn = space, size, seed, {}, 0

    def _reduce(self, parts: list) -> tuple[np.ndarray, np.ndarray]:
        self.drawn += 1
        weight, whole = (np.concatenate([p[i] for p in parts]) for i in range(2))
        return reduced(weight, whole, self.space, self.size, [self.seed, self.drawn])

    def add(self, weight: np.ndarray, whole: np.ndarray) -> None:
        sample, level = self._reduce([(weight, whole)]), 0
        while level in self.levels:
            sample = self._reduce([self.levels.pop(level), sample])
            level += 1
        self.levels[level] = sample

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        return self._reduce(list(self.levels.values())) if self.levels else (np.zeros(0), np.zeros((0, len(self.space.columns)), np.int64))


def _table(part: int, weight: np.ndarray, whole: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.full(len(weight), part, np.int64)), pa.array(weight), *(pa.array(whole[:, i]) for i in range(whole.shape[1]))],
                    names=["part", "weight", *COLUMNS])


_SCHEMA = "part long, weight double, " + ", ".join(f"{c} long" for c in COLUMNS)


def coreset(points: DataFrame, space: lloyd.Space, size: int = SIZE, leaf: int = LEAF) -> DataFrame:
    """At most ``size`` rows with n in thousandths of a ride, written once."""
    spark, path = points.sparkSession, scratch_dir(points.sparkSession, "coreset")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tree, waiting, rows = Tree(space, size, part), [], 0
        for batch in batches:
            n, whole, _ = space.read(batch)
            for at in range(0, len(n), leaf):
                waiting.append((n[at:at + leaf].astype(float), whole[at:at + leaf]))
                rows += len(waiting[-1][0])
                if rows >= leaf:
                    tree.add(*(np.concatenate([w[i] for w in waiting]) for i in range(2)))
                    waiting, rows = [], 0
        if rows:
            tree.add(*(np.concatenate([w[i] for w in waiting]) for i in range(2)))
        yield from _table(part, *tree.result()).to_batches()

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        part = key[0].as_py()
        # the order of fetched rows differs from run to run, the draw must not
        rows = rows.sort_by([(c, "ascending") for c in ["part", *COLUMNS]])
        whole = np.stack([rows.column(c).to_numpy() for c in COLUMNS], 1)
        return _table(part, *reduced(rows.column("weight").to_numpy(), whole, space, size, [part, rows.num_rows]))

    points.select("n", *COLUMNS).mapInArrow(first, _SCHEMA).write.parquet(f"{path}/tasks")
    level = spark.read.parquet(f"{path}/tasks")
    last = level.agg(F.max("part")).first()[0] or 0
    while True:
        last //= FAN
        level = level.groupBy(F.expr(f"part div {FAN}").alias("into")).applyInArrow(merge, _SCHEMA)
        if not last:
            break
    whole = F.greatest(F.round(F.col("weight") * WEIGHT), F.lit(1)).cast("long")
    level.select(whole.alias("n"), *COLUMNS).write.parquet(f"{path}/whole")
    return spark.read.parquet(f"{path}/whole")


def space_of(points: DataFrame) -> lloyd.Space:
    """Deviations of the features over all rides, to nine digits."""
    def deviation(column: str, unit: float) -> Column:
        return F.round(F.stddev_pop(F.col(column) / unit), 9).alias(column)

    row = points.agg(*[deviation(c, unit) for _, c, unit in CONTINUOUS]).first()
    return lloyd.Space(tuple(COLUMNS), tuple(u for _, _, u in CONTINUOUS), tuple(float(row[c] or 0.0) for c in COLUMNS))


@until_as_of
def cluster_continuous(rides: DataFrame, k: int = 4, n_init: int = 10, seed: int = 42, size: int = SIZE) -> DataFrame:
    """Clusters of the casual rides on continuous features: means, rides, share and mean squared
    scaled distance to the centre over all rides, for centres fitted on the coreset. Clusters
    that no ride is nearest to are left out; without rides there are no rows."""
    points = continuous_features(rides)
    space = space_of(points)
    best = lloyd.best_fits(coreset(points, space, size), space, [k], n_init, seed)
    rows = []
    if best:
        for cluster, sums in enumerate(lloyd.members(points, space, [best[k].centres])[0].tolist()):
            rows.append((cluster, *sums))
    sums = rides.sparkSession.createDataFrame(
        rows, "cluster long, rides long, " + ", ".join(f"{c} long" for c in COLUMNS) + ", cost long").filter("rides > 0")
    return sums.select(
        "cluster", "rides", *[rnd(ratio(F.col(c), F.col("rides")) / unit, 4).alias(f) for f, c, unit in CONTINUOUS],
        rnd(ratio(F.col("cost") / lloyd.MILLIONTHS, F.col("rides")), 6).alias("mean_square"),
    ).orderBy("cluster")
