"""Many k-means runs over the same weighted points, one Spark job per round for all of them.

Tasks add up whole numbers only: features in whole units, distances in millionths. Sums are
therefore the same however the points are dealt to tasks, and so are centres, costs and the
choice of the best run. What a task returns, and what the driver holds, is one row per run and
cluster.

A run starts from the points with the smallest digest for its number, ends when no centre
moves by more than ``TOLERANCE`` deviations, and leaves an empty cluster's centre in place.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

# executors get this module with the tasks and need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TOLERANCE = 1e-4
MOST_ROUNDS = 300
MILLIONTHS = 1e6
BLOCK = 2048   # points whose distances to all centres are held at once


@dataclass(frozen=True)
class Space:
    """Whole-number columns, units per feature unit, and the deviation of each feature."""
    columns: tuple[str, ...]
    units: tuple[float, ...]
    spread: tuple[float, ...]

    def squares(self, x: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Squared scaled distance of each row of ``x`` to each centre, added feature by
        feature; a constant feature adds nothing."""
        total = np.zeros((len(x), len(centres)))
        for f, spread in enumerate(self.spread):
            if spread:
                apart = (x[:, f, None] - centres[None, :, f]) / spread
                total += apart * apart
        return total

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rides, whole-number features and features of a batch of points."""
        whole = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in self.columns], 1)
        return batch.column("n").to_numpy(zero_copy_only=False), whole, whole / np.array(self.units)


def _millionths(values: np.ndarray) -> np.ndarray:
    return np.floor(values * MILLIONTHS + 0.5).astype(np.int64)


def _sums(points: DataFrame, space: Space, runs: list[np.ndarray], add, width: int) -> np.ndarray:
    """For each run and cluster the sums of the whole-number rows that ``add`` yields for a
    block of points: (run, its cluster of each point, values by column)."""
    ends = np.cumsum([0] + [len(c) for c in runs])
    names = [f"s{i}" for i in range(width)]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((ends[-1], width), np.int64)
        for batch in batches:
            n, whole, x = space.read(batch)
            for at in range(0, len(n), BLOCK):
                b = slice(at, at + BLOCK)
                for run, own, values in add(n[b], whole[b], x[b]):
                    for i, column in enumerate(values):
                        np.add.at(out[ends[run]:ends[run + 1], i], own, column)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(ends[-1]))] + [pa.array(out[:, i]) for i in range(width)], ["row", *names])

    parts = points.select("n", *space.columns).mapInArrow(partial, "row long, " + ", ".join(f"{s} long" for s in names))
    total = np.zeros((ends[-1], width), np.int64)
    for r in parts.groupBy("row").agg(*[F.sum(s).alias(s) for s in names]).collect():
        total[r["row"]] = [r[s] for s in names]
    return total


def starts(points: DataFrame, space: Space, ks: list[int], n_init: int, seed: int) -> dict[tuple[int, int], np.ndarray]:
    """First centres of every run: for each slot the point whose digest with seed, run and
    slot is smallest. Runs of one number share their slots over all k."""
    draw = F.explode(F.sequence(F.lit(0), F.lit(n_init * max(ks) - 1)))
    drawn = points.select(*space.columns, draw.alias("draw")).withColumn(
        "digest", F.md5(F.concat_ws("|", F.lit(seed), F.expr(f"draw div {max(ks)}"), F.expr(f"draw % {max(ks)}"), *space.columns)))
    first = drawn.groupBy("draw").agg(F.min_by(F.struct(*space.columns), "digest").alias("point")).collect()
    at = {r["draw"]: np.array(r["point"], np.int64) / np.array(space.units) for r in first}
    return {(k, run): np.stack([at[run * max(ks) + slot] for slot in range(k)]) for k in ks for run in range(n_init)} if at else {}


def _nearest(space: Space, runs: list[np.ndarray], x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(run, nearest cluster, squared distance) of each point; ties go to the first cluster."""
    distance = space.squares(x, np.concatenate(runs))
    at = 0
    for run, centres in enumerate(runs):
        own = distance[:, at:at + len(centres)].argmin(1)
        yield run, own, distance[np.arange(len(x)), at + own]
        at += len(centres)


def members(points: DataFrame, space: Space, runs: list[np.ndarray]) -> list[np.ndarray]:
    """Per run and cluster: rides, sum of each whole-number feature, cost in millionths."""
    def add(n, whole, x):
        for run, own, distance in _nearest(space, runs, x):
            yield run, own, [n, *(whole[:, f] * n for f in range(whole.shape[1])), _millionths(n * distance)]
    return np.split(_sums(points, space, runs, add, len(space.columns) + 2), np.cumsum([len(c) for c in runs])[:-1])


def means(space: Space, sums: np.ndarray, empty: np.ndarray) -> np.ndarray:
    """Centres of gravity; a cluster without rides stays where ``empty`` has it."""
    n = sums[:, :1].astype(float)
    moved = sums[:, 1:1 + len(space.columns)].astype(float) / np.where(n == 0, 1, n) / np.array(space.units)
    return np.where(n == 0, empty, moved)


@dataclass(frozen=True)
class Fit:
    centres: np.ndarray
    sums: np.ndarray      # what ``members`` gives for the centres

    @property
    def cost(self) -> int:
        return int(self.sums[:, -1].sum())


def best_fits(points: DataFrame, space: Space, ks: list[int], n_init: int, seed: int) -> dict[int, Fit]:
    """For each k the run of least cost among ``n_init``, the first of equal ones."""
    centres = starts(points, space, ks, n_init, seed)
    live = list(centres)
    for _ in range(MOST_ROUNDS):
        if not live:
            break
        moving = []
        for key, sums in zip(live, members(points, space, [centres[key] for key in live])):
            new = means(space, sums, centres[key])
            if np.diagonal(space.squares(new, centres[key])).max() > TOLERANCE * TOLERANCE:
                moving.append(key)
            centres[key] = new
        live = moving
    best: dict[int, Fit] = {}
    if centres:
        for (k, _), sums, c in zip(centres, members(points, space, list(centres.values())), centres.values()):
            fit = Fit(c, sums)
            if k not in best or fit.cost < best[k].cost:
                best[k] = fit
    return best


def silhouettes(points: DataFrame, space: Space, fits: list[Fit]) -> list[float]:
    """Mean silhouette of all rides by squared distance: a ride's mean distance to a cluster
    is its distance to the cluster's mean plus the cluster's mean spread, so two rounds do."""
    runs = [f.centres for f in fits]
    middle = [means(space, f.sums, np.full_like(f.centres, np.nan)) for f in fits]

    def spread(n, whole, x):
        for run, own, _ in _nearest(space, runs, x):
            yield run, own, [_millionths(n * space.squares(x, middle[run])[np.arange(len(x)), own])]
    around = np.split(_sums(points, space, runs, spread, 1)[:, 0], np.cumsum([len(c) for c in runs])[:-1])
    rides = [f.sums[:, 0].astype(float) for f in fits]
    around = [a / MILLIONTHS / np.where(n == 0, 1, n) for a, n in zip(around, rides)]

    def score(n, whole, x):
        for run, own, _ in _nearest(space, runs, x):
            row, size = np.arange(len(x)), rides[run][own]
            apart = space.squares(x, middle[run]) + around[run]
            inside = apart[row, own] * size / np.where(size == 1, 1, size - 1)
            apart[row, own] = np.nan
            outside = np.nanmin(np.where(np.isnan(apart), np.inf, apart), axis=1)
            most = np.maximum(inside, outside)
            value = np.where((size == 1) | (most == 0) | np.isinf(outside), 0.0, (outside - inside) / np.where(most == 0, 1, most))
            yield run, np.zeros(len(x), np.int64), [_millionths(n * np.where(np.isfinite(value), value, 0.0))]
    total = np.split(_sums(points, space, runs, score, 1)[:, 0], np.cumsum([len(c) for c in runs])[:-1])
    return [float(t[0] / MILLIONTHS / n.sum()) for t, n in zip(total, rides)]
