"""Quality scores from a generalised additive model with pairwise interactions.

Every whole text becomes a few numbers (lengths, shares of letter classes, repetition). The
model is a lookup table per number and per chosen pair of numbers: round after round, one
shallow tree is fitted to the current gradient of each table's bins in turn and added with a
small step, so the effects share out what they explain. A score is the sum of the tables'
entries at the text's bins.

The numbers of all documents are computed in one pass and written; a bounded sample of
labelled training rows (SAMPLE) is fitted on the driver, and scoring reads the small table.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farewheel.llm.labelled import first_by_hash, held_out, training_labels
from farewheel.llm.shipping import on_workers
from farewheel.llm.staging import staged
from farewheel.llm.words import slices

SAMPLE = 20_000      # labelled rows that are fitted at most
BINS, PAIR_BINS, PAIRS = 32, 12, 8
ROUNDS, PAIR_ROUNDS, STEP = 200, 120, 0.1
RIDGE = 1.0          # added to every leaf's curvature
THRESHOLD = 0.3
MEASURES = (
    "words", "word_length", "upper", "digits", "points", "marks", "bars", "other_letters", "distinct", "line_words",
    "repeated_lines", "short_words", "commonest", "squeezed", "ends", "longest",
)
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_POINT, _MARK = b".,;:?!", b"#$%&*@^~=<>{}[]\\/+_"
_HIGH = bytes(range(128, 256))


def measures(text: str) -> list[float]:
    """The numbers of one text; all zero if it has no word."""
    import zstandard

    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(MEASURES)
    n, size = len(words), len(raw)
    share = lambda some: (size - len(raw.translate(None, some))) / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    common = Counter(words)
    return [
        math.log1p(n), sum(map(len, words)) / n, share(_UPPER), share(_DIGIT), share(_POINT), share(_MARK), share(b"|"), share(_HIGH),
        len(common) / n, n / len(lines), 1 - len(set(lines)) / len(lines), sum(len(w) <= 3 for w in words) / n,
        max(common.values()) / n, len(zstandard.compress(raw, 1)) / size, sum(w[-1] in b".!?" for w in words) / n,
        math.log1p(max(map(len, words))),
    ]


def _measured(batches):
    for batch in slices(batches):
        rows = [measures(t or "") for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "measures"])


def _best_split(g: np.ndarray, h: np.ndarray, low: int, high: int) -> tuple[float, int]:
    """Gain and place of the best cut of bins low..high-1."""
    if high - low < 2:
        return 0.0, low
    left_g, left_h = np.cumsum(g[low:high])[:-1], np.cumsum(h[low:high])[:-1]
    all_g, all_h = g[low:high].sum(), h[low:high].sum()
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE) - all_g**2 / (all_h + RIDGE)
    at = int(gain.argmax())
    return float(gain[at]), low + at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values per bin of a tree with up to four leaves."""
    cuts = {0, len(g)}
    _, first = _best_split(g, h, 0, len(g))
    for low, high in ((0, first), (first, len(g))):
        gain, at = _best_split(g, h, low, high)
        cuts |= {first, at} if gain > 0 else {first}
    out, edges = np.zeros(len(g)), sorted(cuts)
    for a, b in zip(edges, edges[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values on a grid: the better first axis is cut once, each side across it."""
    def grown(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        total, first = _best_split(g.sum(1), h.sum(1), 0, len(g))
        out = np.zeros_like(g)
        for rows in (slice(0, first), slice(first, len(g))):
            if rows.start == rows.stop:
                continue
            side_g, side_h = g[rows].sum(0), h[rows].sum(0)
            gain, at = _best_split(side_g, side_h, 0, len(side_g))
            total += gain
            for columns in (slice(0, at), slice(at, None)):
                out[rows, columns] = side_g[columns].sum() / (side_h[columns].sum() + RIDGE)
        return total, out
    one, two = grown(g, h), grown(g.T, h.T)
    return one[1] if one[0] >= two[0] else two[1].T


@dataclass
class AdditiveModel:
    """Lookup tables over binned features."""

    intercept: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    @staticmethod
    def _edges(x: np.ndarray, bins: int) -> list[np.ndarray]:
        return [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]

    @staticmethod
    def _bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(edges, x.T)], 1)

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> AdditiveModel:
        """A constant model if there are no rows or only one label."""
        rate = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        own = cls(math.log(rate / (1 - rate)))
        if len(set(y.tolist())) < 2:
            return own
        own.edges, own.pair_edges = cls._edges(x, BINS), cls._edges(x, PAIR_BINS)
        bins, coarse = cls._bins(x, own.edges), cls._bins(x, own.pair_edges)
        own.tables = [np.zeros(len(e) + 1) for e in own.edges]
        logit = np.full(len(y), own.intercept)

        def slope(flat: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-logit))
            return np.bincount(flat, y - p, size), np.bincount(flat, p * (1 - p), size)

        for _ in range(ROUNDS):
            for f, table in enumerate(own.tables):
                add = STEP * shallow_tree(*slope(bins[:, f], len(table)))
                table += add
                logit += add[bins[:, f]]
        gains = []
        for i, j in combinations(range(x.shape[1]), 2):
            shape = len(own.pair_edges[i]) + 1, len(own.pair_edges[j]) + 1
            flat = coarse[:, i] * shape[1] + coarse[:, j]
            g, h = (a.reshape(shape) for a in slope(flat, shape[0] * shape[1]))
            values = pair_tree(g, h)
            gains.append((float((g * values).sum()), i, j, shape, flat))
        chosen = sorted(gains, key=lambda t: -t[0])[:PAIRS]
        own.pairs = [(i, j, np.zeros(shape)) for _, i, j, shape, _ in chosen]
        for _ in range(PAIR_ROUNDS):
            for (_, _, table), (_, _, _, shape, flat) in zip(own.pairs, chosen):
                add = STEP * pair_tree(*(a.reshape(shape) for a in slope(flat, shape[0] * shape[1])))
                table += add
                logit += add.ravel()[flat]
        return own

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        if self.tables:
            bins, coarse = self._bins(x, self.edges), self._bins(x, self.pair_edges)
            for f, table in enumerate(self.tables):
                logit += table[bins[:, f]]
            for i, j, table in self.pairs:
                logit += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-logit))


@on_workers
def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the numbers of every whole text, written once."""
    return staged(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_measured, "doc_id long, measures array<double>"), "measures")


def fit_quality(numbers: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> AdditiveModel:
    rows = first_by_hash(numbers.join(training_labels(labels, "quality"), "doc_id"), sample).select("measures", "label").toPandas()
    x = np.array(rows["measures"].tolist(), float).reshape(-1, len(MEASURES))
    return AdditiveModel.fit(x, rows["label"].to_numpy(float))


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    Only texts are looked at. A null text counts as empty, and texts without words share one
    score. Repeated rows are scored alike; a row without doc_id is scored, never trained on.
    Without labels of both kinds every score is the same.
    """
    numbers = measured(docs)
    model = fit_quality(numbers, labels, sample)

    def run(batches):
        for batch in batches:
            x = np.array(batch.column("measures").to_pylist(), float).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])
    scored = numbers.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
