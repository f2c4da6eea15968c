"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; the unlabelled texts are a sample of all training
documents, positives among them, whatever their labels say: the corrected risk takes the toxic
share out of them and needs it to be there. A linear classifier over words and word beginnings is trained with
numpy on the class-prior-corrected risk: prior * R+(P) + max(0, R-(U) - prior * R-(P)). When
the corrected negative part falls below zero, the step goes back against it, which keeps the
model from calling the unlabelled toxic texts clean.

Features are 64-bit hashes, so no two words share a weight. A bounded sample (POSITIVES,
UNLABELLED) goes to the driver; every whole text is scored in one pass without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farewheel.llm.labelled import first_by_hash, held_out, training_labels
from farewheel.llm.shipping import on_workers
from farewheel.llm.words import hash_words, lower_ascii, slices, text_buffer

POSITIVES, UNLABELLED = 3000, 9000   # training documents at most
LEAST = 5            # positives that must hold a feature
TIMES = 2.0          # how much commoner a feature must be among positives
FEATURES = 50_000    # weights at most
STEPS, RATE, RIDGE = 600, 0.05, 1.5e-4
PREFIX = 4           # bytes of a word beginning
THRESHOLD = 0.5
_PREFIX_MARK = np.uint64(0xA24BAED4963EE407)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row number and hash of each word and word beginning; repeated ones are not removed."""
    data, offsets = text_buffer(column)
    words = hash_words(lower_ascii(data), offsets, PREFIX)
    row = words.rows()
    # punctuation at the end of a word hides it from the whole-word hash, not from the beginning
    return np.concatenate([row, row]), np.concatenate([words.hash, words.prefix ^ _PREFIX_MARK])


def _distinct(batches):
    for batch in slices(batches):
        row, value = features(batch.column("text"))
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        row, value = row[first], value[first]
        parts = np.split(value, np.searchsorted(row, np.arange(1, batch.num_rows)))
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array([p.tobytes() for p in parts], pa.binary())], ["positive", "features"])


def without_copies(docs: list[np.ndarray], width: int = 6) -> list[np.ndarray]:
    """The documents that share none of two min-hash bands with an earlier one: families of
    near copies would make their chance words look like evidence. Empty ones stay."""
    seen: set[tuple] = set()
    kept = []
    for d in docs:
        marks = [(i, *np.sort(d * np.uint64(m))[:width].tolist()) for i, m in enumerate((1, 0x9E3779B97F4A7C15))] if len(d) else []
        if not seen.intersection(marks):
            kept.append(d)
        seen.update(marks)
    return kept


class PuModel:
    """Sorted feature hashes, their weights and a bias."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float):
        self.keys, self.weights, self.bias = keys, weights, bias

    @classmethod
    def fit(cls, positives: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> PuModel:
        """A constant model (the prior) if either side is empty."""
        prior = float(np.clip(prior, 1e-3, 0.999))
        positives, unlabelled = without_copies(positives), without_copies(unlabelled)
        none = cls(np.zeros(0, np.uint64), np.zeros(0), float(np.log(prior / (1 - prior))))
        if not positives or not unlabelled:
            return none
        keys, count = np.unique(np.concatenate(positives), return_counts=True)
        rest = np.concatenate(unlabelled)
        at = np.minimum(np.searchsorted(keys, rest), len(keys) - 1)
        other = np.bincount(at[keys[at] == rest], minlength=len(keys))
        rate = count / len(positives)
        keep = (count >= min(LEAST, max(1, len(positives) // 2))) & (rate >= TIMES * (other + 1) / len(unlabelled))
        if keep.sum() > FEATURES:
            keep &= count >= np.partition(count[keep], -FEATURES)[-FEATURES]
        keys = keys[keep]
        if not len(keys):
            return none
        n_p, n_u = len(positives), len(unlabelled)
        docs = positives + unlabelled
        row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        value = np.concatenate(docs)
        at = np.minimum(np.searchsorted(keys, value), len(keys) - 1)
        hit = keys[at] == value
        row, at = row[hit], at[hit]
        w, bias = np.zeros(len(keys)), 0.0
        m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
        side = np.concatenate([np.full(n_p, True), np.full(n_u, False)])
        for step in range(1, STEPS + 1):
            z = bias + np.bincount(row, w[at], len(docs))
            p = 1 / (1 + np.exp(-z))
            loss = np.logaddexp(0, z)  # of calling a text clean
            negative = loss[n_p:].mean() - prior * loss[:n_p].mean()
            # slopes of R+ over P, R- over P and R- over U in each text's score
            if negative >= 0:
                slope = np.where(side, prior * (p - 1) / n_p - prior * p / n_p, p / n_u)
            else:
                slope = np.where(side, prior * p / n_p, -p / n_u)
            g = np.append(np.bincount(at, slope[row], len(keys)) + RIDGE * w, slope.sum())
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
            w, bias = w - move[:-1], bias - move[-1]
        return cls(keys, w, float(bias))

    def score(self, column: pa.Array) -> np.ndarray:
        row, value = features(column)
        total = np.zeros(len(column))
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, value), len(self.keys) - 1)
            hit = np.flatnonzero(self.keys[at] == value)
            # a feature counts once per text
            pairs = np.unique(row[hit] * len(self.keys) + at[hit])
            total = np.bincount(pairs // len(self.keys), self.weights[pairs % len(self.keys)], len(column))
        return 1 / (1 + np.exp(-(self.bias + total)))


@on_workers
def fit_toxicity(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> PuModel:
    """Train on the fold of ``labels`` that is not held out. The class prior is the share of
    toxic ones among all labels of that fold."""
    toxic = training_labels(labels, "toxic")
    n, prior = toxic.agg(F.count("*"), F.avg("label")).first()
    pool = docs.select("doc_id").filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sure = first_by_hash(toxic.filter("label = 1").select("doc_id"), positives).withColumn("positive", F.lit(True))
    rest = first_by_hash(pool, unlabelled).withColumn("positive", F.lit(False))
    chosen = F.broadcast(sure.unionByName(rest))  # at most positives + unlabelled rows
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("positive", "text").mapInArrow(
        _distinct, "positive boolean, features binary").toArrow()
    parts = [np.frombuffer(x, np.uint64) for x in rows.column("features").to_pylist()]
    flags = rows.column("positive").to_pylist()
    return PuModel.fit([p for p, f in zip(parts, flags) if f], [p for p, f in zip(parts, flags) if not f], prior if n else 0.5)


@on_workers
def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, and its columns ``keep``.

    Only texts are looked at. A null text counts as empty and scores as a text without any
    known word. Repeated rows are scored alike; a row without doc_id is scored, never trained
    on. Without confirmed toxic documents every score is the prior.
    """
    model = fit_toxicity(docs, labels)
    types = dict(docs.dtypes)

    def run(batches):
        for batch in slices(batches):
            kept = [batch.column(c) for c in ("_id", *(f"_keep_{c}" for c in keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(model.score(batch.column("_text")))], ["_id", *(f"_keep_{c}" for c in keep), "_score"])
    schema = "".join(f", `_keep_{c}` {types[c]}" for c in keep)
    scored = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").alias("_text"), *[F.col(c).alias(f"_keep_{c}") for c in keep]).mapInArrow(
        run, f"_id long{schema}, _score double")
    return scored.select(
        F.col("_id").alias("doc_id"), *[F.col(f"_keep_{c}").alias(c) for c in keep if c != "doc_id"],
        held_out(F.col("_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
