"""Importance resampling of documents towards a target distribution.

Texts are scanned once, in parallel and without a shuffle. ASCII letters are lower-cased, every
separator becomes a space and runs of spaces collapse to one, so that an n-gram is a stretch of
text between two word borders. One regular expression per n, with lookarounds for the borders
and overlapping matches, walks those stretches in place; each is counted under the CRC of its
bytes. What is kept of a text are its bucket numbers, two bytes a feature, written once to the
shared folder.

Bucket counts of documents and target are partial sums per task; the driver gets one pair of
counts per bucket, a number that is a parameter. Gains of buckets go back to the tasks, which sum
them over each document and add noise that depends on the document id alone. The highest scores
are drawn by places in range-sorted rows, so that no task sees all of them.
"""

from __future__ import annotations

import hashlib
import math
from array import array
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from farewheel.llm.ordering import numbered
from farewheel.llm.shipping import on_workers
from farewheel.llm.staging import staged
from farewheel.llm.words import slices

BUCKETS = 10_000     # at most 65,536
LONGEST = 1          # words of the longest n-gram
SEED = 2024
LEAST_WORDS = 20     # documents with fewer are never drawn
PERCENT = 10         # of the others

# letters lower-cased; other ASCII characters than letters and digits are separators
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SCANNED = "n_words long, n_features long, buckets binary"
COUNTS = "bucket int, n long"


def collapsed(text: str | None) -> bytes:
    """Words joined by one space."""
    return b" ".join((text or "").encode().translate(_TABLE).split())


def spans(longest: int) -> list[regex.Pattern]:
    """For each n, all stretches of n words that begin and end at a word border."""
    return [regex.compile(rb"(?<![^ ])[^ ]+(?: [^ ]+){%d}(?![^ ])" % (n - 1)) for n in range(1, longest + 1)]


def bucket_numbers(line: bytes, pattern: regex.Pattern, buckets: int) -> array:
    return array("H", (crc32(found[0]) % buckets for found in pattern.finditer(line, overlapped=True)))


def _scan(longest: int, buckets: int, keep: list[str]):
    def run(batches):
        patterns = spans(longest)
        for batch in slices(batches):
            words, features, found = [], [], []
            for text in batch.column("_text").to_pylist():
                line = collapsed(text)
                parts = [bucket_numbers(line, p, buckets) for p in patterns]
                words.append(len(parts[0]))
                features.append(sum(map(len, parts)))
                found.append(b"".join(p.tobytes() for p in parts))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(words, pa.int64()), pa.array(features, pa.int64()), pa.array(found, pa.binary())],
                [*keep, "n_words", "n_features", "buckets"])
    return run


@on_workers
def scanned(docs: DataFrame, keep: tuple[str, ...], longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """The columns ``keep`` with n_words, n_features and the bucket of every n-gram (unsigned
    16-bit numbers in the machine's order)."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets are numbered by 16 bits")
    types = dict(docs.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keep)
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(_scan(longest, buckets, list(keep)), schema + SCANNED)


def _tally(buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in batch.column("buckets").to_pylist():
                total += np.bincount(np.frombuffer(found, np.uint16), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])
    return run


def bucket_counts(scans: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows; one row per bucket reaches the driver."""
    rows = scans.select("buckets").mapInArrow(_tally(buckets), COUNTS).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(buckets, np.int64)
    for row in rows:
        counts[row.bucket] = row.n
    return counts


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, all_source, all_target = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([
        math.floor(1000 * math.log((float(target[i]) + 1) * all_source / ((float(source[i]) + 1) * all_target))) for i in range(n)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Thousandths of a Gumbel draw that depends on seed and id alone, rounded down. A missing
    id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _score(gains: np.ndarray, seed: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            weights = [int(gains[np.frombuffer(b, np.uint16)].sum()) for b in batch.column("buckets").to_pylist()]
            scores = [w + noise(i, seed) for w, i in zip(weights, ids)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_words"), batch.column("n_features"), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                ["doc_id", "n_words", "n_features", "weight", "score"])
    return run


def resample(
    docs: DataFrame, target: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs``; ``rank`` counts the
    drawn rows from 1 and is null for the others.

    ``target`` is any table with a column ``text``. A word is a run of letters and digits, where
    all characters beyond ASCII count as letters. Null and empty texts have no feature, weight 0
    and the score of their noise; they are never drawn, nor are texts below ``least_words``. An
    empty target makes rare buckets heavy and is allowed; an empty table gives no rows. Repeated
    rows count as often as they occur and have one score; equal scores rank by doc_id, rows
    without id last. Texts of any length are walked match by match; two bytes a feature are held.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    scans = staged(scanned(rows, ("doc_id",), longest, buckets), "buckets")
    source = bucket_counts(scans, buckets)
    wanted = bucket_counts(scanned(target.select("text"), (), longest, buckets), buckets)
    scored = scans.mapInArrow(
        _score(bucket_gains(source, wanted), seed), "doc_id long, n_words long, n_features long, weight long, score long")
    able = F.col("n_words") >= least_words
    placed = numbered(scored, [able.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features"), F.col("weight")], "ranked")
    drawn = scans.filter(able).count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
