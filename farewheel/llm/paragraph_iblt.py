"""Invertible Bloom lookup sketches of paragraph digests.

A text is the set of 64-bit digests of its paragraphs: its lines, long ones cut every
PIECE words; a repeated paragraph is digested with its number. Each digest is added to one
cell in every third of a table of cells (count, XOR of digests, XOR of check sums). The
tables of two versions are subtracted, which cancels what they share; cells that hold one
digest give it away, are peeled off, and lay open others. When peeling gets stuck, both
versions are sketched again in a table four times as large.

The fingerprint of a text is its smallest table. Equal paragraph sets have equal fingerprints.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window, functions as F

from farewheel.llm.shipping import on_workers
from farewheel.llm.staging import parts_of
from farewheel.llm.words import mix, slices

PIECE = 32         # words of a long line that make a paragraph
CELLS = 24         # cells of a fingerprint
GROW = 4           # how much larger a table is after peeling failed
SHARD_BYTES = 16 << 20
_U = np.uint64


def paragraph_digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of a text's paragraphs; an empty text has none."""
    import xxhash

    found: dict[int, int] = {}
    out = []
    for line in text.split("\n"):
        words = line.split(" ")
        for at in range(0, len(words), PIECE):
            piece = " ".join(words[at:at + PIECE])
            if piece:
                digest = xxhash.xxh64_intdigest(piece)
                again = found[digest] = found.get(digest, -1) + 1
                out.append(xxhash.xxh64_intdigest(piece, again) if again else digest)
    return np.array(out, _U)


_SALTS = (np.arange(1, 5, dtype=_U) * _U(0x9E3779B97F4A7C15))[:, None]


def _places(digests: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """One cell in each third, and the check sum, of every digest."""
    third = cells // 3
    hashes = mix(digests + _SALTS)
    where = (hashes[:3] % _U(third)).astype(np.int64)
    where[1] += third
    where[2] += 2 * third
    return where, hashes[3] >> _U(32)


class Sketch:
    """``cells`` cells of count, digest sum and check sum (sums by XOR)."""

    def __init__(self, cells: int):
        self.count = np.zeros(cells, np.int64)
        self.key = np.zeros(cells, _U)
        self.check = np.zeros(cells, _U)

    @classmethod
    def of(cls, digests: np.ndarray, cells: int = CELLS) -> Sketch:
        own = cls(cells)
        own.add(digests, 1)
        return own

    def add(self, digests: np.ndarray, sign) -> None:
        if len(digests):
            where, check = _places(digests, len(self.count))
            flat = where.ravel()
            np.add.at(self.count, flat, np.tile(sign, 3) if np.ndim(sign) else sign)
            np.bitwise_xor.at(self.key, flat, np.tile(digests, 3))
            np.bitwise_xor.at(self.check, flat, np.tile(check, 3))

    def minus(self, other: Sketch) -> Sketch:
        out = Sketch(len(self.count))
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests only on the left and only on the right; None if peeling gets stuck."""
        rest = self.minus(Sketch(len(self.count)))
        found, signs = [], []
        for _ in range(len(self.count) + 1):
            if not (rest.count.any() or rest.key.any()):
                digests = np.concatenate(found) if found else np.zeros(0, _U)
                sign = np.concatenate(signs) if signs else np.zeros(0, np.int64)
                return digests[sign > 0], digests[sign < 0]
            lone = np.flatnonzero(np.abs(rest.count) == 1)
            lone = lone[_places(rest.key[lone], len(rest.count))[1] == rest.check[lone]]
            if not len(lone):
                return None
            # a digest may lie alone in several of its cells
            digests, first = np.unique(rest.key[lone], return_index=True)
            sign = rest.count[lone[first]]
            found.append(digests)
            signs.append(sign)
            rest.add(digests, -sign)
        return None

    def text(self) -> str:
        count = self.count.astype("<i4").tobytes()
        return base64.b64encode(count + self.key.astype("<u8").tobytes() + self.check.astype("<u4").tobytes()).decode()

    @classmethod
    def from_text(cls, text: str) -> Sketch:
        raw = base64.b64decode(text)
        cells = len(raw) // 16
        own = cls(cells)
        own.count = np.frombuffer(raw, "<i4", cells).astype(np.int64)
        own.key = np.frombuffer(raw, "<u8", cells, 4 * cells).astype(_U)
        own.check = np.frombuffer(raw, "<u4", cells, 12 * cells).astype(_U)
        return own


def reconcile(left: np.ndarray, right: np.ndarray, tables: tuple[Sketch, Sketch] | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Digests only on either side, and the cells it took; ``tables`` are the first sketches,
    if they are there already. Digests of one side are distinct."""
    first, second = tables or (Sketch.of(left), Sketch.of(right))
    most = 8 * (len(left) + len(right)) + 3 * CELLS
    while True:
        cells = len(first.count)
        found = first.minus(second).peel()
        if found is not None:
            return *found, cells
        if cells > 64 * most:  # equal check sums by chance: compare the sets themselves
            return np.setdiff1d(left, right), np.setdiff1d(right, left), cells
        first, second = Sketch.of(left, cells * GROW), Sketch.of(right, cells * GROW)


def likeness(left: np.ndarray, right: np.ndarray, tables: tuple[Sketch, Sketch] | None = None) -> float:
    """Shared paragraphs over all paragraphs, from the recovered differences; 1 for two empty sets."""
    only_left, only_right, _ = reconcile(left, right, tables)
    shared = len(left) - len(only_left)
    whole = shared + len(only_left) + len(only_right)
    return shared / whole if whole else 1.0


def edited_text(text: str, after: str) -> str:
    """The last third of the code points replaced by as many of the next text's first."""
    cut = len(text) // 3
    return text[:len(text) - cut] + after[:cut]


def shards_by_id(docs: DataFrame, shards: int) -> DataFrame:
    """Rows with a column ``shard`` that rises with doc_id, and ``guest``: the first document
    of a shard in descending order comes a second time, as guest at the end of the shard
    before it, so every document meets its successor (the last one meets the first).

    Only numbers move in the preparation: borders come from a range partitioning of the ids
    alone, one row per shard.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    ids = docs.select(key.alias("key"))
    borders = ids.repartitionByRange(shards, "key").groupBy(F.spark_partition_id().alias("p")).agg(F.min("key").cast("double").alias("low"))
    splits = sorted({float("-inf"), float("inf"), *[r.low for r in borders.collect()][0:]})
    cut = Bucketizer(splits=splits if len(splits) > 2 else [float("-inf"), 0.0, float("inf")], inputCol="place", outputCol="shard")
    placed = lambda df: cut.transform(df.withColumn("place", F.col("key").cast("double"))).withColumn("shard", F.col("shard").cast("int")).drop("place")
    heads = placed(ids).groupBy("shard").agg(F.max("key").alias("key"))
    every = Window.orderBy("shard")
    lowest = F.first("shard").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("key").alias("head"), F.coalesce(F.lead("shard").over(every), lowest).alias("guest_of"))
    rows = placed(docs.select("doc_id", "text", key.alias("key")))
    # one head per shard: far below any broadcast limit
    rows = rows.join(F.broadcast(heads), F.col("key") == F.col("head"), "left")
    copies = F.array(F.struct("shard", F.lit(False).alias("guest")), F.struct(F.col("guest_of").alias("shard"), F.lit(True).alias("guest")))
    copies = F.filter(copies, lambda c: c["shard"].isNotNull())
    return rows.select("doc_id", "text", "key", F.explode(copies).alias("at")).select("doc_id", "text", "key", "at.shard", "at.guest")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _versions(batches):
    held = None  # (shard, doc_id, text, digests) that still waits for its successor
    for batch in slices(batches, 1000, 8 << 20):
        rows = []
        for shard, doc_id, text, guest in zip(*(batch.column(c).to_pylist() for c in ("shard", "doc_id", "text", "guest"))):
            text = text or ""
            digests = paragraph_digests(text)
            now = (shard, doc_id, text, digests, Sketch.of(digests))
            if held is not None and held[0] == shard:
                _, own_id, own, digests, sketch = held
                edited = edited_text(own, text)
                changed = digests if edited == own else paragraph_digests(edited)
                other = sketch if edited == own else Sketch.of(changed)
                rows.append((
                    own_id, len(own), hashlib.sha256(edited.encode()).hexdigest(), sketch.text(), other.text(),
                    likeness(digests, changed, (sketch, other)), likeness(digests, now[3], (sketch, now[4]))))
            held = None if guest else now
        columns = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


@on_workers
def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """Each whole text's fingerprint, that of its edited version, and how alike they are.

    The next document is the one with the next smaller doc_id; of rows with one doc_id the
    order is by text, rows without doc_id are last, and the first document follows the last.
    A null text is empty. A single document follows itself; an empty table gives no row.
    """
    shards = parts_of(docs, SHARD_BYTES)
    dealt = shards_by_id(docs.select(F.col("doc_id").cast("long"), "text"), shards)
    return (
        # by number, not by its hash: every shard gets a task of its own
        dealt.repartitionById(shards, "shard").sortWithinPartitions("shard", "guest", F.desc("key"), "text")
        .select("shard", "guest", "doc_id", "text").mapInArrow(_versions, RESULT)
    )


@on_workers
def fingerprints(docs: DataFrame, cells: int = CELLS) -> DataFrame:
    """doc_id and the fingerprint of every whole text; null is empty."""
    def run(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([Sketch.of(paragraph_digests(t or ""), cells).text() for t in texts], pa.string())], ["doc_id", "fingerprint"])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint string")
