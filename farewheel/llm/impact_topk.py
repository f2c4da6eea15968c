"""Exact top-k inner products from an impact-ordered index, scored score-at-a-time.

Vectors are integers after scaling. A shard of vectors keeps posting segments (dimension,
vectors, values) in order of their quantised impact, the bit length of a component's
magnitude. A block of queries takes the segments of all dimensions by descending impact and
adds them to one accumulator per query and vector. What is still open is bounded: a component
that was not met yet is smaller than the impact of the segments taken last, so a score lies
within that impact times the query's weight in the unmet dimensions. The vectors whose upper
bound reaches the k-th best lower bound are the possible members of a result. The block stops
when the bounds prove that only few are left, or when all segments are taken, and scores
exactly those that are left.

Every query meets every shard, in a grid of query blocks and shards; a window keeps the best
k of what the shards return, k rows per query and shard.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.llm.shipping import on_workers

SHARD_ROWS = 8192      # vectors of an index shard
BLOCK_ROWS = 4096      # queries that visit a shard together
AT_ONCE = 256          # queries whose accumulators are held at once
FEW = 16               # possible members per wanted result at which exact scoring starts


def scaled(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def usable(embedding: Column) -> Column:
    """Vectors that are there and hold finite components only."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embedding.isNotNull() & ~F.coalesce(bad, F.lit(False))


class ImpactIndex:
    """Posting segments of one shard by descending quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        impact = np.ceil(np.log2(np.abs(self.vectors).astype(np.float64) + 1)).astype(np.int8)
        self.segments = []  # (least magnitude of the level, values and presence by dimension and vector)
        for level in sorted(set(np.unique(impact).tolist()) - {0}, reverse=True):
            met = (impact == level).T
            self.segments.append((1 << (level - 1), np.where(met, self.vectors.T, 0).astype(np.float64), met.astype(np.float64)))

    def search(self, queries: np.ndarray, own_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, vector id, score) of the best k of each query, without the query's own
        id; ties go to the smaller id."""
        weights, size = queries.astype(np.float64), np.abs(queries).astype(np.float64)
        score = np.zeros((len(queries), len(self.ids)))
        unmet = np.repeat(size.sum(1)[:, None], len(self.ids), 1)
        own = own_ids[:, None] == self.ids[None, :]
        wanted = min(k, len(self.ids))
        possible = ~own
        for least, values, met in self.segments:
            score += weights @ values
            unmet -= size @ met
            open_ = unmet * (least - 1)
            low = np.where(own, -np.inf, score - open_)
            kth = np.partition(low, len(self.ids) - wanted, axis=1)[:, len(self.ids) - wanted]
            # float64 sums may be off by a few units in the last place
            margin = 1e-12 * (1 + np.abs(kth))
            possible = (score + open_ >= np.where(np.isfinite(kth), kth - margin, -np.inf)[:, None]) & ~own
            if possible.sum() <= FEW * wanted * len(queries):
                break
        row, at = np.nonzero(possible)
        exact = np.empty(len(row), np.int64)
        for a in range(0, len(row), 1 << 16):
            b = slice(a, a + (1 << 16))
            exact[b] = (queries[row[b]] * self.vectors[at[b]]).sum(1)
        order = np.lexsort((self.ids[at], -exact, row))
        row, at, exact = row[order], at[order], exact[order]
        first = np.searchsorted(row, row)
        best = np.arange(len(row)) - first < k
        return row[best], self.ids[at[best]], exact[best]


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists as rows of one matrix; missing components are zero."""
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.chunk(0) if lists.num_chunks else pa.array([], column.type)
    size = np.diff(np.asarray(lists.offsets))
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None, :] < size[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _meet(k: int):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return _FOUND.empty_table()
        width = max(t.column("width")[0].as_py() for t in (vectors, queries))
        index = ImpactIndex(vectors.column("id").to_numpy(), _matrix(vectors.column("v"), width))
        ids, rows = queries.column("id").to_numpy(), _matrix(queries.column("v"), width)
        found = []
        for at in range(0, len(ids), AT_ONCE):
            row, vec, score = index.search(rows[at:at + AT_ONCE], ids[at:at + AT_ONCE], k)
            found.append((ids[at:at + AT_ONCE][row], vec, score))
        return pa.Table.from_arrays([pa.array(np.concatenate([f[i] for f in found])) for i in range(3)], schema=_FOUND)
    return run


@on_workers
def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` vectors with the largest inner product with
    each query, exact. Both sides have columns id (long) and v (array<long>).

    Rows without id take no part. Vectors of different length meet as if the shorter one went
    on with zeros. A query never finds rows of its own id; queries that repeat an id are
    answered once, from one of the equal rows. Scores are exact while they fit 64 bits.
    Empty tables give no rows.
    """
    vectors = vectors.filter("id IS NOT NULL")
    queries = queries.filter("id IS NOT NULL").dropDuplicates(["id"])
    n, width = vectors.agg(F.count("*"), F.max(F.size("v"))).first()
    m, query_width = queries.agg(F.count("*"), F.max(F.size("v"))).first()
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-m // BLOCK_ROWS))
    width = F.lit(max(width or 0, query_width or 0, 1)).alias("width")
    part = lambda parts: F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = vectors.select("id", "v", width, part(shards).alias("shard"), every(blocks).alias("block"))
    right = queries.select("id", "v", width, part(blocks).alias("block"), every(shards).alias("shard"))
    found = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(
        _meet(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best).cast("int")).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def top_k_embeddings(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """``top_k`` of each row whose vec_id is divisible by ``every`` against all other rows."""
    rows = embeddings.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("id"), scaled(F.col("embedding")).alias("v"))
    return top_k(rows, rows.filter(F.col("id") % every == 0), k)
