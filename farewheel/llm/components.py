"""Connected components of an edge table by alternating large-star and small-star rounds.

Rows are pairs of ids; every round is two aggregations with partial sums, so the neighbours of
a hub are never gathered. Rounds are written to the shared folder and end when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from farewheel.llm.staging import staged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each id's larger neighbours now point to the smallest id around it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each id and its smaller neighbours now point to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in ``edges`` (columns a, b; both long). ``component`` is the
    smallest id reachable. Loops and repeated edges do no harm."""
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    print_of = lambda df: df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").bitwiseAND((1 << 31) - 1))).first()
    before = None
    while True:
        mark = print_of(now)
        if mark == before or not mark[0]:
            break
        before = mark
        now = staged(_small_star(_large_star(now)), "edges")
    # every id but the smallest of its component now points to it
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component"))).distinct()
