"""Places of rows in one global order, with no task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.llm.staging import shuffle_parts, staged

_PART_BITS = 33  # monotonically_increasing_id counts within a partition below this bit


def in_ranges(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` dealt by ranges of ``order`` and sorted in them, written to the shared folder,
    with the columns ``range_id`` and ``at``: the range, in order, and the place in it from 0.

    Every task holds one range, whose borders come from a sample of the rows, so rows of a
    common key are spread as long as ``order`` tells them apart.
    """
    dealt = rows.repartitionByRange(shuffle_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    written = staged(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    return written.select(
        *rows.columns, F.shiftright("_at", _PART_BITS).alias("range_id"), F.col("_at").bitwiseAND((1 << _PART_BITS) - 1).alias("at"))


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with ``place``, from 1, in the whole order."""
    placed = in_ranges(rows, order, name)
    sizes = placed.groupBy("range_id").agg(F.count("*").alias("_rows"))
    # one row per range: their number is a setting
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("range_id", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    return placed.join(F.broadcast(starts), "range_id").select(*rows.columns, (F.col("_start") + F.col("at") + 1).alias("place"))
