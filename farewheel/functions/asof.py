"""As-of join: to each row the latest earlier row of the same key, in hour blocks.

Both sides meet in one table, cut into (key, hour) blocks. The last right row of each block is
carried on to later blocks over one row per block, and within a block a running maximum does
the rest, so the history of a hot key is spread over as many tasks as it has hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from farewheel.functions.blocks import block_of


def join_latest(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, carry: Sequence[str], strict: bool = False) -> DataFrame:
    """Every row of ``left`` with ``right_time`` and the columns ``carry`` of the latest row of
    ``right`` of the same key that is not later (with ``strict``: that is earlier); NULL where
    there is none. Among right rows of one time the largest ``carry`` counts. Rows without key
    or time match nothing. ``carry`` and ``right_time`` must not be columns of ``left``.
    """
    own = F.struct(*[F.col(c) for c in left.columns])
    touch = F.struct(F.col(right_time), *[F.col(c) for c in carry])
    # right rows of the same instant stand before a left row, or after it
    lefts = left.select(F.col(key).alias("_key"), F.col(left_time).alias("_when"), F.lit(0 if strict else 1).alias("_side"), own.alias("_row"))
    rights = right.filter(F.col(key).isNotNull() & F.col(right_time).isNotNull()).select(
        F.col(key).alias("_key"), F.col(right_time).alias("_when"), F.lit(1 if strict else 0).alias("_side"), touch.alias("_touch"))
    rows = lefts.unionByName(rights, allowMissingColumns=True).withColumn("_block", block_of(F.col("_when")))
    within = Window.partitionBy("_key", "_block").orderBy("_when", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy("_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    last = rows.filter("_key IS NOT NULL AND _block IS NOT NULL").groupBy("_key", "_block").agg(F.max("_touch").alias("_last")).select(
        "_key", "_block", F.max("_last").over(earlier).alias("_before"))
    found = rows.withColumn("_here", F.max("_touch").over(within)).filter("_row IS NOT NULL").join(last, ["_key", "_block"], "left")
    latest = F.when(F.col("_key").isNotNull() & F.col("_when").isNotNull(), F.coalesce("_here", "_before"))
    return found.withColumn("_latest", latest).select("_row.*", "_latest.*")
