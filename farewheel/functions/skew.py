"""Join helper for a fact table in which a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# A key with more fact rows than this is spread over several tasks.
ROWS_PER_TASK = 5_000_000


def join_hot_keys(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    spread_by: list[str],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Inner join of ``fact`` with ``dim`` (one row per key), split by hot key.

    Keys are counted first (one narrow, map-side combined aggregate). Those above
    ``rows_per_task`` get one salt per ``rows_per_task`` rows; all others keep salt 0,
    so nothing is replicated for them. The hot list cannot have more than
    rows / rows_per_task entries; how it and ``dim`` are joined is left to the planner.
    """
    hot = (
        fact.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > rows_per_task)
        .select(key, F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_salts"))
    )
    salted_dim = (
        dim.join(hot, key, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
        .drop("_salts")
    )
    salted_fact = (
        fact.join(hot, key, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    return salted_fact.join(salted_dim, [key, "_salt"]).drop("_salt")
