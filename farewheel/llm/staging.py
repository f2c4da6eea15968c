"""Sizes of stages and tables written between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from farewheel.sources.storage import scratch_dir


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage ends there, and
    executors that are lost later cost only a read."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def parts_of(docs: DataFrame, bytes_per_part: int) -> int:
    """How many parts keep each near ``bytes_per_part`` of text; at least the session's
    shuffle partitions."""
    return max(shuffle_parts(docs.sparkSession), -(-text_bytes(docs) // bytes_per_part))
