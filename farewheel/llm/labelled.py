"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 5, is 0.
    A row without id is never trained on and counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and label (0 or 1) of the training fold; of several labels the largest counts."""
    return (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def first_by_hash(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows, the same ones in every run."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most)
