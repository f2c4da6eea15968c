"""Admission of a stream: what arrives too late goes into a table of its own.

Stateful streams drop rows behind the watermark without a trace. Here a first job decides, batch
by batch, by one rule: a row is late if it happened more than the lateness before the newest row
of all earlier batches. Admitted and late rows are written in one pass, under the number of their
batch; the newest time of the batch is noted last. A batch that is repeated after a failure finds
the same notes, decides the same and replaces what it had written.

Streams behind it drop nothing: with the lateness of ``downstream_lateness`` their watermark never
overtakes an admitted row, however they cut their own batches.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

NOTES = T.StructType([T.StructField("newest", T.TimestampType()), T.StructField("batch", T.LongType())])


def _notes(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(NOTES).parquet(f"{path}/notes")
    except AnalysisException:
        return spark.createDataFrame([], NOTES)


def admit_batch(rows: DataFrame, batch: int, path: str, time_column: str, lateness: timedelta) -> None:
    """Decide on one batch, write it and note how far it reaches."""
    spark = rows.sparkSession
    border = _notes(spark, path).filter(F.col("batch") < batch).agg(F.max("newest").alias("newest")).select(
        (F.col("newest") - F.lit(lateness)).alias("_border"))
    # one row, joined in so that no time of the session's zone passes through the driver
    judged = rows.crossJoin(F.broadcast(border)).select(
        *rows.columns, F.coalesce((F.col("_border").cast("double") - F.col(time_column).cast("double")) / 3600.0, F.lit(0.0)).alias("hours_behind"),
        F.lit(batch).cast("long").alias("batch"), F.coalesce(F.col(time_column) < F.col("_border"), F.lit(False)).alias("late"))
    judged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "late").parquet(f"{path}/rows")
    written = spark.read.schema(judged.schema).parquet(f"{path}/rows").filter(F.col("batch") == batch)
    newest = written.agg(F.max(time_column).alias("newest")).withColumn("batch", F.lit(batch).cast("long")).filter("newest IS NOT NULL")
    newest.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{path}/notes")


def admit(stream: DataFrame, path: str, checkpoint: str, time_column: str = "event_at", lateness: timedelta = timedelta(hours=24)) -> None:
    """Everything available now through the admission; a restart goes on where it stopped."""
    stream.writeStream.foreachBatch(
        lambda rows, batch: admit_batch(rows, batch, path, time_column, lateness)
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def judged_rows(spark: SparkSession, path: str, schema: T.StructType, late: bool) -> DataFrame:
    """Admitted or late rows with their batch and, for late ones, how far behind they came."""
    return spark.read.schema(_judged(schema)).parquet(f"{path}/rows").filter(F.col("late") == late).drop("late")


def admitted_stream(spark: SparkSession, path: str, schema: T.StructType, max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(_judged(schema))
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(f"{path}/rows").filter("NOT late").select(*schema.names)


def _judged(schema: T.StructType) -> T.StructType:
    extra = [("hours_behind", T.DoubleType()), ("batch", T.LongType()), ("late", T.BooleanType())]
    return T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in extra]])


def downstream_lateness(spark: SparkSession, path: str, lateness: timedelta = timedelta(hours=24)) -> str:
    """Lateness for streams behind the admission: the rule's own and as much as one batch has
    ever moved the newest time on, since their batches may end inside one of the admission's."""
    rows = _notes(spark, path).orderBy("batch").select(F.unix_micros("newest").alias("at")).collect()  # one row per batch
    newest, step = None, 0
    for row in rows:
        if newest is not None:
            step = max(step, row.at - newest)
        newest = row.at if newest is None else max(newest, row.at)
    return f"{int((lateness + timedelta(microseconds=step)).total_seconds()) + 1} seconds"
