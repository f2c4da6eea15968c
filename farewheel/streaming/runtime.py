"""Reading tables as streams and running a stream into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from farewheel.sources.storage import scratch_dir

# Late data is accepted for a day, the delivery time the event plan allows.
LATENESS = "24 hours"

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stream_files(
    spark: SparkSession, path: str, glob: str = "*.parquet", max_files_per_trigger: int | None = None
) -> DataFrame:
    """Parquet files below ``path`` as a stream, with the schema of the files at hand.

    ``max_files_per_trigger`` bounds a micro-batch. Rows that are later than the stream's
    lateness are dropped, so a replay of files in any order needs a lateness that spans them.
    """
    schema = spark.read.option("pathGlobFilter", glob).parquet(path).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def wall_clock_as_utc(when: str) -> Column:
    """Watermarks need a zoned timestamp. Reading the wall clock as UTC keeps day
    windows on calendar days in every session time zone."""
    return F.expr(
        f"make_timestamp(year({when}), month({when}), day({when}), hour({when}), minute({when}),"
        f" extract(SECOND FROM {when}), 'UTC')"
    )


def utc_as_wall_clock(when: Column) -> Column:
    seconds = (F.unix_micros(when) / F.lit(1_000_000)).cast("decimal(18,6)")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), seconds
    )


def event_day(when: str) -> Column:
    """Calendar day of a wall clock that was read as UTC, in every session time zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(when) / 86400).cast("int"))


def start(
    df: DataFrame, path: str, checkpoint: str, **trigger: str | bool
) -> StreamingQuery:
    """Start writing a stream to a parquet table, e.g. with processingTime="10 seconds".
    State lives in RocksDB, on disk and not on the heap. The file sink and the checkpoint
    make a restart write each row once."""
    spark = df.sparkSession
    before = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        return (
            df.writeStream.outputMode("append").format("parquet").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )
    finally:
        # a running query keeps the settings it was started with
        if before is None:
            spark.conf.unset(STATE_STORE)
        else:
            spark.conf.set(STATE_STORE, before)


def run_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available now, then stop."""
    start(df, path, checkpoint, availableNow=True).awaitTermination()


def result_of(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    root = scratch_dir(spark, f"streams/{name}")
    run_available(df, f"{root}/table", f"{root}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{root}/table")


def replay(spark: SparkSession, build, last_rows: DataFrame, name: str) -> DataFrame:
    """Stored history through a stream to its very end.

    ``build(closing)`` makes the stream; ``closing`` is a source that it has to union into
    its input. When all history has been read, ``last_rows`` arrive there: rows so late in
    event time that the watermark passes everything before them.
    """
    root = scratch_dir(spark, f"streams/{name}")
    last_rows.limit(0).write.parquet(f"{root}/closing")
    df = build(spark.readStream.schema(last_rows.schema).parquet(f"{root}/closing"))
    run_available(df, f"{root}/table", f"{root}/checkpoint")
    last_rows.write.mode("append").parquet(f"{root}/closing")
    run_available(df, f"{root}/table", f"{root}/checkpoint")
    return spark.read.schema(df.schema).parquet(f"{root}/table")
