"""Where intermediate and output tables go, and how they are laid out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from farewheel.functions.columns import month_of


# Stored tables are written once and read by many queries.
COMPRESSION = "zstd"

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own, one per
    application; on a cluster the setting is required, since executors cannot share one.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = _OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="farewheel-")
        _OWN[context.applicationId] = shared
    return f"{shared.rstrip('/')}/farewheel"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new directory for one result of this application below the shared folder."""
    run = f"{spark.sparkContext.applicationId}-{uuid.uuid4().hex[:8]}"
    return f"{shared_dir(spark)}/{run}/{name}"


def _as_is(rows: DataFrame) -> DataFrame:
    return rows


def write_by_month(df: DataFrame, time_col: str, path: str, finish: Callable[[DataFrame], DataFrame] = _as_is) -> None:
    """Write a fact table in month directories, sorted by time inside each file.

    REBALANCE lets the adaptive planner split a large month and merge small ones, so
    file sizes follow the data without a sampling pass or a fixed file count. Sorted
    files give narrow row-group ranges, which prune down to the days a query asks for.
    ``finish`` adds columns row by row after the sort, so wide ones are neither shuffled
    nor sorted; it keeps all columns that it does not know.
    """
    part = f"{time_col}_month"
    _write_months(df.withColumn(part, month_of(F.col(time_col))).hint("rebalance", part), time_col, path, finish)


def rewrite_by_month(stored: DataFrame, time_col: str, path: str, finish: Callable[[DataFrame], DataFrame] = _as_is) -> None:
    """The same layout for rows derived from a table that lies by month already: the rows of
    one task fall into few months, so each is sorted where it is and nothing is shuffled."""
    _write_months(stored.withColumn(f"{time_col}_month", month_of(F.col(time_col))), time_col, path, finish)


def _write_months(df: DataFrame, time_col: str, path: str, finish: Callable[[DataFrame], DataFrame]) -> None:
    part = f"{time_col}_month"
    (
        finish(df.sortWithinPartitions(part, time_col))
        .write.mode("errorifexists").option("compression", COMPRESSION).partitionBy(part).parquet(path)
    )


def append_rows(df: DataFrame, path: str) -> None:
    """Add files to a folder that a stream reads."""
    df.write.mode("append").option("compression", COMPRESSION).parquet(path)


def write_run(df: DataFrame, run_column: str, run_value: str, path: str) -> None:
    """Replace one run's partition of a report table and leave the others alone."""
    (
        df.withColumn(run_column, F.lit(run_value).cast("date"))
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(run_column).parquet(path)
    )
