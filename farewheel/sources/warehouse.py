"""The canonical tables of one data directory.

They are derived once and written to the shared folder, partitioned by month, under the
identity of their sources: later sessions find them there, and changed sources are derived
anew. A build counts only when its marker is written, so one that failed is never read.
Every query then reads columnar tables with pruned columns, pushed filters and
pruned months, instead of repeating the two-table join that the derivation needs; the
written tables also survive the loss of executors.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from farewheel.model import Tables, USERS
from farewheel.sources import mapping
from farewheel.sources.storage import rewrite_by_month, shared_dir, write_by_month

# folder per application and source directory; table handles per session
_ROOTS: dict[tuple[str, str], str] = {}
_TABLES: dict[tuple[SparkSession, str], Tables] = {}


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _stored(spark: SparkSession, root: str) -> Tables:
    return Tables(*[
        spark.read.parquet(f"{root}/{name}")
        for name in ("rides", "membership_events", "users", "app_events")
    ])


def build(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Derive and write the tables. The join runs once, for rides; the rest read it. Rides
    travel to their month as numbers; events are written where their rides are read."""
    numbers = mapping.ride_numbers(
        source_table(spark, sf_dir, "lineitem"), source_table(spark, sf_dir, "orders")
    )
    write_by_month(numbers, "started_at", f"{root}/rides", finish=mapping.rides_of_numbers)
    rides = spark.read.parquet(f"{root}/rides")
    rewrite_by_month(mapping.event_numbers(rides), "event_at", f"{root}/membership_events", finish=mapping.events_of_numbers)
    rewrite_by_month(mapping.app_events(rides), "event_at", f"{root}/app_events")
    events = spark.read.parquet(f"{root}/membership_events")
    mapping.users(
        source_table(spark, sf_dir, "customer"), source_table(spark, sf_dir, "nation"), rides, events
    ).write.parquet(f"{root}/users")


def _is_there(spark: SparkSession, root: str) -> bool:
    try:
        spark.read.schema(USERS).parquet(f"{root}/users")
        return True
    except AnalysisException:
        return False


SOURCES = ("lineitem", "orders", "customer", "nation")


def source_identity(spark: SparkSession, sf_dir: str) -> str:
    """Digest of the sources' file names, lengths and times; no file is opened."""
    files = spark.read.format("binaryFile").load([f"{sf_dir.rstrip('/')}/{name}.parquet" for name in SOURCES])
    row = files.agg(
        F.count("*"), F.sum("length"), F.max("modificationTime").cast("string"),
        F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")),
    ).first()
    return hashlib.sha256(repr(tuple(row)).encode()).hexdigest()[:24]


def _built(spark: SparkSession, place: str) -> str | None:
    """Root of a finished build, as its marker names it."""
    try:
        row = spark.read.schema("root string").parquet(f"{place}/complete").first()
        return row.root if row else None
    except AnalysisException:
        return None


def tables_root(spark: SparkSession, sf_dir: str) -> str:
    """Folder of the canonical tables of ``sf_dir``: the one that is there for these
    sources, else a new one. A cleared shared folder is filled again."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key in _ROOTS and _is_there(spark, _ROOTS[key]):
        return _ROOTS[key]
    place = f"{shared_dir(spark)}/tables/{source_identity(spark, sf_dir)}"
    root = _built(spark, place)
    if root is None or not _is_there(spark, root):
        root = f"{place}/{uuid.uuid4().hex}"
        build(spark, sf_dir, root)
        spark.createDataFrame([(root,)], "root string").coalesce(1).write.mode("overwrite").parquet(f"{place}/complete")
    _ROOTS[key] = root
    return root


def open_tables(spark: SparkSession, sf_dir: str) -> Tables:
    """Lazy handles of the written tables. They never change after they are written, so
    the handles are kept and their files are listed once."""
    key = (spark, tables_root(spark, sf_dir))
    if key not in _TABLES:
        _TABLES[key] = _stored(spark, key[1])
    return _TABLES[key]
