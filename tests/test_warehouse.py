"""Canonical tables: built once for the same sources, never read half built."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from paths import SMALL
from farewheel.functions.columns import month_of
from farewheel.sources import storage, warehouse
from farewheel.sources.storage import shared_dir


@pytest.fixture
def sources(tmp_path):
    for name in warehouse.SOURCES:
        shutil.copy(f"{SMALL}/{name}.parquet", tmp_path / f"{name}.parquet")
    return str(tmp_path)


def forget():
    """As a new session would start."""
    warehouse._ROOTS.clear()


def test_a_later_session_reuses_the_tables(spark, sources, monkeypatch):
    forget()
    root = warehouse.tables_root(spark, sources)
    forget()
    monkeypatch.setattr(warehouse, "build", lambda *a: pytest.fail("built again"))
    assert warehouse.tables_root(spark, sources) == root


def test_changed_sources_and_failed_builds_are_built_anew(spark, sources, monkeypatch):
    forget()
    first = warehouse.source_identity(spark, sources)
    shutil.copy(f"{SMALL}/region.parquet", f"{sources}/region.parquet")
    assert warehouse.source_identity(spark, sources) == first
    shutil.copy(f"{SMALL}/orders.parquet", f"{sources}/nation.parquet")
    assert warehouse.source_identity(spark, sources) != first
    shutil.copy(f"{SMALL}/nation.parquet", f"{sources}/nation.parquet")

    def broken(spark, sf_dir, root):
        spark.range(1).write.parquet(f"{root}/rides")
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(warehouse, "build", broken)
        with pytest.raises(RuntimeError):
            warehouse.tables_root(spark, sources)
    place = f"{shared_dir(spark)}/tables/{warehouse.source_identity(spark, sources)}"
    assert warehouse._built(spark, place) is None
    assert warehouse._built(spark, place) != warehouse.tables_root(spark, sources)
    assert warehouse._built(spark, place) == warehouse.tables_root(spark, sources)


def test_only_numbers_travel_to_their_month(spark, tmp_path, monkeypatch):
    travelled, real = [], warehouse.write_by_month
    monkeypatch.setattr(warehouse, "write_by_month", lambda df, *a, **k: (travelled.append(df.dtypes), real(df, *a, **k)))
    warehouse.build(spark, SMALL, str(tmp_path / "built"))
    assert len(travelled) == 1 and not any(kind == "string" for _, kind in travelled[0])
    for table, time in (("rides", "started_at"), ("membership_events", "event_at"), ("app_events", "event_at")):
        rows = spark.read.parquet(str(tmp_path / "built" / table))
        wrong = rows.filter(~F.col(f"{time}_month").eqNullSafe(month_of(F.col(time))))
        assert rows.count() and not wrong.count()


def test_rows_are_finished_behind_the_sort(spark, build, tmp_path):
    # one event is in the month after its ride's
    rides = build.rides((1, "2023-03-31T23:55", 30), (1, "2023-03-02T08:00"), (2, "2023-01-05T08:00"), (3, "2023-03-01T08:00")).coalesce(1)
    finished = []

    def finish(rows):
        finished.append(rows._jdf.queryExecution().executedPlan().toString())
        return rows.withColumn("wide", F.lit("w"))

    storage.rewrite_by_month(rides.select("user_id", F.col("ended_at").alias("event_at")), "event_at", str(tmp_path / "events"), finish)
    assert "Exchange" not in finished[0] and "wide" not in finished[0]
    rows = spark.read.parquet(str(tmp_path / "events")).orderBy("event_at").collect()
    assert [(r.user_id, str(r.event_at_month), r.wide) for r in rows] == [
        (2, "2023-01-01", "w"), (3, "2023-03-01", "w"), (1, "2023-03-01", "w"), (1, "2023-04-01", "w")]
    files = [f"{tmp_path}/events/{d}/{f}" for d in os.listdir(tmp_path / "events") if d.startswith("event_at_month")
             for f in os.listdir(tmp_path / "events" / d) if f.endswith(".parquet")]
    for f in files:
        times = [r.event_at for r in spark.read.parquet(f).collect()]
        assert times == sorted(times)
    assert len(files) == 3
