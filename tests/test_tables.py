"""Canonical tables, sources, sinks, and properties of the reports on them."""

import tempfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from paths import SMALL
from farewheel.functions.columns import rnd, seconds_between, whole_days_between
from farewheel.operators import funnel, retention, segmentation
from farewheel.sources import storage, trips
from farewheel.sources.warehouse import open_tables, tables_root


@pytest.fixture(scope="module")
def tables(spark):
    return open_tables(spark, SMALL)


def test_published_sums_of_the_mapping(tables):
    row = tables.rides.agg(
        F.count("*"), F.countDistinct("ride_id"), F.countDistinct("user_id"), F.sum("ride_cost_cad").cast("string")).first()
    assert tuple(row) == (6000, 5999, 150, "19807.96")
    kinds = {r.event_type: r["count"] for r in tables.membership_events.groupBy("event_type").count().collect()}
    assert kinds == {
        "cta_shown": 1380, "cta_clicked": 762, "signup_started": 500, "signup_step_completed": 507,
        "signup_abandoned": 445, "signup_completed": 112}
    gone = tables.app_events.filter("event_type = 'app_uninstall'")
    assert (gone.count(), gone.select("user_id").distinct().count()) == (60, 46)
    assert tables.users.filter("user_type = 'Annual Member'").count() == 73


def test_tables_are_derived_once(spark):
    assert tables_root(spark, SMALL) == tables_root(spark, SMALL + "/")


def test_month_directories(tables):
    months = tables.rides.select("started_at_month", F.trunc(F.to_date("started_at"), "month").alias("m")).distinct().collect()
    assert len(months) == 24 and all(r.started_at_month == r.m for r in months)


def test_scratch_follows_the_shared_folder(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None)
    path = storage.scratch_dir(spark, "x")
    assert path != storage.scratch_dir(spark, "x")
    if shared:
        assert path.startswith(shared)


def test_order_and_partitioning_do_not_matter(tables):
    want = funnel.funnel_daily(tables.rides, tables.membership_events).collect()
    shuffled = funnel.funnel_daily(
        tables.rides.orderBy(F.rand(1)).repartition(7), tables.membership_events.repartition(3)).collect()
    assert want == shuffled


def test_grain_safe_equals_as_written_without_fan_out(tables):
    one_each = tables.membership_events.groupBy("user_id").agg(
        *[F.min_by(c, "event_id").alias(c) for c in tables.membership_events.columns if c != "user_id"])
    a = funnel.funnel_by_persona(tables.rides, tables.users, one_each)
    b = funnel.funnel_by_persona(tables.rides, tables.users, one_each, grain_safe=True)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    a = segmentation.priority_nudge_targets(tables.rides, tables.users, one_each)
    assert a.collect() == segmentation.priority_nudge_targets(tables.rides, tables.users, one_each, grain_safe=True).collect()
    a = retention.member_ytd_savings(tables.rides, tables.users, one_each)
    assert a.collect() == retention.member_ytd_savings(tables.rides, tables.users, one_each, grain_safe=True).collect()


def test_funnel_steps_do_not_outnumber_riders(tables):
    for r in funnel.funnel_by_persona(tables.rides, tables.users, tables.membership_events).collect():
        assert max(r.cta_shown, r.cta_clicked, r.converted) <= r.casual_riders


def test_trip_files_round_trip(spark, build):
    path = tempfile.mkdtemp(prefix="farewheel-test-") + "/trips"
    trips.write_trips(build.rides((1, "2023-03-12T02:30", 90), (2, "2023-03-12T02:31", 6)), path)
    rows = sorted(map(tuple, trips.read_trips(spark, path).select("ride_id", "started_at", "duration_min").collect()))
    assert [(r[0], str(r[1]), r[2]) for r in rows] == [("r0", "2023-03-12 02:30:00", 90.0), ("r1", "2023-03-12 02:31:00", 6.0)]


def test_a_rerun_replaces_its_own_partition_only(spark):
    path = tempfile.mkdtemp(prefix="farewheel-test-") + "/report"
    one, two = spark.range(3), spark.range(5)
    storage.write_run(one, "run_date", "2023-12-30", path)
    storage.write_run(one, "run_date", "2023-12-31", path)
    storage.write_run(two, "run_date", "2023-12-31", path)
    counts = {r.run_date: r["count"] for r in spark.read.parquet(path).groupBy("run_date").count().collect()}
    assert counts == {date(2023, 12, 30): 3, date(2023, 12, 31): 5}


def test_rounding_is_half_away_from_zero(spark):
    values = [2.5, -2.5, 0.5, -0.4, 1.005, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(rnd(F.col("v"))).collect()] == [3.0, -3.0, 1.0, 0.0, 1.0, None]
    assert df.select(rnd(F.lit(0.285), 2)).first()[0] == 0.28  # the double lies below


def test_time_ignores_summer_time(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-09 12:00:00' AS a, TIMESTAMP_NTZ'2024-03-10 11:59:59.5' AS b")
    row = df.select(seconds_between(F.col("a"), F.col("b")), whole_days_between(F.col("a"), F.col("b"))).first()
    assert (float(row[0]), row[1]) == (86399.5, 0)
