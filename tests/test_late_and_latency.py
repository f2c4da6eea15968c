"""Admission of late rows over many batches, with failures, and the join of two streams."""

import os
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from farewheel.streaming import events as live, late, latency, runtime

T0 = datetime(2024, 1, 1)
RAW = "event_id long, user_id long, ts timestamp_ntz, event_type string, value double, props string"


class Feed:
    def __init__(self, spark):
        self.spark, self.root = spark, tempfile.mkdtemp(prefix="farewheel-test-")
        self.source, self.judged, self.checkpoint = (f"{self.root}/{n}" for n in ("in", "judged", "chk"))
        os.mkdir(self.source)

    def add(self, *hours):
        """One file: events by their hour, numbered on."""
        start = len(os.listdir(self.source)) * 100
        rows = [(start + i, i, T0 + timedelta(hours=h), "view", 0.0, "{}") for i, h in enumerate(hours)]
        self.spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(self.source)

    def stream(self):
        return live.funnel_events(self.spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(self.source))

    def run(self):
        late.admit(self.stream(), self.judged, self.checkpoint)

    def ids(self, is_late):
        return sorted(r.event_id for r in late.judged_rows(self.spark, self.judged, self.stream().schema, is_late).collect())


@pytest.fixture
def feed(spark):
    return Feed(spark)


def test_late_by_the_batches_before_not_by_the_own(feed):
    feed.add(0, 50)            # the first batch has no border
    feed.run()
    feed.add(26, 25, 100)      # border 26: only what is before it is late
    feed.add(75, 76, 200)      # border 76
    feed.run()
    names = sorted(os.listdir(feed.source))
    assert len([n for n in names if n.endswith(".parquet")]) == 3
    got = late.judged_rows(feed.spark, feed.judged, feed.stream().schema, True).collect()
    assert sorted((r.batch, r.hours_behind) for r in got) == [(1, 1.0), (2, 1.0)]
    assert len(feed.ids(False)) == 6
    feed.run()  # nothing new
    assert len(feed.ids(False)) == 6 and len(feed.ids(True)) == 2


@pytest.mark.parametrize("when", ["before the rows", "before the note"])
def test_a_batch_that_failed_is_decided_again_alike(feed, monkeypatch, when):
    feed.add(0, 50)
    feed.run()
    feed.add(25, 100)
    real = late.admit_batch

    def failing(rows, batch, path, time_column, lateness):
        if when == "before the note":
            # rows are written, the note of how far they reach is not
            real(rows, batch, path, time_column, lateness)
            fs = feed.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/notes/batch={batch}")
            fs.getFileSystem(feed.spark._jsc.hadoopConfiguration()).delete(fs, True)
        raise RuntimeError("lost")

    monkeypatch.setattr(late, "admit_batch", failing)
    with pytest.raises(Exception):
        feed.run()
    monkeypatch.undo()
    feed.add(75, 200)
    feed.run()
    assert len(feed.ids(True)) == 2 and len(feed.ids(False)) == 4
    notes = sorted((r.batch, r.newest) for r in late._notes(feed.spark, feed.judged).collect())
    assert [b for b, _ in notes] == [0, 1, 2]


def test_streams_behind_the_admission_drop_nothing(feed):
    for hours in ((0, 10, 20), (30, 2, 150), (125, 127, 160), (400, 370, 377), (376.5, 401)):
        feed.add(*hours)
        feed.run()
    schema = feed.stream().schema
    lateness = late.downstream_lateness(feed.spark, feed.judged)
    assert lateness == f"{(24 + 240) * 3600 + 1} seconds"
    closing = feed.spark.createDataFrame([(None, None, None, None, None)], "event_id long, user_id long, event_type string, step string, event_at timestamp").limit(0)
    rows = late.admitted_stream(feed.spark, feed.judged, schema, max_files_per_trigger=1)
    out = runtime.replay(feed.spark, lambda end: live.stream_event_dedup(rows.unionByName(end), lateness=lateness), closing.select(*schema.names), "test")
    assert sorted(r.event_id for r in out.collect()) == feed.ids(False)


RIDES = "user_id long, ride_id string, user_type string, ended_at timestamp_ntz"
SHOWN = "user_id long, event_type string, event_at timestamp_ntz"


def test_rides_meet_their_nudges_and_state_is_evicted(spark):
    root = tempfile.mkdtemp(prefix="farewheel-test-")
    at = lambda minutes: T0 + timedelta(minutes=minutes)

    def deliver(rides, shown):
        spark.createDataFrame([(u, r, k, at(m)) for u, r, k, m in rides], RIDES).write.mode("append").parquet(f"{root}/rides")
        spark.createDataFrame([(u, "cta_shown", at(m)) for u, m in shown], SHOWN).write.mode("append").parquet(f"{root}/shown")
        pairs = latency.stream_nudge_latency(
            spark.readStream.schema(RIDES).parquet(f"{root}/rides"), spark.readStream.schema(SHOWN).parquet(f"{root}/shown"))
        query = runtime.start(pairs, f"{root}/out", f"{root}/chk", availableNow=True)
        query.awaitTermination()
        return pairs, query

    casual = "Casual Member"
    deliver([(1, "a", casual, 0), (2, "b", casual, 5), (3, "c", "Annual Member", 5), (4, "d", casual, 6)], [(1, 0.5), (2, 4), (4, 7.5), (4, 8)])
    deliver([(5, "e", casual, 60), (6, "f", casual, 61)], [(5, 69), (6, 72)])
    deliver([(-1, "end", casual, 10_000)], [(-2, 10_000)])
    pairs, query = deliver([(-1, "end2", casual, 20_000)], [(-2, 20_000)])
    rows = latency.first_nudges(spark.read.schema(pairs.schema).parquet(f"{root}/out").filter("user_id > 0")).collect()
    assert sorted((r.ride_id, r.latency_seconds, r.latency_class) for r in rows) == [
        ("a", 30.0, "within 30 s"), ("b", None, "not shown"), ("d", 90.0, "within 2 min"), ("e", 540.0, "within 10 min"), ("f", None, "not shown")]
    left = sum(op["numRowsTotal"] for op in [p for p in query.recentProgress if p["stateOperators"]][-1]["stateOperators"])
    assert left <= 4  # the closing rows
