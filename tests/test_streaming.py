import os
import random
import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F, types as T

from farewheel.plans import registry
from farewheel.streaming import events as live, nudges, runtime
from paths import SMALL

SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])


class Feed:
    """A folder that receives one file per batch and a stream that reads it."""

    def __init__(self, spark, schema=SCHEMA):
        self.spark, self.schema = spark, schema
        self.root = tempfile.mkdtemp(prefix="farewheel-test-")
        self.source, self.table, self.checkpoint = (f"{self.root}/{n}" for n in ("in", "out", "chk"))
        os.mkdir(self.source)

    def add(self, *rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.source)

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(self.source)

    def run(self, build):
        df = build(self.stream())
        runtime.run_available(df, self.table, self.checkpoint)
        return sorted(tuple(r) for r in self.spark.read.schema(df.schema).parquet(self.table).collect())


def event(i, user, when, kind="view"):
    return (i, user, datetime.fromisoformat(when), kind, 0.0, '{"k": 1}')


@pytest.fixture
def feed(spark):
    return Feed(spark)


def test_funnel_counts_riders_once_and_drops_late_rows(feed):
    def build(s):
        return live.stream_funnel(live.funnel_events(s))

    feed.add(event(1, 1, "2024-01-01T00:30"), event(2, 1, "2024-01-01T23:30"), event(3, 2, "2024-01-01T12:00", "click"))
    feed.add(event(4, 3, "2024-01-01T13:00"), event(5, 9, "2024-01-03T00:00"))
    feed.add(event(6, 9, "2024-01-05T00:00"))
    # the watermark of the batch before has passed the first day: too late
    feed.add(event(7, 4, "2024-01-01T14:00"))
    day = datetime(2024, 1, 1).date()
    rows = feed.run(build)
    assert [r for r in rows if r[0] == day] == [(day, "cta_clicked", 1), (day, "cta_shown", 2)]
    assert len(rows) == 3
    # a restart finds nothing new
    assert feed.run(build) == rows


def test_sessions_close_after_the_gap(feed):
    def build(s):
        return live.stream_signup_sessions(live.funnel_events(s))

    feed.add(
        event(1, 1, "2024-01-01T10:00", "signup"), event(2, 1, "2024-01-01T10:20", "purchase"),
        event(3, 2, "2024-01-01T10:00", "signup"), event(4, 2, "2024-01-01T10:31", "purchase"),
        event(5, 3, "2024-01-01T10:00", "view"), event(6, 4, "2024-01-03T00:00", "signup"),
    )
    t = datetime(2024, 1, 1, 10)
    assert feed.run(build) == [
        (1, t, t + timedelta(minutes=50), 2, False),
        (2, t, t + timedelta(minutes=30), 1, True),
    ]


def test_redelivered_events_come_out_once(feed):
    def build(s):
        return live.stream_event_dedup(live.funnel_events(s))

    feed.add(event(1, 1, "2024-01-01T10:00"), event(1, 1, "2024-01-01T10:00"), event(2, 1, "2024-01-01T10:05"))
    feed.add(event(2, 1, "2024-01-01T10:05"), event(3, 1, "2024-01-01T11:00"))
    assert [r[0] for r in feed.run(build)] == [1, 2, 3]
    feed.add(event(3, 1, "2024-01-01T11:00"))
    assert [r[0] for r in feed.run(build)] == [1, 2, 3]


SIGNALS = "user_id long, ride_id string, at_us long, kind int, cents long"
FAR = 10_000


def signal(user, name, day, kind=nudges.RIDE, cents=100):
    return (user, name, int(day * nudges.DAY_US), kind, cents)


def users(spark):
    return spark.createDataFrame([(1, "Weekend Explorer"), (2, None)], "user_id long, persona_segment string")


def short(rows):
    return [(r[0], r[1], r[3], r[4], r[5]) for r in rows]


def test_nudge_state_survives_batches_and_restart(spark):
    feed = Feed(spark, SIGNALS)

    def fired():
        return short(feed.run(lambda s: nudges.stream_nudge_trigger(s, users(spark))))

    feed.add(signal(1, "a", 10.1), signal(1, "b", 12.0), signal(2, "x", 10.0), signal(2, "y", 45.0), signal(3, "m", 10.0))
    # rider 1: second ride in 30 days fires; rider 2's rides are too far apart
    assert fired() == [(1, "b", 2, 2.0, 1)]
    feed.add(
        signal(1, "c", 46.0), signal(1, "d", 46.5, nudges.DISMISSED), signal(1, "e", 47.0), signal(1, "f", 53.5),
        signal(1, "g", 54.0), signal(3, "m2", 46.2), signal(3, "n", 46.4, nudges.CONVERTED), signal(3, "o", 47.0), signal(9, "z", 80.0),
    )
    # c is alone in its window, e is snoozed, f is not any more; g is the third; members get none
    want = [(1, "b", 2, 2.0, 1), (1, "f", 3, 3.0, 2), (1, "g", 4, 4.0, 3)]
    assert fired() == want
    feed.add(signal(1, "h", 81.0), signal(1, "i", 81.1), signal(9, "z2", 200.0))
    assert fired()[:3] == want and len(fired()) == 3


def test_nudge_says_what_a_membership_costs(spark):
    feed = Feed(spark, SIGNALS)
    feed.add(signal(1, "a", 1.0, cents=400), signal(1, "b", 2.0, cents=600), signal(2, "c", 1.0, cents=0), signal(2, "d", 2.0, cents=0), signal(9, "z", FAR))
    rows = feed.run(lambda s: nudges.stream_nudge_trigger(s, users(spark)))
    assert [r[6:] for r in rows] == [(8.75, 19, "Weekend Explorer"), (8.75, None, None)]


def test_third_dismissal_ends_it(spark):
    feed = Feed(spark, SIGNALS)
    feed.add(signal(1, "a", 1.0), *[signal(1, f"d{i}", 1.1 + i, nudges.DISMISSED) for i in range(3)], signal(1, "b", 20.0), signal(1, "c", 21.0), signal(9, "z", FAR))
    assert feed.run(lambda s: nudges.stream_nudge_trigger(s, users(spark))) == []


def test_decisions_do_not_depend_on_micro_batches(spark):
    rnd = random.Random(5)
    rows = [signal(u, f"{u}-{i}", rnd.randrange(0, 9000) / 100, rnd.choice([nudges.RIDE] * 8 + [nudges.DISMISSED]), rnd.randrange(0, 900))
            for u in range(12) for i in range(rnd.randrange(1, 25))]
    rows += [signal(u, f"{u}-m", rnd.randrange(3000, 9000) / 100, nudges.CONVERTED) for u in range(0, 12, 4)]
    results = []
    for files, per_trigger in ((1, 1), (13, 1), (13, 3), (13, 64)):
        rnd.shuffle(rows)
        feed = Feed(spark, SIGNALS)
        for i in range(files):
            feed.add(*rows[i::files])
        source = lambda: spark.readStream.schema(SIGNALS).option("maxFilesPerTrigger", per_trigger).parquet(feed.source)  # noqa: E731, B023
        end = spark.createDataFrame([signal(-1, "", FAR)], SIGNALS)
        shown = runtime.replay(spark, lambda closing: nudges.stream_nudge_trigger(
            source().unionByName(closing), users(spark), lateness="200 days"), end, "test")  # noqa: B023
        results.append(sorted(map(tuple, shown.collect())))
    assert results[0] and all(r == results[0] for r in results)


def test_riders_share_state_keys_and_are_decided_alone(spark):
    rnd = random.Random(7)
    rows = {signal(u, f"{u}-{i}", rnd.randrange(0, 9000) / 100, rnd.choice([nudges.RIDE] * 8 + [nudges.DISMISSED, nudges.CONVERTED]), rnd.randrange(0, 900))
            for u in range(300) for i in range(rnd.randrange(1, 12))}
    alone = nudges.NudgeProcessor()
    want = sorted(x for u in range(300) for x in alone._decide(u, sorted(r[2:3] + (r[3], r[1], r[4]) for r in rows if r[0] == u), None)[0])
    feed = Feed(spark, SIGNALS)
    for month in range(3):  # the last five days of each wait for the next
        feed.add(*[r for r in rows if r[2] // nudges.DAY_US // 30 == month])
    for day in (100, 200):  # at the second nothing waits any more, windows end
        feed.add(signal(-1, "", day))
    df = nudges.stream_nudge_trigger(feed.stream(), users(spark), lateness="5 days", groups=4)
    query = runtime.start(df, feed.table, feed.checkpoint, availableNow=True)
    query.awaitTermination()
    got = sorted((r.user_id, r.ride_id, r.rides_30d, r.spend_30d, r.impression) for r in spark.read.schema(df.schema).parquet(feed.table).collect())
    assert got == sorted((u, ride, n, c / 100, i) for u, ride, _, n, c, i in want) and len(got) > 300
    # of each group riders, waiting signals and two rows for the timer
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) <= 4 * 5


def test_one_rider_with_very_many_rides(spark):
    processor = nudges.NudgeProcessor(nudges.NudgeRules(impression_cap=10**9))
    due = sorted(signal(1, str(i), i / 40_000)[2:3] + (nudges.RIDE, str(i), 1) for i in range(200_000))
    shown, (impressions, _, _, _, days) = processor._decide(1, due, None)
    assert impressions == len(shown) == 199_999 and len(days) <= 30


def test_signals_from_separate_streams_and_fractions_of_a_second(spark, build):
    rides = build.rides((1, "2023-12-01T08:00", 30), (1, "2023-12-01T09:00", 30, "Annual Member"))
    events = build.events((1, "cta_dismissed", "2023-12-01T08:30:00.250"), (1, "cta_shown", "2023-12-01T08:31"))
    rows = nudges.ride_signals(rides, events, "cta_dismissed").orderBy("at_us").collect()
    assert [(r.kind, r.cents) for r in rows] == [(nudges.RIDE, 220), (nudges.DISMISSED, 0)]
    assert rows[1].at_us - rows[0].at_us == 250_000
    assert rows[0].at_us == (datetime(2023, 12, 1, 8, 30) - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def test_wall_clock_round_trip(spark):
    # 2:30 does not exist in this zone on that day
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.5' AS ts").select(
        runtime.utc_as_wall_clock(runtime.wall_clock_as_utc("ts")).alias("back"), "ts")
    row = df.first()
    assert row.back == row.ts
    assert df.select(F.unix_micros(runtime.wall_clock_as_utc("ts"))).first()[0] % 86_400_000_000 == (2 * 3600 + 1800) * 1_000_000 + 500_000


def test_the_nudge_stream_copies_only_what_it_reads(spark, monkeypatch):
    class Enough(Exception):
        pass

    copied = []

    def append(rows, path):
        copied.append(rows.columns)
        if len(copied) == 2:
            raise Enough

    monkeypatch.setattr(registry.storage, "append_rows", append)
    with pytest.raises(Enough):
        registry.stream_nudge_trigger(spark, SMALL)
    assert copied == [
        ["user_id", "ride_id", "user_type", "ended_at", "ride_cost_cad"], ["user_id", "event_id", "event_type", "event_at"]]


def test_rows_for_a_stream_are_added_compressed(spark, tmp_path):
    for i in range(2):
        registry.storage.append_rows(spark.range(i, i + 1).coalesce(1), str(tmp_path / "feed"))
    files = [f for f in os.listdir(tmp_path / "feed") if f.endswith(".parquet")]
    assert len(files) == 2 and all(".zstd." in f for f in files)
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "feed")).collect()) == [0, 1]
