"""Hot riders: split joins and hour blocks against brute force."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from farewheel.functions.blocks import previous_and_running_max
from farewheel.functions.skew import join_hot_keys
from farewheel.operators import growth, telemetry


def stamps(seed, users, n, days=70):
    rng = random.Random(seed)
    start = datetime(2023, 10, 1)
    # half of the rows belong to rider 1
    return [(1 if rng.random() < 0.5 else rng.randrange(2, users), start + timedelta(minutes=rng.randrange(days * 1440))) for _ in range(n)]


def test_split_join_equals_plain_join(spark):
    fact = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(1000)], "k long, v long")
    dim = spark.createDataFrame([(k, k * 10) for k in range(0, 500, 3)] + [(1, 10)], "k long, w long")
    plain = sorted(map(tuple, fact.join(dim, "k").collect()))
    for rows_per_task in (1, 40, 10_000):
        got = join_hot_keys(fact, dim, "k", ["v"], rows_per_task)
        assert sorted(map(tuple, got.collect())) == plain


def test_hot_key_is_spread_over_partitions(spark):
    fact = spark.createDataFrame([(1, i) for i in range(4000)], "k long, v long")
    dim = spark.createDataFrame([(1, 10)], "k long, w long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in join_hot_keys(fact, dim, "k", ["v"], 100)
                 .groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sum(sizes) == 4000 and len(sizes) == 4 and max(sizes) < 2500


def test_trailing_30_days_against_brute_force(build):
    rides = stamps(1, 6, 120)
    events = stamps(2, 6, 60)
    # exact edges: a ride at the event, 30 days before it, and one minute earlier
    rides += [(7, datetime(2023, 11, 1, 10)), (7, datetime(2023, 10, 2, 10)), (7, datetime(2023, 10, 2, 9, 59))]
    events += [(7, datetime(2023, 11, 1, 10)), (8, datetime(2023, 11, 1))]
    df = telemetry.hashed_user_events(
        build.rides(*[(u, t.isoformat()) for u, t in rides]), build.users((1, "A")),
        build.events(*[(u, "cta_shown", t.isoformat()) for u, t in events]), salt="s",
    )
    got = {r.event_id: (r.ride_count_30d, r.cumulative_spend_30d) for r in df.collect()}
    assert len(got) == len(events)
    for i, (user, when) in enumerate(events):
        n = sum(u == user and when - timedelta(days=30) <= t <= when for u, t in rides)
        assert got[f"e{i}"] == (n, n * 220 / 100)


def test_step_times_against_brute_force(build):
    kinds = ["signup_started", "signup_step_completed", "signup_abandoned", "signup_completed"]
    rng = random.Random(3)
    events = [(u, rng.choice(kinds), t) for u, t in stamps(4, 5, 150, days=3)]
    df = telemetry.time_in_step(build.events(*[(u, k, t.isoformat()) for u, k, t in events]))
    got = {r.event_id: (r.time_on_step_seconds, r.time_in_flow_seconds) for r in df.collect()}
    for user in {u for u, _, _ in events}:
        own = sorted((t, f"e{i}", k) for i, (u, k, t) in enumerate(events) if u == user)
        before = start = None
        for when, event_id, kind in own:
            if kind == "signup_started":
                start = when
            on_step = None
            if kind != "signup_started" and before and start and before >= start:
                on_step = (when - before).total_seconds()
            in_flow = (when - start).total_seconds() if start else None
            assert got[event_id] == (on_step, in_flow)
            before = when


def test_blocks_carry_over_gaps(spark):
    rows = [(1, datetime(2023, 1, 1, 0, 30), 5), (1, datetime(2023, 1, 9, 4), None), (1, datetime(2023, 1, 9, 4, 1), 3)]
    df = spark.createDataFrame(rows, "u long, t timestamp_ntz, v long")
    got = previous_and_running_max(df, "u", "t", ["t"], "prev", {"m": "v"}).orderBy("t").collect()
    assert [r.prev for r in got] == [None, rows[0][1], rows[1][1]] and [r.m for r in got] == [5, 5, 5]


def test_post_conversion_rides_with_split_rider(build):
    rides = build.rides(*[(1, f"2023-03-{d:02d}T08:00") for d in range(1, 31)], (2, "2023-03-10T08:00"))
    events = build.events((1, "signup_completed", "2023-03-10T08:00"), (2, "signup_completed", "2023-03-10T08:01"), (3, "signup_completed", "2023-11-01T00:00"))
    users = build.users((1, "A"), (2, "A"), (3, "A"))
    for rows_per_task in (4, 10**6):
        row = growth.post_conversion_rides_90d(rides, users, events, rows_per_task=rows_per_task).collect()[0]
        assert (row.members, row.avg_rides_90d, row.members_at_target) == (2, 10.5, 1)


def test_hot_and_other_riders_alike(spark, build):
    rides, events = stamps(5, 9, 300), stamps(6, 9, 150)
    tables = (
        build.rides(*[(u, t.isoformat()) for u, t in rides], (None, "2023-10-05T10:00")), build.users((1, "A"), (2, "B"), (2, "C")),
        build.events(*[(u, "cta_shown", t.isoformat()) for u, t in events], (None, "cta_shown", "2023-10-05T10:00")),
    )
    got = [sorted(map(tuple, telemetry.hashed_user_events(*tables, salt="s", rows_per_user=most).collect()), key=repr)
           for most in (0, 100, 10**6)]
    assert len(got[0]) == len(events) + sum(u == 2 for u, _ in events) and got[0] == got[1] == got[2]


def test_a_riders_history_is_shuffled_once(spark, build):
    df = telemetry.hashed_user_events(
        build.rides((1, "2023-10-05T10:00")), build.users((1, "A")), build.events((1, "cta_shown", "2023-10-05T11:00")), salt="s", rows_per_user=10**6)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        cold = df._jdf.queryExecution().executedPlan().toString().split("LeftAnti")[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert cold.count("Exchange hashpartitioning(user_id") == 1
