"""As-of joins, the ordered funnel and gaps in event numbers against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from farewheel.functions.asof import join_latest
from farewheel.operators import attribution, delivery, nudges, ordered

T0 = datetime(2023, 10, 1)


@pytest.mark.parametrize("strict", [False, True])
def test_latest_row_of_the_same_key(spark, strict):
    rng = random.Random(1)
    moment = lambda: T0 + timedelta(minutes=rng.randrange(0, 60 * 24 * 9, 30))
    left = [(i, rng.choice([1, 2, 3, None]), moment() if i % 17 else None) for i in range(200)]
    right = [(rng.choice([1, 2, None]), moment() if i % 23 else None, f"c{rng.randrange(4)}") for i in range(150)]
    want = []
    for i, k, t in left:
        seen = [(s, c) for q, s, c in right if k is not None and q == k and s is not None and t is not None and (s < t or (s == t and not strict))]
        want.append((i, *(max(seen) if seen else (None, None))))
    got = join_latest(
        spark.createDataFrame(left, "id int, user long, at timestamp_ntz").repartition(4),
        spark.createDataFrame(right, "user long, seen timestamp_ntz, channel string").repartition(3),
        "user", "at", "seen", ["channel"], strict)
    assert got.columns == ["id", "user", "at", "seen", "channel"]
    assert sorted(map(tuple, got.select("id", "seen", "channel").collect())) == sorted(want)


def test_last_touch_owns_the_conversion(build):
    events = build.events(
        (1, "cta_shown", "2023-12-01T10:00", "email"), (1, "cta_clicked", "2023-12-02T10:00", "geo_offer"), (1, "cta_shown", "2023-12-05T00:00", "organic"),
        (1, "signup_completed", "2023-12-03T10:00"), (1, "signup_completed", "2023-12-20T10:00"),
        (2, "cta_shown", "2023-10-01T10:00", "email"), (2, "signup_completed", "2023-12-03T10:00"), (3, "signup_completed", "2023-12-03T10:00"))
    got = {r.last_touch_channel: tuple(r)[1:] for r in attribution.conversion_by_last_touch(events).collect()}
    assert got == {"geo_offer": (1, 1, 1.0, 24.0), "no touch": (2, 0, None, None), "email": (0, 2, 0.0, None), "organic": (0, 1, 0.0, None)}


def furthest(events, limits):
    """State by state, as the rules say."""
    state, since, best = 0, 0, 0
    last = len(limits) + 1
    for at, step in sorted(events):
        day = (at - datetime(1970, 1, 1)).days
        if 0 < state < last and day - since > limits[state - 1]:
            state = 0
        if state < last and (step == state + 1 or step == state == 1):
            state, since, best = step, day, max(best, step)
    return best


@pytest.mark.parametrize("limits", [(30, 30, 30), (2, 0, 5)])
def test_composed_tables_equal_one_fold(spark, limits):
    rng = random.Random(sum(limits))
    rows = []
    for user in range(30):
        for _ in range(rng.randrange(1, 90)):
            at = T0 + timedelta(days=rng.choice([0, 1, 2, 3, 4, 5, 33, 40, 70]), hours=rng.randrange(3), minutes=rng.randrange(0, 60, 20))
            rows.append((user, rng.randrange(1, 5), at))
    want = {u: furthest([(t, s) for v, s, t in rows if v == u], limits) for u in range(30)}
    steps = ordered.STEPS
    events = spark.createDataFrame(
        [(u, steps[s - 1], t) for u, s, t in rows] + [(None, steps[0], T0), (99, steps[1], None), (98, "other", T0)],
        "user_id long, event_type string, event_at timestamp_ntz").repartition(4)
    for rows_per_task in (10**6, 0, 30):  # all folded, all composed, both
        got = {r.user_id: r.furthest for r in ordered.furthest_steps(events, limits, rows_per_task).collect()}
        assert got == want
    assert len(set(want.values())) > 2


def test_a_rider_with_many_events_is_cut_into_hours(spark):
    """No list of the composed path holds more than one hour of a rider."""
    rows = spark.range(50_000).select(
        F.lit(1).cast("long").alias("user_id"), F.when(F.col("id") % 2 == 0, "cta_shown").otherwise("cta_clicked").alias("event_type"),
        (F.lit("2023-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 300).cast("int"), (F.col("id") % 24).cast("int"), F.lit(0), (F.col("id") / 50_000).cast("decimal(18,6)"))).alias("event_at"))
    flow = ordered._flow(rows)
    assert flow.groupBy("user_id", "day", F.hour("event_at")).count().agg(F.max("count")).first()[0] < 100
    assert [tuple(r) for r in ordered.furthest_steps(rows, rows_per_task=1000).collect()] == [(1, 2)]


@pytest.mark.parametrize("block", [1, 7, 1 << 16])
def test_islands_across_blocks(spark, block):
    rng = random.Random(block)
    ids = sorted(rng.sample(range(-30, 200), 120))
    rows = [(i, T0 + timedelta(minutes=i)) for i in ids] + [(ids[5], T0 - timedelta(days=3)), (None, T0)]
    want, start = [], ids[0]
    for a, b in zip(ids, [*ids[1:], None]):
        if b is None or b != a + 1:
            want.append((start, a))
            start = b
    got = sorted((r.first, r.last, r.lost_before) for r in delivery.islands(
        spark.createDataFrame(rows, "event_id long, ts timestamp_ntz").repartition(3), "event_id", "ts", block).collect())
    assert [g[:2] for g in got] == want
    assert [g[2] for g in got] == [0] + [b[0] - a[1] - 1 for a, b in zip(want, want[1:])]


def test_delivery_of_a_day(spark):
    rows = [(i, T0 + timedelta(hours=i)) for i in (0, 1, 2, 5, 5, 23, 24, 30)]
    got = [tuple(r) for r in delivery.delivery_rate(spark.createDataFrame(rows, "event_id long, ts timestamp_ntz"), block=4).orderBy("event_day").collect()]
    assert got == [
        (T0.date(), 5, 1, 2 + 17, 2, 17, round(5 / 24, 6), False), ((T0 + timedelta(days=1)).date(), 2, 0, 5, 1, 5, round(2 / 7, 6), False)]
    assert delivery.delivery_rate(spark.createDataFrame([], "event_id long, ts timestamp_ntz")).count() == 0


def test_channel_after_three_dismissals(build):
    rides = build.rides(*[(u, f"2023-12-2{i}T10:00") for u in (1, 2, 3) for i in range(3)])
    events = build.events(
        *[(1, "cta_dismissed", f"2023-12-0{i}T10:00", "email", "treatment") for i in range(1, 4)],
        *[(2, "cta_dismissed", f"2023-12-0{i}T10:00", "email", "control") for i in range(1, 4)], (2, "signup_completed", "2023-12-09T10:00"))
    got = {r.user_id: (r.channel, r.dismissals, r.ab_variant) for r in nudges.nudge_channels(rides, events).collect()}
    assert got[1] == ("email_receipt", 3, "treatment") and got[2] == (None, 3, "control")
    assert got[3][0] == "in_app" and got[3][2] in ("control", "treatment")
