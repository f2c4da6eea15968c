"""Keyed upserts and the profiles that are kept with them."""

import random
from dataclasses import replace
from datetime import date, datetime, timedelta

import pytest

from farewheel.functions.columns import ts
from farewheel.operators import incremental, segmentation
from farewheel.params import DEFAULTS
from farewheel.sources.versioned import VersionedTable

SCHEMA = "user_id long, persona string, visits int"


@pytest.fixture
def users(spark, tmp_path):
    rows = [(i, "old" if i % 2 else None, i) for i in range(100)]
    return VersionedTable.create(spark.createDataFrame(rows, SCHEMA), str(tmp_path / "users"), "user_id", "first", buckets=8)


def rows(df):
    return {r.user_id: (r.persona, r.visits) for r in df.collect()}


def change(spark, *pairs):
    return spark.createDataFrame(list(pairs), "user_id long, persona string")


def test_upsert_changes_inserts_and_keeps(spark, users):
    before = rows(users.read())
    assert users.upsert(change(spark, (3, "new"), (4, None), (500, "guest"), (None, "lost"), (7, "a"), (7, "b")), "night 1") == 2
    now = rows(users.read())
    assert now == before | {3: ("new", 3), 500: ("guest", None), 7: ("b", 7)}
    assert rows(users.read(1)) == before
    assert users.upsert(change(spark, (600, "x"), (3, "newer")), "night 2", insert=False) == 3
    assert rows(users.read()) == now | {3: ("newer", 3)}
    # only the bucket of rider 3 was written again
    assert users.manifest()["rewritten"] == 1
    second, third = users.manifest(2)["folders"], users.manifest(3)["folders"]
    assert sum(second[b] != third[b] for b in second) == 1


def test_a_repeated_run_and_an_empty_one_change_no_file(spark, users):
    users.upsert(change(spark, (3, "new")), "night 1")
    folders = users.manifest()["folders"]
    assert users.upsert(change(spark, (3, "something else")), "night 1") == 2
    assert users.upsert(change(spark, (3, "new"), (1, "old")), "night 2") == 3
    assert users.manifest()["folders"] == folders and users.manifest()["rewritten"] == 0


def test_a_run_that_dies_leaves_the_old_version(spark, users, monkeypatch):
    before = rows(users.read())
    monkeypatch.setattr(VersionedTable, "_commit", lambda self, manifest: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        users.upsert(change(spark, (3, "half done")), "night 1")
    monkeypatch.undo()
    assert users.version() == 1 and rows(users.read()) == before
    # a commit file that was begun and not finished is passed over, its number stays taken
    users._files().create(users._hadoop(f"{users.path}/versions/000000000002.json"), False).close()
    assert users.version() == 1
    assert users.upsert(change(spark, (3, "done")), "night 1") == 3
    assert rows(users.read())[3] == ("done", 3)


def test_the_second_of_two_writers_starts_again(spark, users, monkeypatch):
    other = VersionedTable(spark, users.path)
    real, done = VersionedTable._commit, []

    def late(self, manifest):
        if self is users and not done:
            done.append(other.upsert(change(spark, (5, "other")), "other's night"))
        return real(self, manifest)

    monkeypatch.setattr(VersionedTable, "_commit", late)
    assert users.upsert(change(spark, (3, "mine")), "my night") == 3
    assert (rows(users.read())[5][0], rows(users.read())[3][0]) == ("other", "mine")


def test_empty_tables(spark, tmp_path):
    table = VersionedTable.create(spark.createDataFrame([], SCHEMA), str(tmp_path / "none"), "user_id", "first")
    assert table.read().collect() == []
    table.upsert(change(spark, (1, "a")), "second")
    assert rows(table.read()) == {1: ("a", None)}
    with pytest.raises(FileNotFoundError):
        VersionedTable(spark, str(tmp_path / "nowhere")).read()


def ride_history(build, seed, days=120, riders=12):
    rng = random.Random(seed)
    start = datetime(2023, 9, 1)
    out = []
    for _ in range(700):
        at = start + timedelta(days=rng.randrange(days), minutes=rng.randrange(1440))
        kind = "Annual Member" if rng.random() < 0.1 else "Casual Member"
        out.append((rng.randrange(riders), at.isoformat(), rng.randrange(1, 50), kind, rng.choice(["EFIT", "ICONIC"]), f"{rng.randrange(100, 900) / 100:.2f}"))
    return build.rides(*out)


def test_thirty_nights_equal_full_recomputation(spark, build, tmp_path):
    rides = ride_history(build, 3).cache()
    first = date(2023, 11, 20)
    state = incremental.start_profiles(rides, str(tmp_path / "state"), replace(DEFAULTS, as_of=first), buckets=4)
    for night in range(1, 31):
        p = replace(DEFAULTS, as_of=first + timedelta(days=night))
        incremental.advance_profiles(state, rides, p)
        if night in (1, 11, 12, 21, 30):  # months end in between
            want = segmentation.rider_profiles(rides.filter(rides.started_at < ts(p.as_of + timedelta(days=1))), p, 60)
            got = incremental.profiles_from_state(state.read(), p)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))
    assert state.version() == 31
    assert incremental.advance_profiles(state, rides, p) == 31  # a night that is done
    with pytest.raises(ValueError):
        incremental.advance_profiles(state, rides, replace(p, as_of=p.as_of + timedelta(days=2)))
    with pytest.raises(ValueError):
        incremental.start_profiles(rides, str(tmp_path / "long"), p, lookback=90)


def test_a_night_reads_two_days(spark):
    from farewheel.plans.inspect import plan_shape
    from farewheel.plans.registry import open_tables
    from paths import SMALL

    night = incremental._days_between(open_tables(spark, SMALL).rides, date(2023, 12, 31), date(2023, 12, 31))
    shape = plan_shape(night)
    assert all(">= 2023-12-01" in f and "<= 2023-12-01" in f for f in shape.partition_filters) and shape.partition_filters
    assert night.count() == night.filter("to_date(started_at) = DATE'2023-12-31'").count() > 0
