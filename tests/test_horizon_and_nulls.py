"""Rows after as_of change nothing; NULL durations, costs and riders mean what SQL says."""

import inspect
from datetime import date

import duckdb
import pytest
from pyspark.sql import functions as F

from paths import SMALL
from farewheel.functions import horizon
from farewheel.functions.columns import ts
from farewheel.functions.horizon import known_by
from farewheel.model import Tables
from farewheel.operators import economics, exploration, funnel, growth, nudges, retention, segmentation
from farewheel.params import Params, Pricing
from farewheel.plans.registry import TABLE_QUERIES
from farewheel.sources.warehouse import open_tables

AS_OF = date(2023, 6, 30)
# iterative fits are slow and read the same cut features as cluster_features
FITS = {"cluster_k_sweep", "cluster_profiles", "cluster_centres", "cluster_continuous", "cluster_labels", "persona_feature_profile"}


@pytest.fixture(scope="module")
def both(spark):
    """Stored tables that end on AS_OF, and the whole ones with what comes later."""
    whole = open_tables(spark, SMALL)
    return Tables(*[known_by(t, AS_OF) for t in (whole.rides, whole.membership_events, whole.users, whole.app_events)]), whole


@pytest.mark.parametrize("name", [q for q in TABLE_QUERIES if q not in FITS])
def test_later_rows_change_nothing(both, name, monkeypatch):
    monkeypatch.setattr(horizon, "DEFAULTS", Params(as_of=AS_OF))
    seen = []
    for tables in both:
        query = TABLE_QUERIES[name]
        # every operator takes its day from p, or from DEFAULTS of the cut
        source = inspect.getclosurevars(query).globals
        module = next(m for m in source.values() if inspect.ismodule(m))
        for fname, f in vars(module).items():
            if callable(f) and hasattr(f, "__wrapped__") and "p" in inspect.signature(f).parameters:
                def on_that_day(*a, _f=f, **k):
                    given = inspect.signature(_f).bind(*a, **k).arguments
                    return _f(*a, **(k if "p" in given else k | {"p": Params(as_of=AS_OF)}))
                monkeypatch.setattr(module, fname, on_that_day)
        seen.append(sorted(map(repr, query(tables).collect())))
        monkeypatch.undo()
        monkeypatch.setattr(horizon, "DEFAULTS", Params(as_of=AS_OF))
    assert seen[0] == seen[1]


def rides_with_nulls(build):
    return build.rides(*[(1, f"2023-12-{d:02d} 08:00", m, "Casual Member", b, "2.20") for d, (m, b) in enumerate(
        [(10.0, "ICONIC"), (20.0, "ICONIC"), (743 / 60, "EFIT"), (744 / 60, "EFIT")], 1)]).unionByName(
        build.rides((1, "2023-12-20 08:00", 1.0, "Casual Member", "ICONIC", "2.20"), (2, "2023-12-21 08:00", 1.0, "Casual Member", "ICONIC", "2.20"))
        .withColumn("duration_min", F.lit(None).cast("double")).withColumn("ride_cost_cad", F.lit(None).cast("decimal(10,2)")))


def test_null_durations_are_in_no_bin(build):
    rides = rides_with_nulls(build)
    assert sum(r.rides for r in exploration.duration_histogram(rides).collect()) == 4
    box = exploration.duration_box(rides).collect()[0]
    stats = exploration.duration_stats(rides).collect()[0]
    durations = [10.0, 20.0, 743 / 60, 744 / 60]
    con = duckdb.connect()
    median, mean, std = con.execute("SELECT quantile_cont(x, 0.5), avg(x), stddev_samp(x) FROM (SELECT unnest(?) AS x)", [durations]).fetchone()
    assert box.median == stats.median == round(median, 2)
    assert box["mean"] == stats["mean"] == round(mean, 2) and stats.std == round(std, 2) and stats["count"] == 4
    assert sum(r.rides for r in exploration.cost_histogram(rides).collect()) == 4


def test_seconds_are_kept_in_prices(build):
    rides = build.rides(*[(1, f"2023-{1 + i % 9:02d}-{1 + i % 27:02d} 10:00", 743 / 60, "Annual Member", "ICONIC", "0.00") for i in range(300)])
    events = build.events((1, "signup_completed", "2023-01-01 00:00"))
    row = retention.member_ytd_savings(rides, build.users((1, None)), events).collect()[0]
    assert row.equivalent_casual_cost_cad == round(300 + 300 * 743 / 60 * 0.12, 2)
    untimed = rides.withColumn("duration_min", F.when(F.col("started_at") < ts("2023-02-01"), F.col("duration_min")))
    timed = untimed.filter("duration_min IS NOT NULL").count()
    row = retention.member_ytd_savings(untimed, build.users((1, None)), events).collect()[0]
    assert row.ytd_rides == 300 and row.equivalent_casual_cost_cad == round(timed + timed * 743 / 60 * 0.12, 2)
    gap = economics.ebike_price_gap(rides_with_nulls(build)).collect()
    assert [r.duration_min for r in gap] == [743 / 60, 744 / 60]
    means = {r.user_type: r for r in segmentation.ebike_savings(rides_with_nulls(build)).collect()}
    assert means["Casual Member"].avg_savings_per_ride == round(1 + 743.5 / 60 * 0.1, 2)


def test_nobody_is_not_a_rider(build):
    rides = build.rides((1, "2023-12-05 10:00"), (None, "2023-12-05 11:00"), (None, "2023-12-06 11:00"))
    events = build.events((1, "cta_shown", "2023-12-05 12:00"), (None, "cta_shown", "2023-12-05 12:00"), (None, "cta_clicked", "2023-12-05 12:00"),
                          (None, "signup_started", "2023-12-05 12:00"))
    daily = {r.event_date: r for r in funnel.funnel_daily(rides, events).collect()}
    assert daily[date(2023, 12, 5)].casual_riders == 1 and daily[None].casual_riders == 0
    assert [r.users_exposed for r in funnel.funnel_by_channel_variant(events).collect()] == [1]
    surface = growth.ctr_by_surface(events).collect()[0]
    assert (surface.impressions, surface.clicks, surface.users_shown, surface.users_clicked) == (2, 1, 1, 0)
    assert [(r.casual_riders, r.exposed_riders) for r in growth.cta_exposure_monthly(rides, events).collect()] == [(1, 1)]
    assert [r.riders for r in economics.funnel_shares(rides, events).collect()] == [1, 1, 0, 0, 0]
    assert growth.step_completion(events).collect()[0].users_in == 0


def test_months_and_leap_days():
    assert Params(as_of=date(2024, 2, 29)).months_ago(12) == date(2023, 2, 28)
    assert Params(as_of=date(2023, 12, 31)).months_ago(6) == date(2023, 6, 30)
    assert Params(as_of=date(2024, 1, 31)).months_ago(1) == date(2023, 12, 31)


def test_short_windows_and_fees(build):
    rides = build.rides(*[(i, "2023-12-05 10:00") for i in range(60)])
    rows = economics.arr_scenarios(rides, months=6).collect()
    assert all(r.monthly_casual_rides == 10.0 for r in rows)
    current = [r for r in rows if r.scenario.startswith("Current")]
    assert all(r.incremental_members_per_month == 0 and r.incremental_arr_k == 0 for r in current)
    p = Params(pricing=Pricing(annual_fee=179.0))
    some = build.rides((1, "2023-12-05 10:00", 10.0, "Casual Member", "ICONIC", "2.20"), (1, "2023-12-06 10:00", 10.0, "Casual Member", "ICONIC", "2.20"),
                       (2, "2023-12-06 10:00", 10.0, "Casual Member", "ICONIC", "20.00"), (3, "2023-12-06 10:00", 0.0, "Casual Member", "ICONIC", "0.00"),
                       (3, "2023-12-07 10:00", 0.0, "Casual Member", "ICONIC", "0.00"))
    text = {r.user_id: r for r in nudges.nudge_message(some, build.events(), p).collect()}
    assert text[1].message.startswith("Annual membership: $14.92/month.") and text[1].membership_per_month == 14.92
    assert "saves you $64 a year" in text[2].message
    assert text[3].message is not None and text[3].rides_to_breakeven is None
    fee = Params(pricing=Pricing(annual_fee=99.50))
    member = build.rides((1, "2023-12-05 10:00", 10.0, "Annual Member", "ICONIC", "0.00"))
    assert retention.member_ytd_savings(member, build.users((1, None)), build.events((1, "signup_completed", "2023-01-01 00:00")), fee).collect()[0].annual_membership_fee == 99.5


def test_a_sign_up_after_as_of_has_no_credits(build):
    events = build.events((1, "signup_completed", "2024-02-03 10:00", "email", "control", None, "weekend"))
    assert nudges.weekday_credit_balance(build.rides((1, "2023-12-05 10:00", 5.0, "Annual Member")), events).count() == 0
