from datetime import date

from farewheel.operators import economics, experiments, growth, nudges


def test_north_star_window_edges_and_censoring(build):
    rides = build.rides(*[(u, "2023-01-01T08:00") for u in (1, 2, 3, 4)])
    users = build.users((1, None, "2023-01-01T08:00"), (2, None, "2023-01-01T08:00"), (3, None, "2023-01-01T08:00"), (4, None, "2023-10-03T08:00"))
    events = build.events((1, "signup_completed", "2023-04-01T08:00"), (2, "signup_completed", "2023-04-01T08:01"), (3, "signup_completed", "2022-12-31T00:00"), (4, "signup_completed", "2023-10-04T00:00"))
    rows = [(r.first_ride_month, r.riders, r.converted) for r in growth.north_star_90d(rides, users, events).collect()]
    assert rows == [(None, 3, 1), (date(2023, 1, 1), 3, 1)]


def test_step_completion_counts_riders_once_and_shows_empty_steps(build):
    meta = '{"step": "%s"}'
    events = build.events(
        (1, "signup_started", "2023-12-10T10:00"), (1, "signup_started", "2023-12-11T10:00"), (2, "signup_started", "2023-12-11T10:00"),
        (1, "signup_step_completed", "2023-12-10T10:00", "email", "a", meta % 2),
        (1, "signup_step_completed", "2023-12-10T10:00", "email", "a", meta % "x"),
        (1, "signup_completed", "2023-12-10T10:00"),
    )
    rows = {r.step: (r.users_in, r.users_out, r.completion_rate) for r in growth.step_completion(events).collect()}
    assert rows == {"1": (2, 1, 0.5), "2": (1, 0, 0.0), "3": (0, 0, None), "4": (0, 1, None), "overall": (2, 1, 0.5)}


def test_renewal_needs_a_second_signup_in_the_window(build):
    events = build.events(
        (1, "signup_completed", "2022-01-10T00:00"), (1, "signup_completed", "2022-12-06T00:00"),  # day 330
        (2, "signup_completed", "2022-01-10T00:00"), (2, "signup_completed", "2022-12-05T00:00"),  # day 329
        (3, "signup_completed", "2023-06-01T00:00"),  # window not over
    )
    rows = [(str(r.cohort_month), r.members, r.renewed) for r in growth.renewal_rate(events).collect()]
    assert rows == [("2022-01-01", 2, 1)]


def eligibility(build, events, rides=2, **rules):
    table = build.rides(*[(1, "2023-12-20T08:00")] * rides)
    row = nudges.nudge_eligibility(table, build.events(*events, (9, "cta_shown", "2023-01-01T00:00")), **rules).collect()[0]
    return row.suppressed_by


def test_nudge_rules(build):
    shown = [(1, "cta_shown", "2023-12-01T00:00")]
    away = [(1, "cta_dismissed", "2023-11-01T00:00")]
    assert eligibility(build, shown * 2) is None
    assert eligibility(build, shown * 3) == "impression_cap"
    assert eligibility(build, shown * 3, impression_cap=4) is None
    assert eligibility(build, [], rides=1) == "too_few_rides"
    assert eligibility(build, [(1, "signup_completed", "2023-01-01T00:00")]) == "member"
    assert eligibility(build, away * 3) == "dismissed"
    assert eligibility(build, [(1, "cta_dismissed", "2023-12-24T00:00")]) is None
    assert eligibility(build, [(1, "cta_dismissed", "2023-12-24T00:01")]) == "snoozed"


def test_eligible_riders_grow_with_the_cap(build):
    rides = build.rides(*[(u, "2023-12-20T08:00") for u in range(1, 8) for _ in range(2)])
    events = build.events(*[(u, "cta_shown", "2023-12-01T00:00") for u in range(1, 8) for _ in range(u)])
    sizes = [nudges.nudge_eligibility(rides, events, impression_cap=c).filter("eligible").count() for c in range(1, 9)]
    assert sizes == sorted(sizes) and sizes[-1] == 7


def test_nudge_messages(build):
    ride = ("2023-12-20T08:00", 10, "Casual Member", "ICONIC")
    rides = build.rides(
        (1, *ride, "5.00"), (1, *ride, "5.00"), (2, *ride, "60.00"), (2, *ride, "60.00"), (3, *ride, "4.00"), (4, *ride, "4.00"))
    rows = {r.user_id: r for r in nudges.nudge_message(rides, build.events((4, "signup_completed", "2023-01-01T00:00"))).collect()}
    assert set(rows) == {1, 2, 3}
    assert rows[1].rides_to_breakeven == 19 and "19 rides from breaking even" in rows[1].message
    assert rows[2].rides_to_breakeven == 0 and rows[2].message.startswith("You've already spent more")
    assert rows[3].message == "At this pace single rides cost $49 a year"


def test_calculator(build):
    rides = build.rides(*[(1, "2023-12-20T08:00", 10, "Casual Member", "ICONIC", "5.00")] * 9)
    rows = nudges.breakeven_calculator(rides).collect()
    assert [r.payback_weeks for r in rows] == [21, 11, 7, 6, 5, 4, 3]
    assert [r.rides_per_week for r in rows if r.prefilled] == [2]
    assert rows[1].annual_savings == 415.0 and rows[1].monthly_savings == 34.58


def test_weekday_credits_roll_over_one_month(build):
    def days(month, *numbers):
        return [(1, f"2023-{month:02d}-{d:02d}T08:00", 10, "Annual Member") for d in numbers]

    rides = build.rides(
        *days(7, 3, 4, 5, 6),  # 4 of 10, 6 left over
        *days(8, 1, 2, 3, 4, 7, 8, 9, 10, 11, 14, 15, 16, 17, 18, 21, 22, 23, 24),  # 6 carried, 10 own, 2 over
        *days(9, 2, 3),  # a weekend
        *days(11, 1),
    )
    events = build.events((1, "signup_completed", "2023-07-01T00:00", "email", "a", None, "weekend"))
    rows = [(r.month.month, r.weekday_rides, r.carried_in, r.rides_over, r.carried_out) for r in nudges.weekday_credit_balance(rides, events).collect()]
    # October carries ten unused credits in and ten new ones out, never twenty
    assert rows == [(7, 4, 0, 0, 6), (8, 18, 6, 2, 0), (9, 0, 0, 0, 10), (10, 0, 10, 0, 10), (11, 1, 10, 0, 10), (12, 0, 10, 0, 10)]


def test_sample_size_formula(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(0.2, 0.80), (0.3, 0.80), (0.3, 0.90), (0.5, 0.80)], "lift double, power double")
    z = F.when(F.col("power") == 0.80, experiments.z_quantile(0.80)).otherwise(experiments.z_quantile(0.90))
    n = experiments.sample_size(F.lit(0.028), F.lit(0.028) * (1 + F.col("lift")), 0.05, z)
    assert [r[0] for r in rows.select(n).collect()] == [14942, 6932, 9280, 2704]


def test_readout_with_an_empty_arm_has_no_statistic(build):
    events = build.events((1, "cta_shown", "2023-12-10T00:00", "email", "treatment"), (1, "signup_completed", "2023-12-11T00:00", "email", "treatment"))
    row = experiments.experiment_readout(events).collect()[0]
    assert row.control_users == 0 and row.z_statistic is None and row.significant is None


def test_operator_breakeven_rounds_up(build):
    rows = {r.operator: r for r in economics.operator_breakeven(build.rides((1, "2023-12-10T00:00"))).collect()}
    assert {k: r.breakeven_rides_published for k, r in rows.items()} == {"toronto": 24, "divvy": 32, "citibike": 40, "santander": 38}
    assert rows["toronto"].weekend_tier_price == 63.0 and rows["toronto"].breakeven_rides_observed == 48


def test_tier_mix_and_active_members(build):
    events = build.events(
        (1, "signup_completed", "2023-12-01T00:00", "email", "a", None, "weekend"),
        (2, "signup_completed", "2023-12-01T00:00", "email", "a", None, "annual"), (3, "cta_shown", "2023-12-01T00:00", "email", "a"))
    row = growth.tier_cannibalisation(events).collect()[0]
    assert (row.users, row.converted, row.weekend_share) == (3, 2, 0.5)
    active = growth.active_members(build.rides((1, "2023-12-01T00:00"), (3, "2023-12-01T00:00")), build.users((1, "A"), (2, "A"), (3, "A")), events).collect()[0]
    assert (active.total_members, active.active_members, active.active_share) == (2, 1, 0.5)
