from farewheel.operators import retention

M = "Annual Member"


def test_cohort_size_is_the_best_month_unless_grain_safe(build):
    rides = build.rides(
        (1, "2023-01-20T08:00", 10, M), (1, "2023-02-20T08:00", 10, M), (2, "2023-02-03T08:00", 10, M),
        (2, "2023-02-04T08:00", 10, M), (3, "2022-12-31T08:00", 10, M),
    )
    events = build.events(*[(u, "signup_completed", "2023-01-10T00:00") for u in (1, 2, 3, 4)])
    rows = [(r.months_since_conversion, r.active_members, r.cohort_size, r.retention_pct, r.avg_rides_per_active_member)
            for r in retention.cohort_retention(events, rides).collect()]
    assert rows == [(0, 1, 2, 50.0, 1.0), (1, 2, 2, 100.0, 1.5)]
    safe = [(r.months_since_conversion, r.active_members, r.cohort_size, r.retention_pct)
            for r in retention.cohort_retention(events, rides, grain_safe=True).collect()]
    assert safe == [(0, 1, 4, 25.0), (1, 2, 4, 50.0)]


def test_silent_cohort_keeps_month_zero_when_grain_safe(build):
    rides = build.rides((9, "2023-01-20T08:00", 10, M))
    events = build.events((1, "signup_completed", "2023-01-10T00:00"))
    assert retention.cohort_retention(events, rides).count() == 0
    row = retention.cohort_retention(events, rides, grain_safe=True).collect()[0]
    assert (row.active_members, row.cohort_size, row.retention_pct) == (0, 1, 0.0)


def test_persona_retention_counts_a_rider_once_per_cell(build):
    rides = build.rides((1, "2023-06-20T08:00", 10, M), (1, "2023-06-21T08:00", 10, M), (1, "2024-01-20T08:00", 10, M))
    events = build.events((1, "signup_completed", "2023-06-01T00:00", "email"), (1, "signup_completed", "2023-06-02T00:00", "organic"))
    rows = retention.retention_by_persona(events, build.users((1, "A")), rides).collect()
    # January is month seven
    assert [(r.months_since_conversion, r.active_members, r.avg_rides, r.retention_pct) for r in rows] == [(0, 1, 2.0, 100.0)]


def warn(build, rides, signup="2023-01-20T00:00"):
    users, events = build.users((1, "A")), build.events((1, "signup_completed", signup))
    return retention.churn_early_warning(build.rides(*[(1, s, 10, M) for s in rides]), users, events).collect()


def test_day_31_after_midnight_is_in_neither_window(build):
    row = warn(build, ["2023-11-30T00:00", "2023-11-30T00:01", "2023-12-01T00:00", "2023-11-10T08:00"])[0]
    assert (row.rides_prior_30d, row.rides_recent_30d) == (2, 1)


def test_members_silent_for_more_than_60_days_never_appear(build):
    assert warn(build, ["2023-10-31T08:00"]) == []
    assert warn(build, ["2023-11-02T08:00"])[0].churn_risk == "High — dormant + renewal imminent"


def test_risk_chain_and_actions(build):
    rows = warn(build, ["2023-12-15T08:00"])
    assert rows[0].churn_risk == "Medium — extended inactivity" and rows[0].recommended_action.startswith("Renewal reminder")
    falling = warn(build, ["2023-11-10T08:00"] * 3 + ["2023-12-30T08:00"])[0]
    assert falling.churn_risk == "Medium — declining engagement near renewal"
    assert falling.ride_frequency_change_pct == -67.0
    assert warn(build, ["2023-12-30T08:00"]) == []
    # dormant but renewal 80 days away
    late = warn(build, ["2023-12-01T08:00"], "2023-03-20T00:00")[0]
    assert late.churn_risk == "Medium — extended inactivity" and late.recommended_action.startswith("Win-back")


def test_leap_day_signup_renews_on_28_february(build):
    users, events = build.users((1, "A")), build.events((1, "signup_completed", "2024-02-29T10:00"))
    from datetime import date

    from farewheel.params import Params

    rides = build.rides((1, "2025-01-05T08:00", 10, M))
    row = retention.churn_early_warning(rides, users, events, Params(as_of=date(2025, 1, 31))).collect()[0]
    assert str(row.renewal_date) == "2025-02-28 10:00:00" and row.days_to_renewal == 28


def test_savings_repeat_per_signup_and_unknown_bikes_cost_nothing(build):
    rides = build.rides(
        (1, "2023-05-01T08:00", 30, M, "EFIT", "3.00"), (1, "2023-05-02T08:00", 50, M, "ICONIC", "0.00"),
        (1, "2023-05-03T08:00", 60, M, "CARGO", "0.00"), (1, "2022-12-31T23:59", 60, M),
    )
    users = build.users((1, "A"))
    events = build.events((1, "signup_completed", "2022-01-01T00:00"), (1, "signup_completed", "2023-01-01T00:00"))
    safe = retention.member_ytd_savings(rides, users, events, grain_safe=True).collect()[0]
    assert (safe.ytd_rides, safe.actual_ebike_charges_cad, safe.equivalent_casual_cost_cad) == (3, 3.0, 14.0)
    assert safe.net_savings_cad == -94.0 and safe.renewal_message_tier.startswith("Low usage")
    twice = retention.member_ytd_savings(rides, users, events).collect()[0]
    assert (twice.ytd_rides, twice.actual_ebike_charges_cad, twice.equivalent_casual_cost_cad) == (6, 6.0, 28.0)


def test_guardrails_keep_the_join_multiplicity(build):
    rides = build.rides(
        (1, "2023-12-08T10:00"), (1, "2023-12-09T00:00"), (1, "2023-12-09T10:00"), (1, "2023-12-10T09:00"),
        (1, "2023-12-22T10:00"), (1, "2023-12-23T10:00"),
    )
    events = build.events((1, "cta_shown", "2023-12-10T12:00"), (1, "cta_shown", "2023-12-10T18:00"))
    app = build.app_events((1, "app_open", "2023-12-01T00:00"), (1, "app_open", "2023-12-02T00:00"), (1, "app_uninstall", "2023-12-09T23:59"))
    row = retention.nudge_guardrails(events, rides, app).collect()[0]
    # before: the 8th and midnight of the 9th; after: the 10th and the 22nd; times 2 impressions and 3 app rows
    assert (row.avg_rides_pre_nudge, row.avg_rides_post_nudge, row.uninstall_rate_pct) == (12.0, 12.0, 0.0)
    safe = retention.nudge_guardrails_grain_safe(events, rides, app).collect()[0]
    assert (safe.avg_rides_pre_nudge, safe.avg_rides_post_nudge) == (3.0, 3.0)


def test_uninstall_rate_may_pass_100_as_written(build):
    rides = build.rides((1, "2023-12-10T09:00"))
    events = build.events((1, "cta_shown", "2023-12-10T12:00"), (1, "cta_shown", "2023-12-11T12:00"))
    app = build.app_events((1, "app_uninstall", "2023-12-20T00:00"))
    assert retention.nudge_guardrails(events, rides, app).collect()[0].uninstall_rate_pct == 200.0
    assert retention.nudge_guardrails_grain_safe(events, rides, app).collect()[0].uninstall_rate_pct == 100.0
