import pytest

from farewheel.operators import segmentation


def personas(rides):
    return {r.user_id: r.persona_segment for r in segmentation.classify_riders(rides).collect()}


# 2023-12-02 is a Saturday, 2023-12-04 a Monday
SATURDAYS = ["2023-12-02T12:00", "2023-12-09T12:00", "2023-12-16T12:00"]
MONDAYS = ["2023-12-04T08:00", "2023-12-11T08:00", "2023-12-18T08:00"]


def casual(user, starts, minutes=20.0, bikes=("ICONIC",)):
    return [(user, s, minutes, "Casual Member", bikes[i % len(bikes)], "2.20") for i, s in enumerate(starts)]


def test_rule_edges_are_inclusive(build):
    rides = build.rides(
        *casual(1, SATURDAYS + ["2023-12-05T12:00", "2023-12-06T12:00"]),  # weekend 0.600, 20.0 minutes
        *casual(2, MONDAYS[:2] + ["2023-12-05T12:00", "2023-12-06T12:00", "2023-12-07T12:00"], 15.0),  # commute 0.400
        *casual(3, MONDAYS[:2], 20.0, ("EFIT", "ICONIC")), *casual(3, MONDAYS[2:] + ["2023-12-05T12:00"], 20.0, ("EFIT", "ICONIC")),
        *casual(4, SATURDAYS[:2]),  # two rides only
        *casual(5, ["2023-12-05T12:00"] * 3),  # exactly three rides, no pattern
        *casual(6, ["2023-12-05T12:00"] * 7),  # too many rides for a visitor
    )
    assert personas(rides) == {
        1: "Weekend Explorer", 2: "Reluctant Commuter", 3: "E-bike Adopter",
        5: "Seasonal Visitor", 6: "Unclassified",
    }


def test_mean_is_rounded_before_it_is_compared(build):
    # 19.95 becomes 20.0; 19.94 becomes 19.9
    near = [(1, SATURDAYS[0], 19.9), (1, SATURDAYS[1], 20.0)] * 2
    far = [(2, SATURDAYS[0], 19.9), (2, SATURDAYS[1], 19.9), (2, SATURDAYS[2], 20.0)] * 3
    found = personas(build.rides(*near, *far))
    assert found[1] == "Weekend Explorer" and found[2] == "Unclassified"


def test_commute_hours_reach_to_the_end_of_the_hour(build):
    hours = ["2023-12-04T06:59", "2023-12-04T07:00", "2023-12-04T09:59", "2023-12-04T10:00", "2023-12-04T18:59", "2023-12-04T19:00", "2023-12-02T08:00"]
    row = segmentation.classify_riders(build.rides(*casual(1, hours))).collect()[0]
    assert row.pct_commute_hours == 0.429 and row.pct_weekend == 0.143


def test_score(build):
    row = segmentation.classify_riders(build.rides(*casual(1, ["2023-12-29T08:30"] * 4))).collect()[0]
    # 1.0 * 0.3 + round(8.80 / 105, 3) * 0.4 + 4 * 0.025 + 0.1
    assert row.conversion_priority_score == pytest.approx(0.534)
    assert row.distinct_months_active == 1 and row.days_since_last_ride == 2


def test_summary_drops_null_personas_and_shares_sum_to_100(build):
    rides = build.rides(*[(u, "2023-12-01T08:00") for u in range(1, 8)])
    users = build.users(*[(u, None if u == 7 else "AB"[u % 2]) for u in range(1, 8)])
    rows = segmentation.persona_summary(users, rides).collect()
    assert {r.persona_segment for r in rows} == {"A", "B"}
    assert sum(r.pct_of_casual_base for r in rows) == pytest.approx(100)


def test_member_ebike_rides_save_nothing(build):
    rides = build.rides((1, "2023-12-01T08:00", 10, "Annual Member", "EFIT", "1.00"), (2, "2023-12-01T08:00", 10, "Casual Member", "EFIT", "3.00"))
    rows = {r.user_type: r for r in segmentation.ebike_savings(rides).collect()}
    assert rows["Annual Member"].ebike_breakeven_rides is None and rows["Annual Member"].avg_savings_per_ride == 0.0
    casual_row = rows["Casual Member"]
    assert (casual_row.avg_casual_cost_cad, casual_row.avg_savings_per_ride) == (3.0, 2.0)
    assert casual_row.ebike_breakeven_rides == 53.0 and casual_row.projected_annual_savings_cad == 8.11


def test_targets_fan_out_limit_and_ties(build):
    rides = build.rides(*[(u, "2023-12-30T08:00") for u in (1, 2, 3, 4) for _ in range(3)])
    events = build.events(
        (1, "cta_shown", "2023-11-30T08:00"), (1, "cta_clicked", "2023-11-30T08:01"),
        (3, "signup_completed", "2022-01-01T00:00"), (4, "cta_shown", "2023-12-01T00:00"),
    )
    users = build.users((1, None), (2, None), (3, None), (4, None))
    rows = segmentation.priority_nudge_targets(rides, users, events).collect()
    assert [(r.user_id, r.total_rides_30d) for r in rows] == [(1, 6), (2, 3)]
    safe = segmentation.priority_nudge_targets(rides, users, events, grain_safe=True, limit=1).collect()
    assert [(r.user_id, r.total_rides_30d) for r in safe] == [(1, 3)]


def test_messages(build):
    rides = build.rides(
        *casual(1, ["2023-12-30T08:00"] * 3, 10.0, ("EFIT",)),
        *[(2, "2023-12-30T08:00", 10, "Casual Member", "ICONIC", "10.50")] * 3,
        *casual(3, ["2023-12-30T08:00"] * 3), *casual(4, ["2023-12-30T08:00"] * 3),
    )
    users = build.users((1, None), (2, None), (3, "Reluctant Commuter"), (4, "Weekend Explorer"))
    events = build.events((9, "cta_shown", "2023-12-01T00:00"))
    texts = {r.user_id: r.recommended_nudge_message for r in segmentation.priority_nudge_targets(rides, users, events).collect()}
    assert texts == {
        1: "E-bike nudge: Member rate saves ~C$6/mo",
        2: "Spend nudge: C$32 spent — membership = C$8.75/mo",
        3: "Commuter nudge: 3 rides → break-even in 48 more rides",
        4: "Standard membership CTA",
    }
