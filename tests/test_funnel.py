from farewheel.operators import funnel


def first(df):
    return df.collect()[0].asDict()


def test_ride_days_without_event_share_the_null_date(build):
    rides = build.rides((1, "2023-12-20T08:00"), (1, "2023-12-21T08:00"), (1, "2023-12-22T08:00"), (2, "2023-12-21T09:00"))
    events = build.events((1, "cta_shown", "2023-12-21T09:00"), (1, "cta_shown", "2023-12-21T10:00"))
    rows = {str(r.event_date): r for r in funnel.funnel_daily(rides, events).collect()}
    assert set(rows) == {"2023-12-21", "None"}
    # rider 1 has two days without an event and rider 2 one: two riders
    assert rows["None"].casual_riders == 2 and rows["None"].cta_shown == 0
    day = rows["2023-12-21"]
    assert (day.casual_riders, day.cta_shown, day.cta_clicked) == (1, 1, 0)
    assert day.exposure_rate == 1.0 and day.cta_ctr == 0.0
    assert day.click_to_start is None and day.start_to_complete is None


def test_member_rides_reach_later_steps_but_are_no_casual_riders(build):
    rides = build.rides((1, "2023-12-21T08:00", 10, "Annual Member"))
    events = build.events((1, "signup_completed", "2023-12-21T09:00"))
    row = first(funnel.funnel_daily(rides, events))
    assert row["casual_riders"] == 0 and row["signup_completed"] == 1
    assert row["conversion_rate"] is None and row["conversion_rate_7d_avg"] is None


def test_rolling_mean_covers_rows_not_days(build):
    days = ["2023-12-02", "2023-12-05", "2023-12-08", "2023-12-11", "2023-12-14", "2023-12-17", "2023-12-20", "2023-12-23"]
    rides = build.rides(*[(1, f"{d}T08:00") for d in days])
    kinds = ["signup_completed"] + ["cta_shown"] * 7
    events = build.events(*[(1, k, f"{d}T09:00") for k, d in zip(kinds, days)])
    rows = {str(r.event_date): r.conversion_rate_7d_avg for r in funnel.funnel_daily(rides, events).collect()}
    assert rows["2023-12-20"] == round(1 / 7, 4)
    assert rows["2023-12-23"] == 0.0


def test_persona_means_are_weighted_by_event_rows_unless_grain_safe(build):
    rides = build.rides((1, "2023-12-01T08:00", 10), (1, "2023-12-02T08:00", 20), (1, "2023-12-03T08:00", 30), (2, "2023-12-01T08:00", 50))
    events = build.events((1, "cta_shown", "2022-01-01T08:00"), (1, "signup_completed", "2022-01-02T08:00"))
    users = build.users((1, "A"), (2, "A"))
    row = first(funnel.funnel_by_persona(rides, users, events))
    assert row["avg_ride_duration"] == 24.3  # (2 * 60 + 50) / 7
    assert (row["casual_riders"], row["cta_shown"], row["converted"]) == (2, 1, 1)
    assert row["breakeven_rides"] == 48.0 and row["conversion_rank"] == 1
    safe = first(funnel.funnel_by_persona(rides, users, events, grain_safe=True))
    assert safe["avg_ride_duration"] == 27.5


def test_null_persona_is_kept(build):
    rides, users = build.rides((1, "2023-12-01T08:00")), build.users((1, None))
    events = build.events((9, "cta_shown", "2023-12-01T08:00"))
    row = first(funnel.funnel_by_persona(rides, users, events))
    assert row["persona_segment"] is None and row["conversion_rate"] == 0.0 and row["cta_ctr"] is None


def test_channel_days_may_be_negative_and_unshown_riders_drop_out(build):
    events = build.events(
        (1, "signup_completed", "2023-12-10T00:00"), (1, "cta_shown", "2023-12-12T00:00"),
        (2, "signup_completed", "2023-12-10T00:00"),
        (3, "cta_shown", "2022-01-01T00:00"), (3, "cta_clicked", "2023-12-10T00:00"),
    )
    rows = funnel.funnel_by_channel_variant(events).collect()
    assert len(rows) == 1
    assert rows[0].users_exposed == 2 and rows[0].conversions == 1 and rows[0].cta_clicks == 1
    assert rows[0].avg_days_to_convert == -2.0
    assert rows[0].projected_annual_arr_k == 83790.0


def test_step_dropoff_ties_and_bad_json(build):
    def step(n):
        return '{"step": "%s"}' % n

    events = build.events(
        (1, "signup_started", "2023-12-10T10:00", "email", "a"),
        (1, "signup_step_completed", "2023-12-10T10:05", "email", "a", step(2)),
        (1, "signup_completed", "2023-12-10T10:30", "email", "a"),
        (2, "signup_started", "2023-12-10T10:00", "email", "a"),
        (2, "signup_completed", "2023-12-10T10:10", "email", "a"),
        (3, "signup_started", "2023-12-10T10:00", "email", "a"),
        (3, "signup_completed", "2023-12-10T10:11", "email", "a"),
        (4, "signup_abandoned", "2023-12-10T10:00", "email", "a", step(3)),
        (5, "signup_abandoned", "2023-12-10T10:00", "email", "a", step(2)),
        (6, "signup_abandoned", "2023-12-10T10:00", "email", "a", "{broken"),
        (7, "signup_step_completed", "2023-12-10T10:00", "email", "a", None),
    )
    row = first(funnel.signup_step_dropoff(events, grain_safe=True))
    assert row["most_common_abandon_step"] == "2"
    assert row["entered_flow"] == 3 and row["reached_step_2"] == 1 and row["completed"] == 3
    assert row["drop_step_1"] == 0.667 and row["drop_step_2"] == 1.0 and row["drop_step_3"] is None
    assert row["median_completion_min"] == 17.0 and row["true_median_completion_min"] == 11.0


def test_time_to_convert_uses_the_first_of_two_signups(build):
    rides = build.rides((1, "2023-10-01T08:00"), (1, "2023-10-05T08:00"), (1, "2023-10-05T18:00"), (1, "2023-11-20T08:00"))
    events = build.events((1, "signup_completed", "2023-10-31T04:00"), (1, "signup_completed", "2023-12-20T04:00"))
    users = build.users((1, "A", "2023-10-01T08:00"))
    row = first(funnel.time_to_convert(users, events, rides))
    # 29 days and 20 hours have elapsed
    assert row["median_days"] == 29.0 and row["conversions"] == 1
    assert row["avg_ride_days_before_convert"] == 2.0 and row["avg_spend_before_convert_cad"] == 6.6
    assert row["est_breakeven_rides"] == 32.0


def test_time_to_convert_with_a_split_hot_rider(build):
    rides = build.rides(*[(1, f"2023-10-{d:02d}T{h:02d}:00") for d in range(1, 21) for h in range(6, 18)], (2, "2023-10-02T08:00"))
    events = build.events((1, "signup_completed", "2023-10-15T10:30"), (2, "signup_completed", "2023-10-15T10:30"))
    users = build.users((1, "A", "2023-10-01T06:00"), (2, "A", "2023-10-02T08:00"))

    def journeys(rows_per_task):
        rows = funnel.conversion_journeys(users, events, rides, funnel.DEFAULTS, 180, rows_per_task).collect()
        return sorted((r.user_id, r.ride_days, r.cents, r.days) for r in rows)

    assert journeys(7) == journeys(10**6) == [(1, 15, 173 * 220, 14), (2, 1, 220, 13)]
