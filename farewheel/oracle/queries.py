"""SQL per query name.

Fixed values (texts, codes, thresholds) are written out as literals here, so that the
statements depend on nothing but the tables.
"""

from __future__ import annotations

from statistics import NormalDist

from farewheel.oracle.base import AS_OF, TABLES, days_ago, n, q, r


def _funnel_daily() -> str:
    return f"""{TABLES},
    pairs AS (
      SELECT CAST(e.event_at AS DATE) AS event_date, r.user_id, r.user_type, e.event_type
      FROM rides r LEFT JOIN membership_events e
        ON e.user_id = r.user_id AND CAST(e.event_at AS DATE) = CAST(r.started_at AS DATE)
      WHERE r.started_at >= {days_ago(30)}),
    d AS (
      SELECT event_date,
        COUNT(DISTINCT user_id) FILTER (user_type = 'Casual Member') AS casual_riders,
        COUNT(DISTINCT user_id) FILTER (event_type = 'cta_shown') AS cta_shown,
        COUNT(DISTINCT user_id) FILTER (event_type = 'cta_clicked') AS cta_clicked,
        COUNT(DISTINCT user_id) FILTER (event_type = 'signup_started') AS signup_started,
        COUNT(DISTINCT user_id) FILTER (event_type = 'signup_completed') AS signup_completed
      FROM pairs GROUP BY event_date)
    SELECT * EXCLUDE (m), {r(q('cta_shown', 'casual_riders'), 4)} AS exposure_rate,
      {r(q('cta_clicked', 'cta_shown'), 4)} AS cta_ctr,
      {r(q('signup_started', 'cta_clicked'), 4)} AS click_to_start,
      {r(q('signup_completed', 'signup_started'), 4)} AS start_to_complete,
      {r(q('signup_completed', 'casual_riders'), 4)} AS conversion_rate,
      {r('m', 4)} AS conversion_rate_7d_avg
    FROM (SELECT *, AVG({q('signup_completed', 'casual_riders')}) OVER (
            ORDER BY event_date ASC NULLS LAST ROWS 6 PRECEDING) AS m FROM d)
    """


def _funnel_by_persona(grain_safe: bool, classified: bool = False) -> str:
    personas = f"""{RIDER_PROFILE},
    who AS (SELECT user_id, n.persona_segment FROM users LEFT JOIN named n USING (user_id)),""" if classified else \
        " who AS (SELECT user_id, persona_segment FROM users),"
    if grain_safe:
        means = """means AS (SELECT persona_segment, SUM(duration_min) / COUNT(duration_min) AS d,
          CAST(SUM(ride_cost_cad) AS DOUBLE) / COUNT(ride_cost_cad) AS c
          FROM rides JOIN users USING (user_id)
          WHERE user_type = 'Casual Member' AND started_at >= """ + days_ago(90) + """ GROUP BY 1)"""
    else:
        means = """means AS (SELECT persona_segment, SUM(duration_min) / COUNT(duration_min) AS d,
          CAST(SUM(ride_cost_cad) AS DOUBLE) / COUNT(ride_cost_cad) AS c FROM pairs GROUP BY 1)"""
    return f"""{TABLES}, {personas}
    pairs AS (
      SELECT persona_segment, r.user_id, duration_min, ride_cost_cad, event_type
      FROM rides r JOIN who u USING (user_id) LEFT JOIN membership_events e ON e.user_id = r.user_id
      WHERE r.user_type = 'Casual Member' AND r.started_at >= {days_ago(90)}),
    {means},
    f AS (
      SELECT persona_segment, COUNT(DISTINCT user_id) AS casual_riders,
        COUNT(DISTINCT user_id) FILTER (event_type = 'cta_shown') AS cta_shown,
        COUNT(DISTINCT user_id) FILTER (event_type = 'cta_clicked') AS cta_clicked,
        COUNT(DISTINCT user_id) FILTER (event_type = 'signup_completed') AS converted
      FROM pairs GROUP BY 1),
    j AS (SELECT f.*, {r('d', 1)} AS avg_ride_duration, {r('c', 2)} AS avg_ride_cost
          FROM f JOIN means m ON m.persona_segment IS NOT DISTINCT FROM f.persona_segment)
    SELECT *, {r(q('105.0', 'avg_ride_cost'))} AS breakeven_rides,
      {r(q('cta_clicked', 'cta_shown'), 3)} AS cta_ctr,
      {r(q('converted', 'casual_riders'), 4)} AS conversion_rate,
      RANK() OVER (ORDER BY {q('converted', 'casual_riders')} DESC NULLS LAST) AS conversion_rank
    FROM j"""


CHANNEL_CELLS = f"""
    touch AS (SELECT user_id, MIN(event_at) AS first_at FROM membership_events
              WHERE event_type = 'cta_shown' GROUP BY 1),
    cells AS (
      SELECT source_channel, nudge_variant, COUNT(DISTINCT user_id) AS users_exposed,
        COUNT(DISTINCT user_id) FILTER (event_type = 'cta_clicked') AS cta_clicks,
        COUNT(DISTINCT user_id) FILTER (event_type = 'signup_completed') AS conversions,
        SUM(date_diff('second', first_at, event_at)) FILTER (event_type = 'signup_completed') AS sec,
        COUNT(*) FILTER (event_type = 'signup_completed') AS done
      FROM membership_events JOIN touch USING (user_id)
      WHERE event_at >= {days_ago(28)} GROUP BY 1, 2)"""


def _funnel_by_channel_variant() -> str:
    rate = q("conversions", "users_exposed")
    return f"""{TABLES}, {CHANNEL_CELLS}
    SELECT source_channel, nudge_variant, users_exposed, cta_clicks, conversions,
      {r(q('cta_clicks', 'users_exposed'), 4)} AS ctr, {r(rate, 4)} AS conversion_rate,
      {r(q('CAST(sec AS DOUBLE) / 86400.0', 'done'), 1)} AS avg_days_to_convert,
      {r(f'{rate} * (133000 * 105.0::DOUBLE * 12 / 1000)')} AS projected_annual_arr_k
    FROM cells"""


def _signup_step_dropoff(grain_safe: bool) -> str:
    extra = f""", {r("quantile_cont(CAST(sec AS DOUBLE), 0.5) / 60.0", 1)} AS true_median_completion_min""" if grain_safe else ""

    def drop(a: str, b: str) -> str:
        return r(q(f"SUM({a}) - SUM({b})", f"SUM({a})"), 3)

    return f"""{TABLES},
    tagged AS (SELECT *, json_extract_string(event_metadata, '$.step') AS step
               FROM membership_events WHERE event_at >= {days_ago(30)}),
    person AS (
      SELECT user_id, nudge_variant,
        COUNT(*) FILTER (event_type = 'signup_started') > 0 AS a,
        COUNT(*) FILTER (event_type = 'signup_step_completed' AND step = '2') > 0 AS b,
        COUNT(*) FILTER (event_type = 'signup_step_completed' AND step = '3') > 0 AS c,
        COUNT(*) FILTER (event_type = 'signup_completed') > 0 AS d,
        MAX(step) FILTER (event_type = 'signup_abandoned') AS left_at,
        date_diff('second', MIN(event_at) FILTER (event_type = 'signup_started'),
                            MIN(event_at) FILTER (event_type = 'signup_completed')) AS sec
      FROM tagged GROUP BY 1, 2),
    p AS (SELECT nudge_variant, a::INT AS a, b::INT AS b, c::INT AS c, d::INT AS d, left_at, sec FROM person),
    top AS (SELECT nudge_variant, left_at FROM p WHERE left_at IS NOT NULL GROUP BY 1, 2
            QUALIFY ROW_NUMBER() OVER (PARTITION BY nudge_variant ORDER BY COUNT(*) DESC, left_at) = 1),
    s AS (SELECT nudge_variant, {n('SUM(a)')} AS entered_flow, {n('SUM(b)')} AS reached_step_2,
        {n('SUM(c)')} AS reached_step_3, {n('SUM(d)')} AS completed,
        {drop('a', 'b')} AS drop_step_1, {drop('b', 'c')} AS drop_step_2, {drop('c', 'd')} AS drop_step_3,
        {r(q('SUM(d)', 'SUM(a)'), 3)} AS flow_completion_rate,
        {r(q('CAST(SUM(sec) AS DOUBLE) / 60.0', 'COUNT(sec)'), 1)} AS median_completion_min{extra}
      FROM p GROUP BY 1)
    SELECT s.*, top.left_at AS most_common_abandon_step FROM s LEFT JOIN top USING (nudge_variant)"""


def _time_to_convert() -> str:
    def pct(p: float) -> str:
        return r(f"quantile_cont(CAST(days AS DOUBLE), {p})", 6)

    return f"""{TABLES},
    conv AS (SELECT user_id, MIN(event_at) AS converted_at FROM membership_events
             WHERE event_type = 'signup_completed' GROUP BY 1),
    person AS (
      SELECT u.user_id, persona_segment,
        CAST(floor((epoch(ANY_VALUE(converted_at)) - epoch(ANY_VALUE(first_ride_at))) / 86400) AS BIGINT) AS days,
        COUNT(DISTINCT CAST(started_at AS DATE)) AS ride_days, CAST(SUM(ride_cost_cad) AS DOUBLE) AS spend
      FROM users u JOIN conv c USING (user_id)
      JOIN rides x ON x.user_id = u.user_id AND x.started_at < converted_at AND x.user_type = 'Casual Member'
      WHERE first_ride_at >= {days_ago(180)} GROUP BY 1, 2),
    g AS (SELECT persona_segment, COUNT(*) AS conversions, {q('SUM(days)', 'COUNT(*)')} AS md,
        {pct(0.25)} AS p25_days, {pct(0.5)} AS median_days, {pct(0.75)} AS p75_days, {pct(0.9)} AS p90_days,
        {q('SUM(ride_days)', 'COUNT(*)')} AS mr,
        {q('CAST(SUM(CAST(spend AS DECIMAL(18,2))) AS DOUBLE)', 'COUNT(spend)')} AS ms
      FROM person GROUP BY 1)
    SELECT persona_segment, conversions, {r('md', 1)} AS avg_days_to_convert, p25_days, median_days, p75_days,
      p90_days, {r('mr', 1)} AS avg_ride_days_before_convert, {r('ms', 2)} AS avg_spend_before_convert_cad,
      {r(q('105.0', q('ms', 'mr')))} AS est_breakeven_rides
    FROM g"""


MONTHLY = """
    act AS (SELECT user_id, CAST(date_trunc('month', started_at) AS DATE) AS am, COUNT(*) AS k
            FROM rides WHERE user_type = 'Annual Member' GROUP BY 1, 2)"""


def _cohort_retention(grain_safe: bool) -> str:
    if grain_safe:
        tail = f"""
    size AS (SELECT cm, COUNT(*) AS cohort_size FROM co GROUP BY 1),
    cells AS (SELECT cm, m, COUNT(*) AS a, {q('SUM(k)', 'COUNT(*)')} AS mk FROM x GROUP BY 1, 2),
    slots AS (SELECT cm, m FROM cells UNION SELECT cm, 0 FROM size)
    SELECT s.cm AS cohort_month, s.m AS months_since_conversion, COALESCE(a, 0) AS active_members, cohort_size,
      {r(q('COALESCE(a, 0) * 100', 'cohort_size'), 1)} AS retention_pct, {r('mk', 1)} AS avg_rides_per_active_member
    FROM slots s JOIN size ON size.cm = s.cm LEFT JOIN cells c ON c.cm = s.cm AND c.m = s.m"""
    else:
        tail = f"""
    cells AS (SELECT cm, m, COUNT(DISTINCT user_id) AS a, {q('SUM(k)', 'COUNT(*)')} AS mk FROM x GROUP BY 1, 2)
    SELECT cm AS cohort_month, m AS months_since_conversion, a AS active_members,
      MAX(a) OVER (PARTITION BY cm) AS cohort_size,
      {r(q('a * 100', 'MAX(a) OVER (PARTITION BY cm)'), 1)} AS retention_pct,
      {r('mk', 1)} AS avg_rides_per_active_member
    FROM cells"""
    return f"""{TABLES}, {MONTHLY},
    co AS (SELECT user_id, CAST(date_trunc('month', MIN(event_at)) AS DATE) AS cm
           FROM membership_events WHERE event_type = 'signup_completed' GROUP BY 1),
    x AS (SELECT user_id, cm, date_diff('month', cm, am) AS m, k FROM co JOIN act USING (user_id) WHERE am >= cm),
    {tail}"""


def _retention_by_persona() -> str:
    return f"""{TABLES}, {MONTHLY},
    co AS (SELECT user_id, persona_segment, source_channel, CAST(date_trunc('month', MIN(event_at)) AS DATE) AS cm
           FROM membership_events JOIN users USING (user_id)
           WHERE event_type = 'signup_completed' AND event_at >= {AS_OF} - INTERVAL 12 MONTH GROUP BY 1, 2, 3),
    x AS (SELECT persona_segment, date_diff('month', cm, am) AS m, user_id, k
          FROM co JOIN act USING (user_id) WHERE am BETWEEN cm AND cm + INTERVAL 6 MONTH),
    g AS (SELECT persona_segment, m AS months_since_conversion, COUNT(DISTINCT user_id) AS active_members,
        {r(q('SUM(k)', 'COUNT(*)'), 1)} AS avg_rides FROM x GROUP BY 1, 2)
    SELECT *, {r(q('active_members * 100', 'MAX(active_members) OVER (PARTITION BY persona_segment)'), 1)} AS retention_pct
    FROM g"""


def _churn_early_warning() -> str:
    return f"""{TABLES},
    t AS (SELECT user_id,
        COUNT(*) FILTER (started_at BETWEEN {days_ago(60)} AND {days_ago(31)}) AS rides_prior_30d,
        COUNT(*) FILTER (started_at >= {days_ago(30)}) AS rides_recent_30d,
        date_diff('day', CAST(MAX(started_at) AS DATE), {AS_OF}) AS days_since_last_ride
      FROM rides WHERE user_type = 'Annual Member' AND started_at >= {days_ago(60)} GROUP BY 1),
    w AS (SELECT user_id, MAX(event_at) + INTERVAL 1 YEAR AS renewal_date FROM membership_events
          WHERE event_type = 'signup_completed' GROUP BY 1),
    j AS (SELECT user_id, persona_segment, renewal_date,
        date_diff('day', {AS_OF}, CAST(renewal_date AS DATE)) AS days_to_renewal,
        rides_prior_30d, rides_recent_30d, days_since_last_ride,
        rides_recent_30d < rides_prior_30d * 0.5 AS falling
      FROM t JOIN w USING (user_id) JOIN users USING (user_id))
    SELECT * EXCLUDE (falling),
      {r(f"{q('rides_recent_30d - rides_prior_30d', 'rides_prior_30d')} * 100")} AS ride_frequency_change_pct,
      CASE WHEN days_since_last_ride >= 21 AND days_to_renewal <= 60 THEN 'High — dormant + renewal imminent'
           WHEN falling THEN 'Medium — declining engagement near renewal'
           ELSE 'Medium — extended inactivity' END AS churn_risk,
      CASE WHEN days_since_last_ride >= 21 THEN 'Win-back: personalised re-engagement email with nearest station'
           WHEN falling THEN 'Re-engage: highlight member perks + upcoming local events'
           WHEN days_to_renewal <= 30 THEN 'Renewal reminder: show YTD savings vs casual rate' END AS recommended_action
    FROM j WHERE days_to_renewal BETWEEN 0 AND 90 AND (falling OR days_since_last_ride >= 14)"""


def _member_ytd_savings(grain_safe: bool) -> str:
    repeat = "JOIN (SELECT DISTINCT user_id FROM membership_events WHERE event_type = 'signup_completed') s USING (user_id)" \
        if grain_safe else \
        "JOIN (SELECT user_id FROM membership_events WHERE event_type = 'signup_completed') s USING (user_id)"
    return f"""{TABLES},
    g AS (SELECT user_id, persona_segment, COUNT(*) AS ytd_rides, SUM(duration_min) AS mins,
        COALESCE(SUM(duration_min) FILTER (bike_type = 'EFIT'), 0) AS em,
        COALESCE(SUM(duration_min) FILTER (bike_type = 'ICONIC'), 0) AS cm
      FROM rides JOIN users USING (user_id) {repeat}
      WHERE user_type = 'Annual Member' AND started_at >= DATE '2023-01-01' GROUP BY 1, 2),
    c AS (SELECT *, em * CAST(0.10 AS DOUBLE) AS charges,
        ytd_rides * CAST(1 AS DOUBLE) + cm * CAST(0.12 AS DOUBLE) + em * CAST(0.20 AS DOUBLE) AS casual FROM g),
    k AS (SELECT *, charges + 105.0::DOUBLE AS mc, casual - (charges + 105.0::DOUBLE) AS net FROM c)
    SELECT user_id, persona_segment, ytd_rides, {r('mins / 60.0::DOUBLE', 1)} AS ytd_hours_ridden,
      {r('charges', 2)} AS actual_ebike_charges_cad, 105.0::DOUBLE AS annual_membership_fee,
      {r('mc', 2)} AS total_member_cost_cad, {r('casual', 2)} AS equivalent_casual_cost_cad,
      {r('net', 2)} AS net_savings_cad, {r(q('casual', 'mc'), 2)} AS savings_multiple,
      CASE WHEN net >= 50 THEN concat('High value: saved C$', {n(r('net'))}, ' — strong renewal message')
           WHEN net >= 0 THEN 'Positive ROI: membership has paid off — remind at renewal'
           ELSE 'Low usage — at-risk rider, send re-engagement first' END AS renewal_message_tier
    FROM k"""


def _nudge_guardrails(grain_safe: bool) -> str:
    if grain_safe:
        return f"""{TABLES},
    nd AS (SELECT DISTINCT user_id, nudge_variant, CAST(event_at AS DATE) AS d FROM membership_events
           WHERE event_type = 'cta_shown' AND event_at >= {days_ago(28)}),
    b AS (SELECT nd.nudge_variant, nd.user_id, nd.d,
        COUNT(*) FILTER (date_diff('day', d, CAST(started_at AS DATE)) BETWEEN -14 AND -1) AS pre,
        COUNT(*) FILTER (date_diff('day', d, CAST(started_at AS DATE)) BETWEEN 0 AND 13) AS post
      FROM nd LEFT JOIN rides USING (user_id) GROUP BY 1, 2, 3),
    un AS (SELECT nd.nudge_variant, COUNT(DISTINCT a.user_id) AS gone FROM nd
           JOIN app_events a ON a.user_id = nd.user_id AND a.event_type = 'app_uninstall' AND a.event_at >= nd.d GROUP BY 1),
    g AS (SELECT b.nudge_variant, COUNT(DISTINCT user_id) AS users, {q('SUM(pre)', 'COUNT(*)')} AS pre,
        {q('SUM(post)', 'COUNT(*)')} AS post FROM b GROUP BY 1),
    j AS (SELECT g.*, {q('COALESCE(gone, 0) * 100', 'users')} AS up FROM g LEFT JOIN un USING (nudge_variant)),
    k AS (SELECT *, {q('post - pre', 'pre')} AS chg, (SELECT up FROM j WHERE nudge_variant = 'control') AS base FROM j)
    SELECT nudge_variant, users, {r('pre', 2)} AS avg_rides_pre_nudge, {r('post', 2)} AS avg_rides_post_nudge,
      {r('chg * 100', 1)} AS ride_freq_change_pct, {r('up', 2)} AS uninstall_rate_pct,
      {r(f"{q('up - base', 'base')} * 100", 1)} AS uninstall_vs_control_pct,
      CASE WHEN chg < -0.10 THEN 'BREACH — ride frequency down >10% — pause nudge'
           WHEN {q('up - base', 'base')} > 0.05 THEN 'BREACH — uninstall rate >5% — pause nudge'
           ELSE 'OK — within guardrail thresholds' END AS guardrail_status
    FROM k"""
    return f"""{TABLES},
    nd AS (SELECT user_id, nudge_variant, CAST(event_at AS DATE) AS d FROM membership_events
           WHERE event_type = 'cta_shown' AND event_at >= {days_ago(28)}),
    b AS (SELECT nd.nudge_variant, nd.user_id, nd.d,
        COUNT(*) FILTER (started_at BETWEEN d - INTERVAL 14 DAY AND d - INTERVAL 1 DAY) AS pre,
        COUNT(*) FILTER (started_at BETWEEN d AND d + INTERVAL 13 DAY) AS post,
        CAST(COUNT(*) FILTER (a.event_type = 'app_uninstall' AND a.event_at >= d) > 0 AS INT) AS gone
      FROM nd LEFT JOIN rides x ON x.user_id = nd.user_id LEFT JOIN app_events a ON a.user_id = nd.user_id
      GROUP BY 1, 2, 3),
    g AS (SELECT nudge_variant, COUNT(DISTINCT user_id) AS users, {q('SUM(pre)', 'COUNT(*)')} AS pre,
        {q('SUM(post)', 'COUNT(*)')} AS post, {q('SUM(gone) * 100', 'COUNT(DISTINCT user_id)')} AS up FROM b GROUP BY 1)
    SELECT nudge_variant, users, {r('pre', 2)} AS avg_rides_pre_nudge, {r('post', 2)} AS avg_rides_post_nudge,
      {r(f"{q('post - pre', 'pre')} * 100", 1)} AS ride_freq_change_pct, {r('up', 2)} AS uninstall_rate_pct,
      CASE WHEN {q('post - pre', 'pre')} < -0.10 THEN 'BREACH — ride frequency down >10% — pause nudge'
           WHEN up > 5.0 THEN 'BREACH — uninstall rate >5% — pause nudge'
           ELSE 'OK — within guardrail thresholds' END AS guardrail_status
    FROM g"""


RIDER_PROFILE = f"""
    prof AS (SELECT user_id, COUNT(*) AS total_rides, {r('SUM(duration_min) / COUNT(duration_min)', 1)} AS avg_duration_min,
        {r(q('CAST(SUM(ride_cost_cad) AS DOUBLE)', 'COUNT(ride_cost_cad)'), 2)} AS avg_ride_cost,
        CAST(SUM(ride_cost_cad) AS DOUBLE) AS total_spend_60d,
        {r(q("COUNT(*) FILTER (dayofweek(started_at) IN (0, 6))", 'COUNT(*)'), 3)} AS pct_weekend,
        {r(q("COUNT(*) FILTER (dayofweek(started_at) BETWEEN 1 AND 5 AND hour(started_at) IN (7, 8, 9, 16, 17, 18))", 'COUNT(*)'), 3)} AS pct_commute_hours,
        {r(q("COUNT(*) FILTER (bike_type = 'EFIT')", 'COUNT(*)'), 3)} AS pct_ebike,
        COUNT(DISTINCT month(started_at)) AS distinct_months_active,
        date_diff('day', CAST(MAX(started_at) AS DATE), {AS_OF}) AS days_since_last_ride,
        {r('CAST(SUM(ride_cost_cad) AS DOUBLE) / 105.0::DOUBLE', 3)} AS spend_to_membership_ratio
      FROM rides WHERE user_type = 'Casual Member' AND started_at >= {days_ago(60)} GROUP BY 1),
    named AS (SELECT *,
        CASE WHEN pct_ebike >= 0.5 THEN 'E-bike Adopter'
             WHEN pct_weekend >= 0.6::DOUBLE AND avg_duration_min >= 20 THEN 'Weekend Explorer'
             WHEN pct_commute_hours >= 0.4::DOUBLE AND avg_duration_min <= 15 THEN 'Reluctant Commuter'
             WHEN total_rides <= 6 AND distinct_months_active <= 2 THEN 'Seasonal Visitor'
             ELSE 'Unclassified' END AS persona_segment,
        {r('''pct_commute_hours * 0.30::DOUBLE + spend_to_membership_ratio * 0.40::DOUBLE
            + CASE WHEN total_rides >= 8 THEN 0.20::DOUBLE ELSE total_rides * 0.025::DOUBLE END
            + CASE WHEN days_since_last_ride <= 7 THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END''', 3)} AS conversion_priority_score
      FROM prof WHERE total_rides >= 3)"""


def _persona_summary() -> str:
    return f"""{TABLES},
    per AS (SELECT user_id, persona_segment, COUNT(*) AS k, SUM(ride_cost_cad) AS s,
        {r('SUM(duration_min) / COUNT(duration_min)', 1)} AS d,
        {r(q('CAST(SUM(ride_cost_cad) AS DOUBLE)', 'COUNT(ride_cost_cad)'), 2)} AS c
      FROM rides JOIN users USING (user_id)
      WHERE user_type = 'Casual Member' AND started_at >= {days_ago(90)} AND persona_segment IS NOT NULL GROUP BY 1, 2),
    g AS (SELECT persona_segment, COUNT(*) AS rider_count, {q('SUM(k)', 'COUNT(*)')} AS mk,
        CAST(SUM(CAST(d AS DECIMAL(18,1))) AS DOUBLE) / COUNT(*) AS md,
        CAST(SUM(CAST(c AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) AS mc,
        CAST(SUM(s) AS DOUBLE) / COUNT(*) AS ms FROM per GROUP BY 1)
    SELECT persona_segment, rider_count,
      {r(q('rider_count * 100', 'SUM(rider_count) OVER ()'), 1)} AS pct_of_casual_base,
      {r('mk', 1)} AS avg_rides_per_rider_90d, {r('md', 1)} AS avg_trip_duration_min,
      {r('mc', 2)} AS avg_ride_cost_cad, {r('ms', 2)} AS avg_spend_90d_cad,
      {r(q('105.0', 'mc'))} AS breakeven_rides, {r(q('105.0', 'mc * mk / 3.0::DOUBLE'), 1)} AS months_to_breakeven,
      {r('rider_count * 105.0::DOUBLE * 12 * 5 / (100 * 1000.0::DOUBLE)')} AS arr_opportunity_at_5pct_k
    FROM g"""


def _ebike_savings() -> str:
    casual = "user_type = 'Casual Member'"
    saving = f"CASE WHEN {casual} THEN 1.0::DOUBLE + m * (0.20::DOUBLE - 0.10::DOUBLE) ELSE 0.0::DOUBLE END"
    return f"""{TABLES},
    g AS (SELECT user_type, COUNT(*) AS ebike_rides, SUM(duration_min) / COUNT(duration_min) AS m
          FROM rides WHERE bike_type = 'EFIT' AND started_at >= {days_ago(90)} GROUP BY 1)
    SELECT user_type, ebike_rides, {r('m', 1)} AS avg_duration_min,
      {r(f"CASE WHEN {casual} THEN 1.0::DOUBLE + m * 0.20::DOUBLE ELSE 0.0::DOUBLE END", 2)} AS avg_casual_cost_cad,
      {r('m * 0.10::DOUBLE', 2)} AS avg_member_cost_cad, {r(saving, 2)} AS avg_savings_per_ride,
      {r(f'({saving}) * ebike_rides / 90::DOUBLE * 365', 2)} AS projected_annual_savings_cad,
      {r(q('105.0', saving))} AS ebike_breakeven_rides
    FROM g"""


def _priority_nudge_targets(grain_safe: bool, limit: int) -> str:
    if grain_safe:
        source = """SELECT r.*, nudged, member FROM rides r LEFT JOIN (
            SELECT user_id, COUNT(*) FILTER (event_type = 'cta_shown' AND event_at >= DATE '2023-12-01') AS nudged,
              COUNT(*) FILTER (event_type = 'signup_completed') AS member
            FROM membership_events GROUP BY 1) e USING (user_id)"""
    else:
        source = """SELECT r.*, CAST(event_type = 'cta_shown' AND event_at >= DATE '2023-12-01' AS INT) AS nudged,
            CAST(event_type = 'signup_completed' AS INT) AS member
          FROM rides r LEFT JOIN membership_events e USING (user_id)"""
    return f"""{TABLES},
    src AS ({source}),
    g AS (SELECT user_id, persona_segment, COUNT(*) AS k, CAST(SUM(ride_cost_cad) AS DOUBLE) AS s,
        date_diff('day', CAST(MAX(started_at) AS DATE), {AS_OF}) AS idle,
        {r('SUM(duration_min) / COUNT(duration_min)', 1)} AS d,
        {r(q("COUNT(*) FILTER (bike_type = 'EFIT')", 'COUNT(*)'), 2)} AS eb
      FROM src JOIN users USING (user_id)
      WHERE user_type = 'Casual Member' AND started_at >= {days_ago(30)}
      GROUP BY 1, 2 HAVING COUNT(*) >= 3 AND COALESCE(MAX(member), 0) = 0 AND COALESCE(MAX(nudged), 0) = 0)
    SELECT user_id, persona_segment, k AS total_rides_30d, {r('s', 2)} AS total_spend_30d_cad,
      idle AS days_since_last_ride, d AS avg_duration, eb AS pct_ebike,
      {r('s / 105.0::DOUBLE * 100')} AS pct_of_membership_spent,
      CASE WHEN eb >= 0.5 THEN concat('E-bike nudge: Member rate saves ~C$', {n(r('(1.0::DOUBLE + d * (0.20::DOUBLE - 0.10::DOUBLE)) * k'))}, '/mo')
           WHEN s >= 30 THEN concat('Spend nudge: C$', {n(r('s'))}, ' spent — membership = C$8.75/mo')
           WHEN persona_segment = 'Reluctant Commuter' THEN concat('Commuter nudge: ', k, ' rides → break-even in ', {n(r(q('105.0', 's / k')))}, ' more rides')
           ELSE 'Standard membership CTA' END AS recommended_nudge_message,
      {r('''least(s / 105.0::DOUBLE, 1.0::DOUBLE) * 40 + least(k / 10.0::DOUBLE, 1.0::DOUBLE) * 25
          + CASE WHEN idle <= 3 THEN 20 WHEN idle <= 7 THEN 15 WHEN idle <= 14 THEN 5 ELSE 0 END + eb * 15''')} AS priority_score
    FROM g ORDER BY priority_score DESC, user_id LIMIT {limit}"""


CASUAL = "user_type = 'Casual Member'"


def _exploration() -> dict[str, str]:
    out = {}

    def pct(expr: str, p: float, div: str = "1.0") -> str:
        return r(f"quantile_cont({expr}, {p}) / {div}::DOUBLE", 2)

    cents = "CAST(ride_cost_cad * 100 AS BIGINT)"
    out["duration_stats"] = f"""{TABLES},
    timed AS (SELECT user_type, duration_min AS t FROM rides WHERE duration_min IS NOT NULL)
    SELECT user_type, COUNT(*) AS count, {r(q('SUM(t)', 'COUNT(*)'), 2)} AS mean, {pct('t', 0.5)} AS median,
      {r('stddev_samp(t)', 2)} AS std, {pct('t', 0.25)} AS p25, {pct('t', 0.75)} AS p75, {pct('t', 0.95)} AS p95
    FROM timed GROUP BY 1"""
    out["casual_cost_by_bike"] = f"""{TABLES}
    SELECT bike_type, {r(q('CAST(SUM(ride_cost_cad) AS DOUBLE)', 'COUNT(*)'), 2)} AS mean,
      {pct(f'CAST({cents} AS DOUBLE)', 0.5, '100.0')} AS median, {r('CAST(SUM(ride_cost_cad) AS DOUBLE)', 2)} AS total
    FROM rides WHERE {CASUAL} GROUP BY 1"""
    out["breakeven"] = f"""{TABLES},
    g AS (SELECT bike_type, {q('CAST(SUM(ride_cost_cad) AS DOUBLE)', 'COUNT(*)')} AS c FROM rides WHERE {CASUAL} GROUP BY 1
          UNION ALL SELECT 'ALL', {q('CAST(SUM(ride_cost_cad) AS DOUBLE)', 'COUNT(*)')} FROM rides WHERE {CASUAL})
    SELECT bike_type, {r('c', 2)} AS avg_ride_cost_cad, {r(q('105.0', 'c'), 1)} AS breakeven_rides,
      {r(f"{q('105.0', 'c')} / 8.0::DOUBLE", 1)} AS breakeven_months FROM g"""

    def hist(group: str, where: str, value: str, top: int, bins: int, unit: str) -> str:
        return f"""{TABLES},
    v AS (SELECT {group}, least(greatest({value}, 0), {top}) AS v FROM rides WHERE {where} AND {value} IS NOT NULL),
    b AS (SELECT {group}, MIN(v) AS lo, MAX(v) AS hi, COUNT(*) AS total FROM v GROUP BY 1),
    p AS (SELECT {group}, lo, hi, total,
        CASE WHEN hi = lo THEN 0 WHEN v = hi THEN {bins - 1} ELSE floor((v - lo) * {bins} / (hi - lo)) END AS bin
      FROM v JOIN b USING ({group})),
    c AS (SELECT {group}, bin, COUNT(*) AS rides, ANY_VALUE(lo) AS lo, ANY_VALUE(total) AS total,
        (ANY_VALUE(hi) - ANY_VALUE(lo)) * {unit}::DOUBLE / {bins}::DOUBLE AS w FROM p GROUP BY 1, 2)
    SELECT {group}, {n('bin')} AS bin, {r(f'lo * {unit}::DOUBLE + bin * w', 6)} AS bin_start, rides,
      {r(q('rides', 'total * w'), 6)} AS density FROM c"""

    out["duration_histogram"] = hist("user_type", "TRUE", "duration_min", 60, 60, "1.0")
    out["cost_histogram"] = hist("bike_type", CASUAL, cents, 1500, 40, "0.01")
    out["duration_box"] = f"""{TABLES},
    v AS (SELECT user_type, least(greatest(duration_min, 0), 60) AS v FROM rides WHERE duration_min IS NOT NULL),
    b AS (SELECT user_type, quantile_cont(CAST(v AS DOUBLE), 0.25) AS a, quantile_cont(CAST(v AS DOUBLE), 0.5) AS m,
        quantile_cont(CAST(v AS DOUBLE), 0.75) AS z, {q('SUM(v)', 'COUNT(*)')} AS mean FROM v GROUP BY 1),
    f AS (SELECT *, v BETWEEN a - 1.5 * (z - a) AND z + 1.5 * (z - a) AS ok FROM v JOIN b USING (user_type))
    SELECT user_type, {r('ANY_VALUE(a)', 2)} AS q1, {r('ANY_VALUE(m)', 2)} AS median,
      {r('ANY_VALUE(z)', 2)} AS q3, {r('MIN(v) FILTER (ok)', 2)} AS whisker_low,
      {r('MAX(v) FILTER (ok)', 2)} AS whisker_high, {r('ANY_VALUE(mean)', 2)} AS mean,
      COUNT(*) FILTER (NOT ok) AS outliers
    FROM f GROUP BY 1"""
    sides = f"COUNT(*) FILTER (user_type = 'Annual Member') AS annual_member, COUNT(*) FILTER ({CASUAL}) AS casual_member"
    out["rides_by_month"] = f"""{TABLES} SELECT {n('month(started_at)')} AS month_no, monthname(started_at) AS month_name, {sides}
    FROM rides GROUP BY 1, 2"""
    out["rides_by_weekday"] = f"""{TABLES} SELECT {n('isodow(started_at)')} AS day_no, dayname(started_at) AS day_name, {sides}
    FROM rides GROUP BY 1, 2"""
    out["rides_by_hour"] = f"""{TABLES} SELECT {n('hour(started_at)')} AS hour_of_day, {sides} FROM rides GROUP BY 1"""
    out["category_share"] = f"""{TABLES},
    c AS (SELECT 'user_type' AS dimension, user_type AS category, COUNT(*) AS rides FROM rides GROUP BY 2
          UNION ALL SELECT 'bike_type', bike_type, COUNT(*) FROM rides GROUP BY 2)
    SELECT *, {r(q('rides * 100', 'SUM(rides) OVER (PARTITION BY dimension)'), 1)} AS pct FROM c"""
    out["spend_curve"] = f"""{TABLES},
    m AS (SELECT {q("CAST(SUM(ride_cost_cad) FILTER (bike_type = 'ICONIC') AS DOUBLE)", "COUNT(*) FILTER (bike_type = 'ICONIC')")} AS c,
        {q("CAST(SUM(ride_cost_cad) FILTER (bike_type = 'EFIT') AS DOUBLE)", "COUNT(*) FILTER (bike_type = 'EFIT')")} AS e
      FROM rides WHERE {CASUAL})
    SELECT k AS rides_per_month, {r('k * c', 2)} AS classic_spend, {r('k * e', 2)} AS ebike_spend,
      {r('8.75', 2)} AS membership_monthly, k * c > 8.75 AS classic_pays_off, k * e > 8.75 AS ebike_pays_off
    FROM m, range(2, 20) t(k)"""
    feats = f"""
    ft AS (SELECT ride_id, duration_min, {n('hour(started_at)')} AS hour_of_day,
        {n('isodow(started_at) > 5')} AS is_weekend, {n("bike_type = 'EFIT'")} AS is_ebike,
        {n('month(started_at)')} AS month, {n('month(started_at) BETWEEN 6 AND 8')} AS is_summer,
        {n('hour(started_at) BETWEEN 7 AND 9')} AS is_peak_hr, ride_cost_cad
      FROM rides WHERE {CASUAL})"""
    out["cluster_features"] = f"{TABLES}, {feats} SELECT * REPLACE (CAST(ride_cost_cad AS DOUBLE) AS ride_cost_cad) FROM ft"
    names = ["duration_min", "hour_of_day", "is_weekend", "is_ebike", "month", "is_summer", "is_peak_hr"]
    moments = ", ".join(f"{q(f'SUM({f})', 'COUNT(*)')} AS m_{f}, {q(f'SUM({f} * {f})', 'COUNT(*)')} AS s_{f}" for f in names)
    scaled = ", ".join(
        r(f"COALESCE({q(f'{f} - m_{f}', f'sqrt(greatest(s_{f} - m_{f} * m_{f}, 0))')}, 0)", 6) + f" AS {f}" for f in names)
    out["feature_scaling"] = f"{TABLES}, {feats}, mo AS (SELECT {moments} FROM ft) SELECT ride_id, {scaled} FROM ft, mo"
    return out


def _economics() -> dict[str, str]:
    out = {}
    out["funnel_shares"] = f"""{TABLES},
    b AS (SELECT DISTINCT user_id FROM rides WHERE {CASUAL} AND started_at >= {days_ago(30)}),
    e AS (SELECT event_type, user_id FROM membership_events WHERE event_at >= {days_ago(30)}),
    s AS (SELECT 1::BIGINT AS stage_no, 'casual_riders' AS stage, (SELECT COUNT(*) FROM b) AS riders
      UNION ALL SELECT k::BIGINT, name, (SELECT COUNT(DISTINCT e.user_id) FROM e JOIN b USING (user_id) WHERE event_type = name)
      FROM (VALUES (2, 'cta_shown'), (3, 'cta_clicked'), (4, 'signup_started'), (5, 'signup_completed')) v(k, name))
    SELECT *, {r(q('riders', "(SELECT riders FROM s WHERE stage_no = 1)"), 4)} AS share_of_base,
      {r(f"1.0::DOUBLE - {q('riders', 'LAG(riders) OVER (ORDER BY stage_no)')}", 4)} AS drop_from_previous FROM s"""
    out["arr_scenarios"] = f"""{TABLES},
    m AS (SELECT COUNT(*) / 12.0::DOUBLE AS v FROM rides WHERE {CASUAL} AND started_at >= DATE '2023-01-01')
    SELECT operator, scenario, rate::DOUBLE AS rate, {r('v', 1)} AS monthly_casual_rides,
      {n('floor(v * rate::DOUBLE)')} AS members_per_month,
      {r("CAST(floor(v * rate::DOUBLE) AS BIGINT) * price::DOUBLE * 12 / 1000.0::DOUBLE", 3)} AS arr_k,
      {n('floor(v * rate::DOUBLE) - floor(v * 0.028::DOUBLE)')} AS incremental_members_per_month,
      {r("CAST(floor(v * rate::DOUBLE) - floor(v * 0.028::DOUBLE) AS BIGINT) * price::DOUBLE * 12 / 1000.0::DOUBLE", 3)} AS incremental_arr_k
    FROM m, (VALUES ('toronto', 105), ('divvy', 105), ('citibike', 179), ('santander', 120)) o(operator, price),
      (VALUES ('Current (2.8%)', 0.028), ('Post-nudge (4.2%)', 0.042), ('Q3 target (5.0%)', 0.050), ('Stretch (7.5%)', 0.075)) s(scenario, rate)"""
    out["price_ladder"] = f"""{TABLES},
    m AS (SELECT {q('CAST(SUM(ride_cost_cad) AS DOUBLE)', 'COUNT(*)')} AS c FROM rides WHERE {CASUAL}),
    o AS (SELECT * FROM (VALUES ('toronto', 4.48, 15, 105, 120), ('divvy', 3.3, 15, 105, NULL), ('citibike', 4.5, 15, 179, NULL),
      ('santander', 3.2, 18, 120, NULL)) o(operator, ride, day_pass, annual, plus)),
    l AS (SELECT operator, 1 AS step_no, 'single_ride' AS step, ride::DOUBLE AS price FROM o UNION ALL SELECT operator, 2, 'day_pass', day_pass FROM o
      UNION ALL SELECT operator, 3, 'weekend', annual::DOUBLE * 0.6::DOUBLE FROM o UNION ALL SELECT operator, 4, 'annual', annual FROM o
      UNION ALL SELECT operator, 5, 'annual_plus', plus FROM o WHERE plus IS NOT NULL)
    SELECT operator, {n('step_no')} AS step_no, step, {r('price', 2)} AS price, {n(f"ceil({q('price', 'c')})")} AS rides_to_pay_back FROM l, m"""
    out["operator_breakeven"] = f"""{TABLES},
    m AS (SELECT {q('CAST(SUM(ride_cost_cad) AS DOUBLE)', 'COUNT(*)')} AS c FROM rides WHERE {CASUAL})
    SELECT operator, city, currency, price::DOUBLE AS annual_price, {n('ceil(price::DOUBLE / cost::DOUBLE)')} AS breakeven_rides_published,
      {r('c', 2)} AS observed_ride_cost, {n(f"ceil({q('price', 'c')})")} AS breakeven_rides_observed,
      {r('price::DOUBLE * 0.6::DOUBLE')} AS weekend_tier_price
    FROM m, (VALUES ('toronto', 'Toronto, ON', 'CAD', 105, 4.48), ('divvy', 'Chicago, IL', 'USD', 105, 3.3),
      ('citibike', 'New York, NY', 'USD', 179, 4.5), ('santander', 'London, UK', 'GBP', 120, 3.2)) o(operator, city, currency, price, cost)"""
    out["ebike_price_gap"] = f"""{TABLES}
    SELECT duration_min, COUNT(*) AS rides, {r('duration_min * 0.20::DOUBLE', 2)} AS casual_cost,
      {r('duration_min * 0.10::DOUBLE', 2)} AS member_cost,
      {r('duration_min * 0.20::DOUBLE - duration_min * 0.10::DOUBLE', 2)} AS gap,
      {r(q('105.0', 'duration_min * 0.20::DOUBLE'), 1)} AS breakeven_rides
    FROM rides WHERE bike_type = 'EFIT' GROUP BY 1"""
    return out


FIRST_CONV = """
    conv AS (SELECT user_id, MIN(event_at) AS conv_at FROM membership_events WHERE event_type = 'signup_completed' GROUP BY 1)"""


def _growth() -> dict[str, str]:
    out = {}
    out["north_star_90d"] = f"""{TABLES}, {FIRST_CONV},
    x AS (SELECT CAST(date_trunc('month', first_ride_at) AS DATE) AS m,
        COALESCE(conv_at >= first_ride_at AND conv_at <= first_ride_at + INTERVAL 90 DAY, FALSE) AS ok
      FROM users LEFT JOIN conv USING (user_id)
      WHERE first_ride_at <= {days_ago(90)} AND user_id IN (SELECT user_id FROM rides WHERE {CASUAL})),
    g AS (SELECT m, COUNT(*) AS riders, COUNT(*) FILTER (ok) AS converted FROM x GROUP BY 1
          UNION ALL SELECT NULL, COUNT(*), COUNT(*) FILTER (ok) FROM x)
    SELECT m AS first_ride_month, riders, converted, {r(q('converted', 'riders'), 4)} AS conversion_rate FROM g"""
    out["cta_exposure_monthly"] = f"""{TABLES},
    a AS (SELECT DISTINCT user_id, CAST(date_trunc('month', started_at) AS DATE) AS month FROM rides WHERE {CASUAL}),
    b AS (SELECT DISTINCT user_id, CAST(date_trunc('month', event_at) AS DATE) AS month, 1 AS seen
          FROM membership_events WHERE event_type = 'cta_shown')
    SELECT month, COUNT(*) AS casual_riders, COUNT(seen) AS exposed_riders,
      {r(q('COUNT(seen)', 'COUNT(*)'), 4)} AS exposure_rate FROM a LEFT JOIN b USING (user_id, month) GROUP BY 1"""
    out["ctr_by_surface"] = f"""{TABLES},
    g AS (SELECT source_channel, COUNT(*) FILTER (event_type = 'cta_shown') AS impressions,
        COUNT(*) FILTER (event_type = 'cta_clicked') AS clicks,
        COUNT(DISTINCT user_id) FILTER (event_type = 'cta_shown') AS users_shown,
        COUNT(DISTINCT user_id) FILTER (event_type = 'cta_clicked') AS users_clicked FROM membership_events GROUP BY 1)
    SELECT *, {r(q('clicks', 'impressions'), 4)} AS ctr, {r(q('users_clicked', 'users_shown'), 4)} AS user_ctr FROM g"""
    out["step_completion"] = f"""{TABLES},
    s AS (SELECT CASE WHEN event_type = 'signup_started' THEN 1 WHEN event_type = 'signup_completed' THEN 5
                      WHEN event_type = 'signup_step_completed' THEN CAST(json_extract_string(event_metadata, '$.step') AS INT) END AS s,
        user_id FROM membership_events WHERE event_at >= {days_ago(30)}),
    c AS (SELECT k, COUNT(DISTINCT user_id) AS u FROM range(1, 6) t(k) LEFT JOIN s ON s.s = k GROUP BY 1),
    w AS (SELECT CAST(a.k AS VARCHAR) AS step, a.u AS users_in, b.u AS users_out FROM c a JOIN c b ON b.k = a.k + 1
          UNION ALL SELECT 'overall', a.u, b.u FROM c a, c b WHERE a.k = 1 AND b.k = 5)
    SELECT *, {r(q('users_out', 'users_in'), 4)} AS completion_rate FROM w"""
    out["conversion_by_persona"] = f"""{TABLES},
    pop AS (SELECT user_id, persona_segment FROM users WHERE persona_segment <> 'Seasonal Visitor'
             AND user_id IN (SELECT user_id FROM rides WHERE {CASUAL} AND started_at >= {days_ago(90)})),
    e AS (SELECT user_id, source_channel, event_type FROM membership_events WHERE event_at >= {days_ago(90)}),
    x AS (SELECT 'persona' AS dimension, persona_segment AS segment, b.user_id, event_type FROM pop b LEFT JOIN e USING (user_id)
          UNION ALL SELECT 'channel', source_channel, b.user_id, event_type FROM pop b JOIN e USING (user_id)),
    g AS (SELECT dimension, segment, COUNT(DISTINCT user_id) AS riders,
        COUNT(DISTINCT user_id) FILTER (event_type = 'signup_completed') AS converted FROM x GROUP BY 1, 2)
    SELECT *, {r(q('converted', 'riders'), 4)} AS conversion_rate FROM g"""
    out["active_members"] = f"""{TABLES}, {FIRST_CONV},
    a AS (SELECT DISTINCT user_id, 1 AS one FROM rides WHERE started_at >= {days_ago(30)})
    SELECT persona_segment, COUNT(*) AS total_members, COUNT(one) AS active_members,
      {r(q('COUNT(one)', 'COUNT(*)'), 4)} AS active_share
    FROM users JOIN conv USING (user_id) LEFT JOIN a USING (user_id) GROUP BY 1"""
    renewed = f"""{FIRST_CONV},
    ren AS (SELECT c.user_id, CAST(conv_at AS DATE) AS fd,
        COUNT(*) FILTER (date_diff('day', CAST(conv_at AS DATE), CAST(e.event_at AS DATE)) BETWEEN 330 AND 400) > 0 AS again
      FROM conv c JOIN membership_events e ON e.user_id = c.user_id AND e.event_type = 'signup_completed'
      WHERE date_diff('day', CAST(conv_at AS DATE), {AS_OF}) >= 400 GROUP BY 1, 2)"""
    out["renewal_rate"] = f"""{TABLES}, {renewed}
    SELECT CAST(date_trunc('month', fd) AS DATE) AS cohort_month, COUNT(*) AS members,
      COUNT(*) FILTER (again) AS renewed, {r(q('COUNT(*) FILTER (again)', 'COUNT(*)'), 4)} AS renewal_rate
    FROM ren GROUP BY 1"""
    out["post_conversion_rides_90d"] = f"""{TABLES}, {FIRST_CONV},
    x AS (SELECT c.user_id, persona_segment, COUNT(ride_id) AS k FROM conv c JOIN users USING (user_id)
          LEFT JOIN rides y ON y.user_id = c.user_id AND y.started_at >= conv_at AND y.started_at < conv_at + INTERVAL 90 DAY
          WHERE conv_at <= {days_ago(90)} GROUP BY 1, 2)
    SELECT persona_segment, COUNT(*) AS members, {r(q('SUM(k)', 'COUNT(*)'), 2)} AS avg_rides_90d,
      COUNT(*) FILTER (k >= 12) AS members_at_target, {r(q('COUNT(*) FILTER (k >= 12)', 'COUNT(*)'), 4)} AS share_at_target
    FROM x GROUP BY 1"""
    out["guardrail_thresholds"] = f"""{TABLES}, {renewed},
    nd AS (SELECT DISTINCT user_id, nudge_variant, CAST(event_at AS DATE) AS d FROM membership_events
           WHERE event_type = 'cta_shown' AND event_at >= {days_ago(28)}),
    ur AS (SELECT nudge_variant, {q("COUNT(DISTINCT a.user_id)", "COUNT(DISTINCT nd.user_id)")} AS rate FROM nd LEFT JOIN app_events a
           ON a.user_id = nd.user_id AND a.event_type = 'app_uninstall' AND a.event_at >= nd.d GROUP BY 1),
    uc AS (SELECT MAX(rate) FILTER (nudge_variant = 'treatment') AS t, MAX(rate) FILTER (nudge_variant = 'control') AS c FROM ur),
    vol AS (SELECT COUNT(*) FILTER (started_at >= DATE '2023-12-01' AND started_at < DATE '2024-01-01') AS cur,
        COUNT(*) FILTER (started_at >= DATE '2023-11-01' AND started_at < DATE '2023-12-01') AS prev FROM rides WHERE {CASUAL}),
    m AS (SELECT 'uninstall_rate_vs_control' AS metric, {q('t - c', 'c')} AS v, 0.05::DOUBLE AS threshold, 1 AS s FROM uc
      UNION ALL SELECT 'casual_volume_vs_previous_month', {q('cur - prev', 'prev')}, -0.10::DOUBLE, -1 FROM vol
      UNION ALL SELECT 'member_year_1_churn', 1.0::DOUBLE - {q('COUNT(*) FILTER (again)', 'COUNT(*)')}, 0.35::DOUBLE, 1 FROM ren)
    SELECT metric, {r('v', 4)} AS value, threshold,
      CASE WHEN v IS NULL THEN 'NO DATA' WHEN v * s > threshold * s THEN 'BREACH' ELSE 'OK' END AS status FROM m"""
    out["tier_cannibalisation"] = f"""{TABLES},
    g AS (SELECT nudge_variant, COUNT(DISTINCT user_id) AS users,
        COUNT(DISTINCT user_id) FILTER (event_type = 'signup_completed') AS converted,
        COUNT(*) FILTER (membership_tier = 'annual') AS annual_signups,
        COUNT(*) FILTER (membership_tier = 'weekend') AS weekend_signups
      FROM membership_events WHERE event_at >= {days_ago(365)} GROUP BY 1)
    SELECT *, {r(q('converted', 'users'), 4)} AS conversion_rate,
      {r(q('weekend_signups', 'annual_signups + weekend_signups'), 4)} AS weekend_share FROM g"""
    return out


def _nudges() -> dict[str, str]:
    out = {}
    recent = f"""
    rec AS (SELECT user_id, COUNT(*) AS k, CAST(SUM(ride_cost_cad) AS DOUBLE) AS s FROM rides
            WHERE {CASUAL} AND started_at >= {days_ago(30)} GROUP BY 1)"""
    out["nudge_eligibility"] = f"""{TABLES}, {recent},
    h AS (SELECT user_id, COUNT(*) FILTER (event_type = 'cta_shown') AS i, COUNT(*) FILTER (event_type = 'signup_abandoned') AS d,
        MAX(event_at) FILTER (event_type = 'signup_abandoned') AS l, COUNT(*) FILTER (event_type = 'signup_completed') AS m
      FROM membership_events GROUP BY 1),
    x AS (SELECT rec.*, COALESCE(i, 0) AS i, COALESCE(d, 0) AS d, CASE WHEN m > 0 THEN 'member' WHEN d > 2 THEN 'dismissed'
        WHEN i > 2 THEN 'impression_cap' WHEN l + INTERVAL 7 DAY > {AS_OF} THEN 'snoozed' WHEN k < 2 THEN 'too_few_rides' END AS why
      FROM rec LEFT JOIN h USING (user_id))
    SELECT user_id, k AS rides_30d, s AS spend_30d, i AS impressions, d AS dismissals, why IS NULL AS eligible, why AS suppressed_by FROM x"""
    remaining = f"CAST(ceil({q('105.0::DOUBLE - s', q('s', 'k'))}) AS BIGINT)"
    out["nudge_message"] = f"""{TABLES}, {recent}
    SELECT user_id, k AS rides_30d, s AS spend_30d, {r('8.75', 2)} AS membership_per_month,
      greatest({remaining}, 0) AS rides_to_breakeven,
      CASE WHEN s > 105 THEN 'You''ve already spent more than a membership costs this year'
           WHEN k = 1 AND s * 365.0::DOUBLE / 30.0::DOUBLE > 105
             THEN concat('At this pace a membership saves you $', {n(r('s * 365.0::DOUBLE / 30.0::DOUBLE - 105.0::DOUBLE'))}, ' a year')
           WHEN k = 1 OR s = 0 THEN concat('At this pace single rides cost $', {n(r('s * 365.0::DOUBLE / 30.0::DOUBLE'))}, ' a year')
           ELSE concat('Annual membership: $8.75/month. You''re ', {remaining}, ' rides from breaking even.') END AS message
    FROM rec WHERE user_id NOT IN (SELECT user_id FROM membership_events WHERE event_type = 'signup_completed')"""
    out["breakeven_calculator"] = f"""{TABLES}, {recent},
    x AS (SELECT user_id, {q('s', 'k')} AS c, w, least(greatest({r('k * 7 / 30.0::DOUBLE')}, 1), 7) AS u FROM rec, range(1, 8) t(w))
    SELECT user_id, w AS rides_per_week, w = u AS prefilled, {r('c', 2)} AS avg_ride_cost,
      {n(f"ceil({q('105.0', 'c * w')})")} AS payback_weeks, {r('(c * w * 52 - 105.0::DOUBLE) / 12.0::DOUBLE', 2)} AS monthly_savings,
      {r('c * w * 52 - 105.0::DOUBLE', 2)} AS annual_savings FROM x"""
    out["weekday_credit_balance"] = f"""{TABLES},
    wm AS (SELECT user_id, CAST(date_trunc('month', MIN(event_at)) AS DATE) AS sm FROM membership_events
           WHERE membership_tier = 'weekend' GROUP BY 1),
    us AS (SELECT user_id, CAST(date_trunc('month', started_at) AS DATE) AS month, COUNT(*) AS k FROM rides
           WHERE user_type = 'Annual Member' AND isodow(started_at) < 6 GROUP BY 1, 2),
    slots AS (SELECT z.user_id, CAST(sm + INTERVAL 1 MONTH * CAST(i AS INT) AS DATE) AS month, i, COALESCE(k, 0) AS k
      FROM (SELECT user_id, sm, unnest(range(0, date_diff('month', sm, DATE '2023-12-01') + 1)) AS i FROM wm) z
      LEFT JOIN us y ON y.user_id = z.user_id AND y.month = CAST(sm + INTERVAL 1 MONTH * CAST(i AS INT) AS DATE)),
    bal AS (
      SELECT user_id, month, i, k, 0::BIGINT AS cin, greatest(10 - k, 0)::BIGINT AS cout FROM slots WHERE i = 0
      UNION ALL
      SELECT s.user_id, s.month, s.i, s.k, b.cout, greatest(10 - greatest(s.k - b.cout, 0), 0)::BIGINT
      FROM bal b JOIN slots s ON s.user_id = b.user_id AND s.i = b.i + 1)
    SELECT user_id, month, k AS weekday_rides, cin AS carried_in, greatest(k - cin - 10, 0) AS rides_over, cout AS carried_out FROM bal"""
    return out


def _experiments() -> dict[str, str]:
    z = NormalDist().inv_cdf
    za = repr(z(0.975))
    p2 = "p1 * (100 + lift) / 100.0::DOUBLE"
    out = {}
    out["experiment_sizing"] = f"""{TABLES},
    x AS (SELECT DISTINCT user_id, persona_segment FROM rides JOIN users USING (user_id)
          WHERE {CASUAL} AND started_at >= {days_ago(90)} AND persona_segment IS NOT NULL),
    e AS (SELECT user_id, event_type FROM membership_events WHERE event_at >= {days_ago(90)}),
    m AS (SELECT persona_segment, {q("COUNT(DISTINCT user_id) FILTER (event_type = 'signup_completed')", "COUNT(DISTINCT user_id)")} AS p1,
        COUNT(DISTINCT user_id) FILTER (event_type = 'cta_shown') / 90.0::DOUBLE AS daily FROM x LEFT JOIN e USING (user_id) GROUP BY 1),
    g AS (SELECT persona_segment, p1, daily, lift, power::DOUBLE AS power, z::DOUBLE AS z, {p2} AS p2
      FROM m, range(10, 61, 5) t(lift), (VALUES (0.8, {z(0.8)!r}), (0.9, {z(0.9)!r})) w(power, z)),
    k AS (SELECT *, (p1 + p2) / 2.0::DOUBLE AS pm FROM g),
    s AS (SELECT *, CASE WHEN p1 > 0 AND p2 < 1 THEN sqrt(pm * 2.0::DOUBLE * (1.0::DOUBLE - pm)) * {za}::DOUBLE
        + z * sqrt(p1 * (1.0::DOUBLE - p1) + p2 * (1.0::DOUBLE - p2)) END AS root FROM k),
    f AS (SELECT *, {n(f"ceil({q('root * root', '(p2 - p1) * (p2 - p1)')})")} AS need FROM s)
    SELECT persona_segment, lift AS lift_pct, power, {r('p1', 6)} AS baseline_rate, {r('p2', 6)} AS treatment_rate,
      need AS n_per_arm, {n(f"ceil({q('need', 'daily / 2.0::DOUBLE')})")} AS days_to_finish FROM f"""
    pc, pt = q("control_conversions", "control_users"), q("treatment_conversions", "treatment_users")
    pool = q("control_conversions + treatment_conversions", "control_users + treatment_users")
    err = f"sqrt({pool} * (1.0::DOUBLE - {pool}) * ({q('1.0', 'treatment_users')} + {q('1.0', 'control_users')}))"
    zz = q(f"{pt} - {pc}", err)
    out["experiment_readout"] = f"""{TABLES}, {CHANNEL_CELLS},
    w AS (SELECT source_channel, {n("COALESCE(SUM(users_exposed) FILTER (nudge_variant = 'control'), 0)")} AS control_users,
        {n("COALESCE(SUM(conversions) FILTER (nudge_variant = 'control'), 0)")} AS control_conversions,
        {n("COALESCE(SUM(users_exposed) FILTER (nudge_variant = 'treatment'), 0)")} AS treatment_users,
        {n("COALESCE(SUM(conversions) FILTER (nudge_variant = 'treatment'), 0)")} AS treatment_conversions FROM cells GROUP BY 1)
    SELECT *, {r(pc, 4)} AS control_rate, {r(pt, 4)} AS treatment_rate, {r(q(f'{pt} - {pc}', pc), 4)} AS relative_lift,
      {r(zz, 4)} AS z_statistic, abs({zz}) > {za} AS significant FROM w"""
    return out


def _telemetry() -> dict[str, str]:
    out = {}
    out["hashed_user_events"] = f"""{TABLES},
    ev AS (SELECT *, ROW_NUMBER() OVER () AS rn FROM membership_events),
    x AS (SELECT rn, COUNT(ride_id) AS k, CAST(COALESCE(SUM(ride_cost_cad), 0) AS DOUBLE) AS s FROM ev LEFT JOIN rides y
          ON y.user_id = ev.user_id AND y.started_at <= event_at AND y.started_at >= event_at - INTERVAL 30 DAY GROUP BY 1)
    SELECT event_id, event_type, event_at, sha256('farewheel check ' || CAST(ev.user_id AS VARCHAR)) AS user_hash, persona_segment,
      k AS ride_count_30d, s AS cumulative_spend_30d FROM ev JOIN x USING (rn) LEFT JOIN users u ON u.user_id = ev.user_id"""
    out["time_in_step"] = f"""{TABLES},
    f AS (SELECT user_id, event_id, event_type, event_at, event_type = 'signup_started' AS s FROM membership_events WHERE event_type LIKE 'signup%'),
    x AS (SELECT *, LAG(event_at) OVER w AS prev, MAX(event_at) FILTER (s) OVER (w ROWS UNBOUNDED PRECEDING) AS st
          FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_at, event_id))
    SELECT user_id, event_id, event_type, event_at,
      CASE WHEN prev >= st AND NOT s THEN CAST(date_diff('second', prev, event_at) AS DOUBLE) END AS time_on_step_seconds,
      CAST(date_diff('second', st, event_at) AS DOUBLE) AS time_in_flow_seconds FROM x"""
    return out


FUNNEL_EVENTS = """
    fe AS (SELECT event_id, user_id, ts, CASE event_type WHEN 'view' THEN 'cta_shown' WHEN 'click' THEN 'cta_clicked'
        WHEN 'signup' THEN 'signup_started' WHEN 'purchase' THEN 'signup_completed' WHEN 'error' THEN 'signup_abandoned' END AS kind
      FROM events)"""


def _jobs() -> dict[str, str]:
    out = {}
    out["ingest_trips"] = f"""{TABLES},
    whole AS (SELECT *, CAST(duration_min AS INT) AS m FROM rides)
    SELECT ride_id, user_id, started_at, started_at + INTERVAL 1 MINUTE * m AS ended_at, CAST(m AS DOUBLE) AS duration_min,
      user_type, bike_type, station_id,
      CAST(CASE WHEN user_type = 'Annual Member' AND bike_type = 'EFIT' THEN 0.10 * m WHEN user_type = 'Annual Member' THEN 0
                WHEN bike_type = 'EFIT' THEN 1.00 + 0.20 * m ELSE 1.00 + 0.12 * m END AS DECIMAL(10,2)) AS ride_cost_cad
    FROM whole"""
    out["persona_writeback"] = f"""{TABLES}, {RIDER_PROFILE}
    SELECT user_id, persona_segment, conversion_priority_score, {AS_OF} AS run_date FROM named"""
    out["persona_funnel_after_writeback"] = _funnel_by_persona(False, classified=True)
    out["funnel_feed"] = f"SELECT *, {AS_OF} AS run_date FROM ({_funnel_daily()})"
    out["stream_funnel"] = f"""WITH {FUNNEL_EVENTS}
    SELECT CAST(ts AS DATE) AS event_day, kind AS event_type, COUNT(DISTINCT user_id) AS riders
    FROM fe WHERE kind IS NOT NULL GROUP BY 1, 2"""
    out["stream_event_dedup"] = f"""WITH {FUNNEL_EVENTS}
    SELECT DISTINCT event_id, user_id, kind AS event_type, ts AS event_at FROM fe WHERE kind IS NOT NULL"""
    out["stream_signup_sessions"] = f"""WITH {FUNNEL_EVENTS},
    flow AS (SELECT *, MAX(ts) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
          FROM fe WHERE kind LIKE 'signup%'),
    cut AS (SELECT *, SUM(CASE WHEN before IS NULL OR ts > before + INTERVAL 30 MINUTE THEN 1 ELSE 0 END)
              OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM flow)
    SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS events,
      COUNT(*) FILTER (kind = 'signup_completed') = 0 AS abandoned
    FROM cut GROUP BY user_id, no
    HAVING COUNT(*) FILTER (kind = 'signup_started') > 0"""
    out["stream_nudge_trigger"] = f"""{TABLES},
    en AS (SELECT *, started_at + INTERVAL 1 MINUTE * CAST(duration_min AS INT) AS at_end FROM rides),
    cs AS (SELECT * FROM en WHERE {CASUAL}),
    win AS (SELECT a.user_id, a.ride_id, a.at_end, COUNT(*) AS k, CAST(SUM(b.ride_cost_cad) AS DOUBLE) AS s
      FROM cs a JOIN cs b ON b.user_id = a.user_id AND (b.at_end, b.ride_id) <= (a.at_end, a.ride_id)
        AND date_diff('day', CAST(b.at_end AS DATE), CAST(a.at_end AS DATE)) < 30 GROUP BY 1, 2, 3),
    ok AS (SELECT w.*, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY at_end, ride_id) AS impression FROM win w
      WHERE k >= 2
        AND NOT EXISTS (SELECT 1 FROM en e WHERE e.user_id = w.user_id AND e.h = 36 AND e.at_end < w.at_end)
        AND (SELECT COUNT(*) FROM en e WHERE e.user_id = w.user_id AND e.h BETWEEN 32 AND 35 AND e.at_end < w.at_end) < 3
        AND NOT EXISTS (SELECT 1 FROM en e WHERE e.user_id = w.user_id AND e.h BETWEEN 32 AND 35
                        AND e.at_end < w.at_end AND e.at_end + INTERVAL 7 DAY > w.at_end))
    SELECT user_id, ride_id, at_end AS nudge_at, k AS rides_30d, s AS spend_30d, impression, 8.75::DOUBLE AS membership_per_month,
      CASE WHEN s > 0 THEN greatest({n('ceil(' + q('105.0::DOUBLE - s', q('s', 'k')) + ')')}, 0) END AS rides_to_breakeven, persona_segment
    FROM ok LEFT JOIN users USING (user_id) WHERE impression <= 3"""
    return out


def oracle_queries() -> dict[str, str]:
    out = {
        "funnel_daily": _funnel_daily(),
        "funnel_by_persona": _funnel_by_persona(False),
        "funnel_by_persona_grain_safe": _funnel_by_persona(True),
        "funnel_by_channel_variant": _funnel_by_channel_variant(),
        "signup_step_dropoff": _signup_step_dropoff(False),
        "signup_step_dropoff_grain_safe": _signup_step_dropoff(True),
        "time_to_convert": _time_to_convert(),
        "cohort_retention": _cohort_retention(False),
        "cohort_retention_grain_safe": _cohort_retention(True),
        "retention_by_persona": _retention_by_persona(),
        "churn_early_warning": _churn_early_warning(),
        "member_ytd_savings": _member_ytd_savings(False),
        "member_ytd_savings_grain_safe": _member_ytd_savings(True),
        "nudge_guardrails": _nudge_guardrails(False),
        "nudge_guardrails_grain_safe": _nudge_guardrails(True),
        "classify_riders": f"{TABLES}, {RIDER_PROFILE} SELECT * FROM named",
        "persona_summary": _persona_summary(),
        "ebike_savings": _ebike_savings(),
        "tier_recommendation": f"""{TABLES}, {RIDER_PROFILE}
    SELECT user_id, persona_segment, pct_weekend,
      pct_weekend >= 0.5 AND persona_segment <> 'Reluctant Commuter' AS weekend_tier_shown,
      CASE WHEN persona_segment = 'Seasonal Visitor' THEN 'day_pass'
           WHEN persona_segment IN ('Reluctant Commuter', 'E-bike Adopter') THEN 'annual'
           WHEN pct_weekend >= 0.5 THEN 'weekend' ELSE 'annual' END AS recommended_tier FROM named""",
        "priority_nudge_targets": _priority_nudge_targets(False, 10_000),
        "priority_nudge_targets_grain_safe": _priority_nudge_targets(True, 10_000),
    }
    for group in (_exploration, _economics, _growth, _nudges, _experiments, _telemetry, _jobs):
        out.update(group())
    return out
