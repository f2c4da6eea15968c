"""Query name -> (spark, data directory) -> lazy DataFrame."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from farewheel.model import Tables
from farewheel.functions import horizon
from farewheel.functions.columns import since, ts
from farewheel.operators import (
    attribution, clustering, coreset, delivery, economics, experiments, exploration, funnel, growth, incremental, nudges, ordered, retention,
    segmentation, sketches, telemetry,
)
from farewheel.params import DEFAULTS, SIGNUP_STARTED, Params
from farewheel.sources import storage, trips
from farewheel.sources.storage import scratch_dir
from farewheel.sources.versioned import VersionedTable
from farewheel.sources.warehouse import open_tables, source_table, tables_root
from farewheel.streaming import events as live_events, late, latency, nudges as live_nudges, runtime

Query = Callable[[SparkSession, str], DataFrame]


# Known to the check SQL as well; a real job passes a secret.
CHECK_SALT = "farewheel check "


def on_tables(build: Callable[[Tables], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(open_tables(spark, sf_dir))


@functools.cache
def _personas(tables: Tables, as_of: date) -> DataFrame:
    return clustering.clustered_points(tables.rides, as_of=as_of)


def personas(tables: Tables) -> DataFrame:
    """The clustered points of one run's tables and day, fitted once for the queries on them."""
    return _personas(tables, horizon.DEFAULTS.as_of)


# Operators over the canonical tables.
TABLE_QUERIES: dict[str, Callable[[Tables], DataFrame]] = {
    # funnel
    "funnel_daily": lambda t: funnel.funnel_daily(t.rides, t.membership_events),
    "funnel_by_persona": lambda t: funnel.funnel_by_persona(t.rides, t.users, t.membership_events),
    "funnel_by_persona_grain_safe": lambda t: funnel.funnel_by_persona(
        t.rides, t.users, t.membership_events, grain_safe=True),
    "funnel_by_channel_variant": lambda t: funnel.funnel_by_channel_variant(t.membership_events),
    "signup_step_dropoff": lambda t: funnel.signup_step_dropoff(t.membership_events),
    "ordered_signup_funnel": lambda t: ordered.ordered_signup_funnel(t.membership_events),
    "signup_step_dropoff_grain_safe": lambda t: funnel.signup_step_dropoff(t.membership_events, grain_safe=True),
    "time_to_convert": lambda t: funnel.time_to_convert(t.users, t.membership_events, t.rides),
    # retention
    "cohort_retention": lambda t: retention.cohort_retention(t.membership_events, t.rides),
    "cohort_retention_grain_safe": lambda t: retention.cohort_retention(
        t.membership_events, t.rides, grain_safe=True),
    "retention_by_persona": lambda t: retention.retention_by_persona(t.membership_events, t.users, t.rides),
    "churn_early_warning": lambda t: retention.churn_early_warning(t.rides, t.users, t.membership_events),
    "member_ytd_savings": lambda t: retention.member_ytd_savings(t.rides, t.users, t.membership_events),
    "member_ytd_savings_grain_safe": lambda t: retention.member_ytd_savings(
        t.rides, t.users, t.membership_events, grain_safe=True),
    "nudge_guardrails": lambda t: retention.nudge_guardrails(t.membership_events, t.rides, t.app_events),
    "nudge_guardrails_grain_safe": lambda t: retention.nudge_guardrails_grain_safe(
        t.membership_events, t.rides, t.app_events),
    # segmentation
    "classify_riders": lambda t: segmentation.classify_riders(t.rides),
    "persona_summary": lambda t: segmentation.persona_summary(t.users, t.rides),
    "ebike_savings": lambda t: segmentation.ebike_savings(t.rides),
    "tier_recommendation": lambda t: segmentation.tier_recommendation(t.rides),
    "priority_nudge_targets": lambda t: segmentation.priority_nudge_targets(
        t.rides, t.users, t.membership_events),
    "priority_nudge_targets_grain_safe": lambda t: segmentation.priority_nudge_targets(
        t.rides, t.users, t.membership_events, grain_safe=True),
    # exploration
    "duration_stats": lambda t: exploration.duration_stats(t.rides),
    "casual_cost_by_bike": lambda t: exploration.casual_cost_by_bike(t.rides),
    "breakeven": lambda t: exploration.breakeven(t.rides),
    "duration_histogram": lambda t: exploration.duration_histogram(t.rides),
    "cost_histogram": lambda t: exploration.cost_histogram(t.rides),
    "duration_box": lambda t: exploration.duration_box(t.rides),
    "rides_by_month": lambda t: exploration.rides_by_month(t.rides),
    "rides_by_weekday": lambda t: exploration.rides_by_weekday(t.rides),
    "rides_by_hour": lambda t: exploration.rides_by_hour(t.rides),
    "category_share": lambda t: exploration.category_share(t.rides),
    "spend_curve": lambda t: exploration.spend_curve(t.rides),
    "cluster_features": lambda t: exploration.cluster_features(t.rides),
    # clustering
    "feature_scaling": lambda t: clustering.feature_scaling(t.rides),
    "cluster_k_sweep": lambda t: clustering.cluster_k_sweep(t.rides),
    "cluster_profiles": lambda t: clustering.cluster_profiles(personas(t)),
    "cluster_centres": lambda t: clustering.cluster_centres(personas(t)),
    "cluster_continuous": lambda t: coreset.cluster_continuous(t.rides),
    "cluster_labels": lambda t: clustering.cluster_labels(personas(t)),
    "cluster_projection": lambda t: clustering.cluster_projection(t.rides, personas(t)),
    "persona_feature_profile": lambda t: clustering.persona_feature_profile(personas(t)),
    # economics
    "funnel_shares": lambda t: economics.funnel_shares(t.rides, t.membership_events),
    "arr_scenarios": lambda t: economics.arr_scenarios(t.rides),
    "price_ladder": lambda t: economics.price_ladder(t.rides),
    "operator_breakeven": lambda t: economics.operator_breakeven(t.rides),
    "ebike_price_gap": lambda t: economics.ebike_price_gap(t.rides),
    # growth
    "north_star_90d": lambda t: growth.north_star_90d(t.rides, t.users, t.membership_events),
    "cta_exposure_monthly": lambda t: growth.cta_exposure_monthly(t.rides, t.membership_events),
    "ctr_by_surface": lambda t: growth.ctr_by_surface(t.membership_events),
    "step_completion": lambda t: growth.step_completion(t.membership_events),
    "conversion_by_persona": lambda t: growth.conversion_by_persona(t.rides, t.users, t.membership_events),
    "conversion_by_last_touch": lambda t: attribution.conversion_by_last_touch(t.membership_events),
    "active_members": lambda t: growth.active_members(t.rides, t.users, t.membership_events),
    "renewal_rate": lambda t: growth.renewal_rate(t.membership_events),
    "post_conversion_rides_90d": lambda t: growth.post_conversion_rides_90d(
        t.rides, t.users, t.membership_events),
    "guardrail_thresholds": lambda t: growth.guardrail_thresholds(t.membership_events, t.rides, t.app_events),
    "tier_cannibalisation": lambda t: growth.tier_cannibalisation(t.membership_events),
    # nudges; the tables hold no dismissals, so abandoned sign-ups stand for them
    "nudge_eligibility": lambda t: nudges.nudge_eligibility(
        t.rides, t.membership_events, dismissed="signup_abandoned"),
    "nudge_channels": lambda t: nudges.nudge_channels(
        t.rides, t.membership_events, dismissed="signup_abandoned"),
    "nudge_message": lambda t: nudges.nudge_message(t.rides, t.membership_events),
    "breakeven_calculator": lambda t: nudges.breakeven_calculator(t.rides),
    "weekday_credit_balance": lambda t: nudges.weekday_credit_balance(t.rides, t.membership_events),
    # experiments
    "experiment_sizing": lambda t: experiments.experiment_sizing(t.rides, t.users, t.membership_events),
    "experiment_readout": lambda t: experiments.experiment_readout(t.membership_events),
    # telemetry
    "hashed_user_events": lambda t: telemetry.hashed_user_events(
        t.rides, t.users, t.membership_events, salt=CHECK_SALT),
    "time_in_step": lambda t: telemetry.time_in_step(t.membership_events),
}


_TRIP_FILES: dict[str, str] = {}


def ingest_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides in the published CSV layout, read back into the rides table with riders from
    a lookup. The files are written once in a session."""
    key = tables_root(spark, sf_dir)
    if key not in _TRIP_FILES:
        path = scratch_dir(spark, "trips")
        trips.write_trips(open_tables(spark, sf_dir).rides, path)
        _TRIP_FILES[key] = path
    # one row per ride, dealt by ride already as the join wants it
    riders = open_tables(spark, sf_dir).rides.groupBy("ride_id").agg(F.min("user_id").alias("user_id"))
    return trips.read_trips(spark, _TRIP_FILES[key], riders=riders)


def persona_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nightly job: classify, replace the run's partition, read it back."""
    path = scratch_dir(spark, "user_persona")
    run = str(DEFAULTS.as_of)
    personas = segmentation.score_riders(open_tables(spark, sf_dir).rides).select(
        "user_id", "persona_segment", "conversion_priority_score"
    )
    storage.write_run(personas, "run_date", run, path)
    return spark.read.parquet(path).filter(f"run_date = DATE'{run}'")


def persona_funnel_after_writeback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Funnel per persona on the personas the nightly job has written."""
    tables = open_tables(spark, sf_dir)
    users = segmentation.users_with_personas(tables.users, persona_writeback(spark, sf_dir))
    return funnel.funnel_by_persona(tables.rides, users, tables.membership_events)


def funnel_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The daily feed of a dashboard, written per run and read back."""
    path = scratch_dir(spark, "funnel_feed")
    run = str(DEFAULTS.as_of)
    tables = open_tables(spark, sf_dir)
    storage.write_run(funnel.funnel_daily(tables.rides, tables.membership_events), "run_date", run, path)
    return spark.read.parquet(path).filter(f"run_date = DATE'{run}'")


# Days that the nightly run adds to the stored sketches of all days before.
NIGHTLY_DAYS = 7


def _sketch_runs(spark: SparkSession, name: str, before: DataFrame, nightly: DataFrame) -> DataFrame:
    """Day sketches as two runs have stored them: the backfill and a later run."""
    path = scratch_dir(spark, name)
    cut = DEFAULTS.days_ago(NIGHTLY_DAYS)
    storage.write_run(before, "run_date", str(cut), path)
    storage.write_run(nightly, "run_date", str(DEFAULTS.as_of), path)
    return spark.read.schema(before.schema).parquet(path)


def _split(rows: DataFrame, time_column: str) -> tuple[DataFrame, DataFrame]:
    cut = DEFAULTS.days_ago(NIGHTLY_DAYS)
    return rows.filter(F.col(time_column) < ts(cut)), since(rows, time_column, cut)


def funnel_reach_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct riders of 30 and 90 days from stored day sketches."""
    runs = [sketches.step_sketches(part) for part in _split(open_tables(spark, sf_dir).membership_events, "event_at")]
    return sketches.funnel_reach(_sketch_runs(spark, "step_sketches", *runs))


def time_to_convert_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, cut = open_tables(spark, sf_dir), DEFAULTS.days_ago(NIGHTLY_DAYS)
    days = sketches.conversion_sketches(tables.users, tables.membership_events, tables.rides)
    border = F.lit(str(cut)).cast("date")
    return sketches.conversion_quantiles(
        _sketch_runs(spark, "conversion_sketches", days.filter(F.col("day") < border), days.filter(F.col("day") >= border)))


def _ride_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = [sketches.ride_sketches(part) for part in _split(open_tables(spark, sf_dir).rides, "started_at")]
    return _sketch_runs(spark, "ride_sketches", *runs)


def ride_quantiles_sketched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.ride_quantiles(_ride_sketches(spark, sf_dir))


def ride_quantile_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.ride_quantile_audit(_ride_sketches(spark, sf_dir), open_tables(spark, sf_dir).rides)


def _night(days_before: int) -> Params:
    return replace(DEFAULTS, as_of=DEFAULTS.days_ago(days_before))


def persona_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The users table after two nightly classifications, the second of them run twice. Riders
    whom a night does not classify keep what they had."""
    tables = open_tables(spark, sf_dir)
    users = VersionedTable.create(
        tables.users.select("user_id", "first_ride_at", "persona_segment"), scratch_dir(spark, "users"), "user_id", "source")
    for p in (_night(1), _night(0), _night(0)):
        found = segmentation.score_riders(tables.rides, p).select("user_id", "persona_segment")
        users.upsert(found, str(p.as_of), insert=False)
    return users.read()


def incremental_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored riders from a state that was built three nights ago and advanced night by night."""
    rides = open_tables(spark, sf_dir).rides
    state = incremental.start_profiles(rides, scratch_dir(spark, "profile_state"), _night(3))
    for days_before in (2, 1, 0):
        incremental.advance_profiles(state, rides, _night(days_before))
    return segmentation.score_profiles(incremental.profiles_from_state(state.read()))


def event_delivery_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored events as a client with losses delivers them: some numbers never arrive, some
    events come twice."""
    events = source_table(spark, sf_dir, "events")
    arrived = events.filter("event_id % 131 NOT BETWEEN 50 AND 52 AND event_id % 211 <> 0")
    return delivery.delivery_rate(arrived.union(arrived.filter("event_id % 7 = 0")))


# Days of arrivals that reach the streams together.
DAYS_PER_BATCH = 6


def deliveries(events: DataFrame) -> DataFrame:
    """The stored events in the batches in which they arrive: hours late by their number, every
    fifth once more a day and two hours later."""
    hours = F.expr("CASE event_id % 10 WHEN 7 THEN 20 WHEN 8 THEN 30 WHEN 9 THEN 120 ELSE event_id % 4 END")
    again = events.filter("event_id % 5 = 0").withColumn("hours", hours + 26)
    arrival = F.col("ts") + F.make_dt_interval(F.lit(0), F.col("hours"))
    day_no = F.datediff(F.to_date(arrival), F.lit("2024-01-01").cast("date"))
    return events.withColumn("hours", hours).union(again).withColumn("arrives", F.floor(day_no / DAYS_PER_BATCH).cast("int")).drop("hours")


def _admitted(spark: SparkSession, sf_dir: str) -> tuple[str, DataFrame]:
    """Deliveries through the admission: one micro-batch each, with a stop after every one."""
    root = scratch_dir(spark, "streams/admission")
    arriving = deliveries(source_table(spark, sf_dir, "events"))
    numbers = sorted(r.arrives for r in arriving.select("arrives").distinct().collect())  # one per DAYS_PER_BATCH days
    for number in numbers:
        arriving.filter(F.col("arrives") == number).drop("arrives").write.mode("append").parquet(f"{root}/feed")
        feed = live_events.funnel_events(runtime.stream_files(spark, f"{root}/feed"))
        late.admit(feed, f"{root}/judged", f"{root}/checkpoint")
    return f"{root}/judged", live_events.funnel_events(source_table(spark, sf_dir, "events"))


def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that came more than a day behind the newest one of the batches before."""
    path, like = _admitted(spark, sf_dir)
    behind = late.judged_rows(spark, path, like.schema, late=True)
    return behind.groupBy(runtime.event_day("event_at").alias("event_day"), "event_type").agg(
        F.count("*").alias("late_events"), F.max(F.floor("hours_behind")).cast("long").alias("most_hours_behind"))


def _behind_admission(spark: SparkSession, sf_dir: str, operator: Callable[..., DataFrame], name: str) -> DataFrame:
    """What a stream makes of the admitted rows, read in several micro-batches to the very end."""
    path, like = _admitted(spark, sf_dir)
    lateness = late.downstream_lateness(spark, path)
    last = like.agg(F.max("event_at").alias("event_at")).withColumns({
        "event_type": F.lit(SIGNUP_STARTED), "event_at": F.col("event_at") + F.expr("INTERVAL '62' DAY")})
    closing = like.limit(0).unionByName(last, allowMissingColumns=True)
    rows = lambda: late.admitted_stream(spark, path, like.schema, max_files_per_trigger=12)
    return runtime.replay(spark, lambda end: operator(rows().unionByName(end), lateness=lateness), closing, name)


def stream_funnel_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behind_admission(spark, sf_dir, live_events.stream_funnel, "funnel_admitted")


def stream_sessions_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _behind_admission(spark, sf_dir, live_events.stream_signup_sessions, "sessions_admitted")


def stream_dedup_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = _behind_admission(spark, sf_dir, live_events.stream_event_dedup, "dedup_admitted")
    return once.filter("event_id IS NOT NULL")  # without the closing row


def stream_nudge_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides and nudges as two streams that arrive in stretches of the history, joined, and the
    rides counted by how soon their nudge came. The tables hold no times of display, so a nudge
    is taken to be shown up to 700 seconds after its ride, by its number."""
    tables, root = open_tables(spark, sf_dir), scratch_dir(spark, "streams/latency")
    rides = tables.rides.select("user_id", "ride_id", "user_type", "ended_at")
    delay = F.pmod(F.split("event_id", "-")[2].cast("long") * 13, F.lit(700))
    events = tables.membership_events.select(
        "user_id", "event_type", (F.col("event_at") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), delay.cast("decimal(18,6)"))).alias("event_at"))
    first, last = rides.agg(F.min("ended_at"), F.max("ended_at")).first()
    if first is None:
        first = last = datetime(1970, 1, 1)
    end = last + timedelta(days=30)

    def closing(schema, **values) -> DataFrame:
        return spark.createDataFrame([tuple(values.get(f.name) for f in schema)], schema)

    pairs = None
    for i, (start, stop) in enumerate(_stretches(first, last), 1):
        ended, shown = _between(rides, "ended_at", start, stop), _between(events, "event_at", start, stop)
        if i == STRETCHES:
            ended = ended.union(closing(rides.schema, user_id=-1, ride_id="end", user_type="Casual Member", ended_at=end))
            shown = shown.union(closing(events.schema, user_id=-2, event_type="cta_shown", event_at=end))
        storage.append_rows(ended, f"{root}/rides")
        storage.append_rows(shown, f"{root}/nudges")
        pairs = latency.stream_nudge_latency(runtime.stream_files(spark, f"{root}/rides"), runtime.stream_files(spark, f"{root}/nudges"))
        runtime.run_available(pairs, f"{root}/table", f"{root}/checkpoint")
    firsts = latency.first_nudges(spark.read.schema(pairs.schema).parquet(f"{root}/table").filter("user_id >= 0"))
    return firsts.groupBy("latency_class").agg(F.count("*").alias("rides"), F.max("latency_seconds").alias("longest_seconds"))


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_events.funnel_events(runtime.stream_files(spark, sf_dir, "events*.parquet"))


def _to_the_end(spark: SparkSession, sf_dir: str, operator: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """All stored events through a stream; a closing event a month after the last one lets
    the last days and sessions out and is itself never emitted."""
    stored = live_events.funnel_events(source_table(spark, sf_dir, "events"))
    last = stored.agg(F.max("event_at").alias("event_at")).withColumns({
        "event_type": F.lit(SIGNUP_STARTED), "event_at": F.col("event_at") + F.expr("INTERVAL '31' DAY")})
    closing = stored.limit(0).unionByName(last, allowMissingColumns=True)
    return runtime.replay(spark, lambda end: operator(_event_stream(spark, sf_dir).unionByName(end)), closing, name)


def stream_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_the_end(spark, sf_dir, live_events.stream_funnel, "funnel")


def stream_signup_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _to_the_end(spark, sf_dir, live_events.stream_signup_sessions, "sessions")


def stream_event_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is delivered twice and must come out once."""
    once = _event_stream(spark, sf_dir)
    twice = once.unionByName(_event_stream(spark, sf_dir))
    return runtime.result_of(live_events.stream_event_dedup(twice), "dedup")


# Stretches of the history that reach the nudge stream one after the other.
STRETCHES = 3
NUDGE_LATENESS = "1 hour"


def _stretches(first: datetime, last: datetime, count: int = STRETCHES) -> list[tuple[datetime, datetime]]:
    span = (last - first) / count + timedelta(days=1)
    return [(first + i * span, first + (i + 1) * span) for i in range(count)]


def _between(df: DataFrame, column: str, start: datetime, stop: datetime) -> DataFrame:
    return df.filter((F.col(column) >= ts(start)) & (F.col(column) < ts(stop)))


def stream_nudge_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rides and membership events as two streams that arrive in stretches of the history, each in
    any order, with a stop after every one. State holds the signals of one stretch and of the
    lateness; a closing row lets the last ones out."""
    tables, root = open_tables(spark, sf_dir), scratch_dir(spark, "streams/nudges")
    first, last = tables.rides.agg(F.min("started_at"), F.max("ended_at")).first()
    if first is None:
        first = last = datetime(1970, 1, 1)
    end_us = _micros(last) + 62 * live_nudges.DAY_US
    closing = spark.sql(f"SELECT -1L AS user_id, '' AS ride_id, {end_us}L AS at_us, 0 AS kind, 0L AS cents")
    closing.limit(0).write.parquet(f"{root}/closing")
    # only what ``ride_signals`` reads is copied
    rides = tables.rides.select("user_id", "ride_id", "user_type", "ended_at", "ride_cost_cad")
    events = tables.membership_events.select("user_id", "event_id", "event_type", "event_at")
    shown = None
    for i, (start, stop) in enumerate(_stretches(first, last), 1):
        storage.append_rows(_between(rides, "ended_at", start, stop), f"{root}/rides")
        storage.append_rows(_between(events, "event_at", start, stop), f"{root}/events")
        if i == STRETCHES:
            closing.write.mode("append").parquet(f"{root}/closing")
        signals = live_nudges.ride_signals(
            runtime.stream_files(spark, f"{root}/rides"), runtime.stream_files(spark, f"{root}/events"), dismissed="signup_abandoned"
        ).unionByName(spark.readStream.schema(closing.schema).parquet(f"{root}/closing"))
        shown = live_nudges.stream_nudge_trigger(signals, tables.users, lateness=NUDGE_LATENESS)
        runtime.run_available(shown, f"{root}/table", f"{root}/checkpoint")
    return spark.read.schema(shown.schema).parquet(f"{root}/table")


def _micros(when) -> int:
    return int((when - datetime(1970, 1, 1)).total_seconds()) * 1_000_000 if when else 0


# Queries with their own source or sink.
JOB_QUERIES: dict[str, Query] = {
    "ingest_trips": ingest_trips,
    "persona_writeback": persona_writeback,
    "persona_funnel_after_writeback": persona_funnel_after_writeback,
    "funnel_feed": funnel_feed,
    "funnel_reach_sketched": funnel_reach_sketched,
    "time_to_convert_sketched": time_to_convert_sketched,
    "ride_quantiles_sketched": ride_quantiles_sketched,
    "ride_quantile_audit": ride_quantile_audit,
    "persona_upsert": persona_upsert,
    "incremental_profiles": incremental_profiles,
    "event_delivery_rate": event_delivery_rate,
    "late_events": late_events,
    "stream_funnel_admitted": stream_funnel_admitted,
    "stream_sessions_admitted": stream_sessions_admitted,
    "stream_dedup_admitted": stream_dedup_admitted,
    "stream_nudge_latency": stream_nudge_latency,
    "stream_funnel": stream_funnel,
    "stream_signup_sessions": stream_signup_sessions,
    "stream_event_dedup": stream_event_dedup,
    "stream_nudge_trigger": stream_nudge_trigger,
}


def all_queries() -> dict[str, Query]:
    return {name: on_tables(build) for name, build in TABLE_QUERIES.items()} | JOB_QUERIES
