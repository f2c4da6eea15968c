"""Nudge decisions at the end of each casual ride."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from farewheel.functions.columns import cents, ratio, rnd
from farewheel.params import CASUAL, DEFAULTS, Params, SIGNUP_COMPLETED

# executors get this module with the processor and need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DAY_US = 86_400_000_000
RIDE, DISMISSED, CONVERTED = 0, 1, 2

# Riders share a state key by the hash of their id, since what a key costs per micro-batch (calls to
# the state server, pandas tables) is hundreds of times what a signal costs. A checkpoint is tied to
# the number it was started with.
GROUPS = 2048

# Kept as packed Arrow tables of one group. Signals that wait for the watermark:
SIGNALS = pa.schema([
    ("user_id", pa.int64()), ("at_us", pa.int64()), ("kind", pa.int32()), ("ride_id", pa.string()), ("cents", pa.int64())])
# riders who may still be shown a nudge, with an entry per day of the window that has rides,
OPEN = pa.schema([
    ("user_id", pa.int64()), ("impressions", pa.int32()), ("dismissals", pa.int32()), ("snooze_until", pa.int64()), ("member", pa.bool_()),
    ("days", pa.list_(pa.int32())), ("rides", pa.list_(pa.int64())), ("cents", pa.list_(pa.int64())), ("last_day", pa.int32())])
# and riders who are suppressed for good.
CLOSED = pa.schema([("user_id", pa.int64()), ("impressions", pa.int32()), ("dismissals", pa.int32()), ("member", pa.bool_())])
WAITING = "signals binary"
RIDERS = "open binary, closed binary, timer_ms bigint"
OUTPUT = "user_id bigint, ride_id string, at_us bigint, rides_30d bigint, spend_cents bigint, impression int"


@dataclass(frozen=True)
class NudgeRules:
    min_rides: int = 2
    impression_cap: int = 3
    dismissal_cap: int = 3
    snooze_days: int = 7
    window_days: int = 30


def ride_signals(rides: DataFrame, events: DataFrame | None, dismissed: str) -> DataFrame:
    """Ride ends and the events that suppress nudges, as one narrow stream.

    ``rides`` rows may carry the event of the same row in ``event_type``; with a
    separate event stream pass it as ``events``.
    """
    ride = F.when(F.col("user_type") == CASUAL, F.struct(
        F.lit(RIDE).alias("kind"), F.coalesce(cents(F.col("ride_cost_cad")), F.lit(0).cast("long")).alias("cents")))

    def event(kind: int, name: str):
        return F.when(F.col("event_type") == name, F.struct(F.lit(kind).alias("kind"), F.lit(0).cast("long").alias("cents")))

    control = [event(DISMISSED, dismissed), event(CONVERTED, SIGNUP_COMPLETED)]
    at_us = (F.datediff(F.to_date("at"), F.lit("1970-01-01").cast("date")).cast("long") * 86400
             + F.hour("at") * 3600 + F.minute("at") * 60).cast("long") * 1_000_000 \
        + (F.extract(F.lit("SECOND"), F.col("at")) * 1_000_000).cast("long")

    def flat(df: DataFrame, parts: list) -> DataFrame:
        return df.select(
            "user_id", "ride_id", at_us.alias("at_us"), F.explode(F.array_compact(F.array(*parts))).alias("s")
        ).select("user_id", "ride_id", "at_us", "s.kind", "s.cents").filter("user_id IS NOT NULL AND at_us IS NOT NULL")

    ends = rides.withColumn("at", F.col("ended_at"))
    if events is None:
        return flat(ends, [ride, *control])
    marks = events.withColumns({"at": F.col("event_at"), "ride_id": F.col("event_id")})
    return flat(ends, [ride]).unionByName(flat(marks, control))


def pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table.combine_chunks())
    return sink.getvalue().to_pybytes()


def unpack(entries, schema: pa.Schema) -> pa.Table:
    return pa.concat_tables([schema.empty_table(), *(pa.ipc.open_stream(pa.py_buffer(x)).read_all() for x in entries if x is not None)])


def by_rider(signals: pa.Table) -> Iterator[tuple[int, list]]:
    """Each rider's signals as tuples in order of time, ties by kind, ride and cost."""
    signals = signals.sort_by([(name, "ascending") for name in ("user_id", "at_us", "kind", "ride_id", "cents")])
    riders, starts = np.unique(signals["user_id"].to_numpy(), return_index=True)
    columns = [signals[name].to_numpy() for name in ("at_us", "kind", "ride_id", "cents")]
    for rider, start, stop in zip(riders.tolist(), starts.tolist(), [*starts[1:].tolist(), signals.num_rows]):
        yield rider, list(zip(*(column[start:stop].tolist() for column in columns)))


def of_riders(table: pa.Table, riders: pa.Array) -> pa.ChunkedArray:
    return pc.is_in(table["user_id"], value_set=riders)


class NudgeProcessor(StatefulProcessor):
    """Signals wait until the watermark has passed them and are then taken in order of
    time, so the decisions do not depend on how the input was cut into micro-batches.

    State per group of riders: the waiting signals, one entry per micro-batch and some forty
    bytes a signal before compression; and of each rider impressions, dismissals, snooze,
    membership, rides and spend per day of the window (one entry per day, however much one
    rides). The window is evicted when no ride has renewed it; the counts that suppress a rider
    for good stay, and such riders keep nothing else. A group has one timer, for the first of
    its riders for whom something is due.
    """

    def __init__(self, rules: NudgeRules = NudgeRules()) -> None:
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.riders = handle.getValueState("riders", RIDERS)
        self.waiting = handle.getListState("waiting", WAITING)

    def _suppressed(self, saved) -> bool:
        return bool(saved) and (
            saved[3] or saved[0] >= self.rules.impression_cap or saved[1] >= self.rules.dismissal_cap)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        opened, closed, timer = self.riders.get() or (None, None, None)
        gone = unpack([closed], CLOSED)["user_id"].to_numpy()
        earliest = None
        for part in rows:
            signals = pa.table([pa.array(part[f.name].to_numpy(), f.type, from_pandas=True) for f in SIGNALS], schema=SIGNALS)
            # nothing that a rider who is suppressed for good does later can matter
            signals = signals.filter(~np.isin(signals["user_id"].to_numpy(), gone))
            if signals.num_rows:
                self.waiting.appendValue((pack(signals),))
                first = pc.min(signals["at_us"]).as_py()
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None and (timer is None or earliest // 1000 + 1 < timer):
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(earliest // 1000 + 1)
            self.riders.update((opened, closed, earliest // 1000 + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        opened, closed, _ = self.riders.get()
        riders, signals = unpack([opened], OPEN), unpack((x[0] for x in self.waiting.get()), SIGNALS)
        passed = pc.less_equal(signals["at_us"], reached)
        due, later = signals.filter(passed), signals.filter(pc.invert(passed))
        # riders for whom nothing is due and whose window has not passed stay as they are
        ended = pc.fill_null(pc.less(riders["last_day"], reached // DAY_US - self.rules.window_days), False)
        touched = pc.or_(of_riders(riders, pc.unique(due["user_id"])), ended)
        saved = {row[0]: row[1:-1] for row in zip(*(c.to_pylist() for c in riders.filter(touched).columns))}
        shown, now, kept, gone = [], {}, [], []
        for rider, taken in by_rider(due):
            nudges, now[rider] = self._decide(rider, taken, saved.pop(rider, None))
            shown += nudges
        now |= {rider: self._decide(rider, [], row)[1] for rider, row in saved.items()}
        for rider, row in now.items():
            if self._suppressed(row):
                gone.append((rider, row[0], row[1], row[3]))
            elif left := self._left(row, reached):
                kept.append((rider, *left))
        riders = pa.concat_tables([riders.filter(pc.invert(touched)), self._table(kept, OPEN)])
        if gone:
            more = self._table(gone, CLOSED)
            later = later.filter(pc.invert(of_riders(later, pc.unique(more["user_id"]))))
            closed = pack(pa.concat_tables([unpack([closed], CLOSED), more]))
        # looked at again when a signal is due or a window has moved past its last ride
        first, day = pc.min(later["at_us"]).as_py(), pc.min(riders["last_day"]).as_py()
        times = [] if first is None else [first // 1000 + 1]
        times += [] if day is None else [(day + self.rules.window_days + 1) * DAY_US // 1000]
        timer = min(times, default=None)
        if timer is not None:
            self.handle.registerTimer(timer)
        if later.num_rows:
            self.waiting.put([(pack(later),)])
        else:
            self.waiting.clear()
        if riders.num_rows or closed is not None or timer is not None:
            self.riders.update((pack(riders) if riders.num_rows else None, closed, timer))
        else:
            self.riders.clear()
        if shown:
            yield pd.DataFrame(shown, columns=["user_id", "ride_id", "at_us", "rides_30d", "spend_cents", "impression"])

    @staticmethod
    def _table(rows: list, schema: pa.Schema) -> pa.Table:
        columns = zip(*rows) if rows else [()] * len(schema)
        return pa.table([pa.array(column, field.type) for column, field in zip(columns, schema)], schema=schema)

    def _decide(self, rider: int, due: list, saved) -> tuple[list, tuple]:
        rules = self.rules
        impressions, dismissals, snooze, member = saved[:4] if saved else (0, 0, 0, False)
        days = {d: (n, c) for d, n, c in zip(*saved[4:])} if saved else {}
        shown = []
        for at, kind, ride, cost in due:
            if member or dismissals >= rules.dismissal_cap or impressions >= rules.impression_cap:
                break
            if kind == DISMISSED:
                dismissals, snooze = dismissals + 1, at + rules.snooze_days * DAY_US
                continue
            if kind == CONVERTED:
                member = True
                continue
            today = at // DAY_US
            n, c = days.get(today, (0, 0))
            days[today] = (n + 1, c + cost)
            if len(days) > rules.window_days or min(days) <= today - rules.window_days:
                days = {d: v for d, v in days.items() if d > today - rules.window_days}
            recent = sum(v[0] for v in days.values())
            if at < snooze or recent < rules.min_rides:
                continue
            impressions += 1
            shown.append((rider, ride, at, recent, sum(v[1] for v in days.values()), impressions))
        return shown, (impressions, dismissals, snooze, member, days)

    def _left(self, now: tuple, reached: int) -> tuple | None:
        """What is kept of a rider who may still be shown a nudge."""
        impressions, dismissals, snooze, member, days = now
        gone = reached // DAY_US - self.rules.window_days
        kept = sorted(d for d in days if d > gone)
        if not (kept or impressions or dismissals):
            return None
        return (impressions, dismissals, snooze, member, kept, [days[d][0] for d in kept], [days[d][1] for d in kept],
                kept[-1] if kept else None)

    def close(self) -> None:
        pass


def stream_nudge_trigger(
    signals: DataFrame, users: DataFrame, p: Params = DEFAULTS, rules: NudgeRules = NudgeRules(), lateness: str = "10 seconds",
    groups: int = GROUPS,
) -> DataFrame:
    """Nudges to show, at most ``impression_cap`` per rider, with what they say: spend and
    rides of the window, the membership's price per month, rides to break even, persona.

    A nudge comes out when the watermark, ``lateness`` behind the newest signal, has passed
    the end of its ride; signals that are later than that are dropped. Riders are decided one by
    one, ``groups`` is only into how many state keys they are dealt.
    """
    at = F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.col("at_us") / F.lit(1_000_000)).cast("decimal(18,6)")
    )
    shown = (
        signals.withColumn("at", F.timestamp_micros("at_us")).withWatermark("at", lateness)
        .withColumn("rider_group", F.pmod(F.xxhash64("user_id"), F.lit(groups)).cast("int")).groupBy("rider_group")
        .transformWithStateInPandas(
            statefulProcessor=NudgeProcessor(rules), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    )
    spend, fee = F.col("spend_cents") / 100.0, p.pricing.annual_fee
    return shown.join(users.select("user_id", "persona_segment"), "user_id", "left").select(
        "user_id", "ride_id", at.alias("nudge_at"), "rides_30d", spend.alias("spend_30d"),
        F.col("impression").cast("long").alias("impression"),
        rnd(F.lit(fee / 12), 2).alias("membership_per_month"),
        F.when(F.col("spend_cents") > 0, F.greatest(F.ceil(ratio(F.lit(fee) - spend, ratio(spend, F.col("rides_30d")))), F.lit(0)))
        .alias("rides_to_breakeven"),
        "persona_segment",
    )
