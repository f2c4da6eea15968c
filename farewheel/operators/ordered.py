"""The sign-up funnel in order, with a time limit per step.

A rider's attempt is a finite automaton: idle, or at a step for so many days, or done. An event of
the next step moves it on, the first step starts or restarts it, a step that takes longer than its
limit drops it. Most riders are folded from their own sorted events. What a part of a history does
to the automaton is a table from state to state, and such tables compose in any grouping: a rider
with very many events is cut into hours, hours compose to days, days to longer blocks, so neither
a task nor a list ever holds more of them than one hour or thirty-two tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from farewheel.functions.blocks import block_of
from farewheel.functions.columns import flag, ratio, rnd
from farewheel.functions.horizon import until_as_of
from farewheel.functions.skew import ROWS_PER_TASK
from farewheel.operators.funnel import STEPS
from farewheel.operators.profiles import is_event
from farewheel.params import DEFAULTS, Params

LIMITS = (30, 30, 30)   # days that may pass after a step until the next one
FANOUT = 32             # blocks of one level that make one of the next
_BEST = 16              # a table entry is next state * _BEST + furthest step on the way


class Automaton:
    """States: 0 idle, then every step but the last with every age in days, then done."""

    def __init__(self, limits: Sequence[int]) -> None:
        self.limits, self.width, self.last = tuple(limits), max(limits) + 1, len(limits) + 1
        self.done = 1 + len(limits) * self.width
        self.identity = [s * _BEST for s in range(self.done + 1)]

    def _at(self, step: int) -> int:
        return self.done if step == self.last else 1 + (step - 1) * self.width

    def event(self, step: int) -> list[int]:
        """Table of one event."""
        table = []
        for state in range(self.done + 1):
            now = 0 if state == 0 else (state - 1) // self.width + 1
            moves = state != self.done and (step == now + 1 or step == now == 1)
            table.append(self._at(step) * _BEST + step if moves else state * _BEST)
        return table

    def then(self, first: Column, second: Column) -> Column:
        """What both parts do, one after the other."""
        def step(x: Column) -> Column:
            y = F.element_at(second, F.floor(x / _BEST).cast("int") + 1)
            return y - y % _BEST + F.greatest(x % _BEST, y % _BEST)

        return F.transform(first, step)

    def wait(self, table: Column, days: Column) -> Column:
        """The table, and then so many days without an event."""
        limits = F.array(*[F.lit(x) for x in self.limits])

        def step(x: Column) -> Column:
            state = F.floor(x / _BEST).cast("int")
            place = F.floor((state - 1) / self.width).cast("int")
            age = (state - 1) % self.width + days
            there = F.when((state == 0) | (state == self.done), state).when(age > F.element_at(limits, place + 1), 0).otherwise(state + days)
            return (there * _BEST + x % _BEST).cast("int")

        return F.transform(table, step)


def _flow(events: DataFrame) -> DataFrame:
    number = None
    for i, step in enumerate(STEPS, 1):
        number = F.when(is_event(step), i) if number is None else number.when(is_event(step), i)
    return events.filter(is_event(*STEPS) & F.col("user_id").isNotNull() & F.col("event_at").isNotNull()).select(
        "user_id", "event_at", number.alias("step"),
        F.datediff(F.to_date("event_at"), F.lit("1970-01-01").cast("date")).alias("day"))


def _folded(flow: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(user_id, furthest): riders whose events fit one row."""
    last = len(limits) + 1
    lists = flow.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_at", "step", "day"))).alias("events"))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("since"), F.lit(0).alias("furthest"))
    allowed = F.array(*[F.lit(x) for x in limits])

    def step(acc: Column, e: Column) -> Column:
        running = (acc["at"] > 0) & (acc["at"] < last)
        expired = running & (e["day"] - acc["since"] > F.element_at(allowed, F.greatest(F.least(acc["at"], F.lit(last - 1)), F.lit(1))))
        now = F.when(expired, 0).otherwise(acc["at"])
        moves = (now < last) & ((e["step"] == now + 1) | ((e["step"] == 1) & (now == 1)))
        return F.struct(
            F.when(moves, e["step"]).otherwise(now).alias("at"), F.when(moves, e["day"]).otherwise(acc["since"]).alias("since"),
            F.when(moves, F.greatest(acc["furthest"], e["step"])).otherwise(acc["furthest"]).alias("furthest"))

    return lists.select("user_id", F.aggregate("events", start, step)["furthest"].alias("furthest"))


def _composed(flow: DataFrame, limits: Sequence[int]) -> DataFrame:
    """(user_id, furthest) by composing tables of hours, days and blocks of days."""
    machine = Automaton(limits)
    literal = lambda table: F.array(*[F.lit(x) for x in table])
    moves = F.array(*[literal(machine.event(i)) for i in range(1, machine.last + 1)])
    hours = flow.groupBy("user_id", "day", block_of(F.col("event_at")).alias("hour")).agg(
        F.sort_array(F.collect_list(F.struct("event_at", "step"))).alias("events"))
    table = F.aggregate("events", literal(machine.identity), lambda acc, e: machine.then(acc, F.element_at(moves, e["step"])))
    parts = hours.select("user_id", "hour", F.col("day").alias("first"), F.col("day").alias("last"), table.alias("table"))

    def together(parts: DataFrame, block: Column | None) -> DataFrame:
        keys = ["user_id"] if block is None else ["user_id", block.alias("block")]
        lists = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("first", "hour", "last", "table"))).alias("p"))
        merge = lambda acc, x: F.struct(
            acc["first"].alias("first"), acc["hour"].alias("hour"), x["last"].alias("last"),
            machine.then(machine.wait(acc["table"], x["first"] - acc["last"]), x["table"]).alias("table"))
        whole = F.aggregate(F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(1))), F.element_at("p", 1), merge)
        return lists.select("user_id", whole.alias("w")).select("user_id", "w.*")

    for days in (1, FANOUT, FANOUT ** 2):
        parts = together(parts, F.floor(F.col("first") / days))
    whole = together(parts, None)
    return whole.select("user_id", (F.element_at("table", 1) % _BEST).cast("int").alias("furthest"))


def furthest_steps(events: DataFrame, limits: Sequence[int] = LIMITS, rows_per_task: int = ROWS_PER_TASK // 100) -> DataFrame:
    """(user_id, furthest): the furthest step that each rider reached in order. Events of one
    instant are taken in the order of the steps. Riders with more than ``rows_per_task`` events
    go by composition, all others by one fold; the result is the same."""
    flow = _flow(events)
    # at most events / rows_per_task riders
    hot = flow.groupBy("user_id").agg(F.count("*").alias("n")).filter(F.col("n") > rows_per_task).select("user_id")
    return _folded(flow.join(hot, "user_id", "left_anti"), limits).union(_composed(flow.join(hot, "user_id", "left_semi"), limits))


@until_as_of
def ordered_signup_funnel(events: DataFrame, p: Params = DEFAULTS, limits: Sequence[int] = LIMITS, rows_per_task: int = ROWS_PER_TASK // 100) -> DataFrame:
    """Riders who reached each step in order and in time, beside those who reached it at all."""
    flags = events.filter(F.col("user_id").isNotNull()).groupBy("user_id").agg(*[F.max(flag(is_event(s))).alias(s) for s in STEPS])
    riders = flags.join(furthest_steps(events, limits, rows_per_task), "user_id", "left")
    count = lambda c: F.coalesce(F.sum(c), F.lit(0))
    totals = riders.agg(
        *[count(flag(F.col("furthest") >= i)).alias(f"in_order_{i}") for i in range(1, len(STEPS) + 1)],
        *[count(s).alias(f"any_{i}") for i, s in enumerate(STEPS, 1)])
    rows = [F.struct(
        F.lit(i).cast("long").alias("step_no"), F.lit(s).alias("step"), F.col(f"in_order_{i}").alias("riders_in_order"), F.col(f"any_{i}").alias("riders_any_order"),
        rnd(ratio(F.col(f"in_order_{i}"), F.col(f"in_order_{max(1, i - 1)}")), 4).alias("share_of_step_before")) for i, s in enumerate(STEPS, 1)]
    return totals.select(F.inline(F.array(*rows)))
