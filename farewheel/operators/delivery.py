"""How many events were delivered, from the gaps in their numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from farewheel.functions.columns import ratio, rnd

# Event numbers of one block; blocks meet by their edges alone.
BLOCK = 1 << 16


def islands(numbers: DataFrame, number: str, when: str, block: int = BLOCK) -> DataFrame:
    """(first, last, from, to, lost_before, before): the runs of consecutive numbers. Repeated
    numbers count once, at their first time. ``lost_before`` numbers are missing between a run
    and the one before it, which ended at ``before``; a first run has no gap before it.

    Numbers are compared with their neighbours inside blocks of ``block`` numbers; what crosses a
    border comes from one edge row per block. Runs that a border cuts are joined again by their
    number of gaps before them, block by block, so no window sees all rows.
    """
    seen = numbers.filter(F.col(number).isNotNull()).groupBy(F.col(number).alias("no")).agg(F.min(when).alias("at"))
    seen = seen.withColumn("block", F.floor(F.col("no") / F.lit(block)).cast("long"))
    edges = seen.groupBy("block").agg(F.max(F.struct("no", "at")).alias("last"))
    by_block = Window.orderBy("block")  # one row per block
    carried = edges.select("block", F.lag("last").over(by_block).alias("carried"))
    inside = Window.partitionBy("block").orderBy("no")
    previous = F.coalesce(F.lag(F.struct("no", "at")).over(inside), F.col("carried"))
    rows = seen.join(carried, "block").withColumn("previous", previous)
    opens = F.col("previous").isNull() | (F.col("previous.no") < F.col("no") - 1)
    rows = rows.withColumn("opens", opens.cast("int"))
    within = F.sum("opens").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    opened = rows.groupBy("block").agg(F.sum("opens").alias("opened")).select(
        "block", F.coalesce(F.sum("opened").over(by_block.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("opened_before"))
    runs = rows.withColumn("in_block", within).join(opened, "block").withColumn("run", F.col("opened_before") + F.col("in_block"))
    lost = F.when(F.col("opens") == 1, F.coalesce(F.col("no") - F.col("previous.no") - 1, F.lit(0)))
    return runs.groupBy("run").agg(
        F.min("no").alias("first"), F.max("no").alias("last"), F.min("at").alias("from"), F.max("at").alias("to"),
        F.max(lost).alias("lost_before"), F.max(F.when(F.col("opens") == 1, F.col("previous.at"))).alias("before"),
    ).drop("run")


def delivery_rate(events: DataFrame, number: str = "event_id", when: str = "ts", target: float = 0.99, block: int = BLOCK) -> DataFrame:
    """Per day: events that arrived, deliveries that repeated one, numbers that never arrived,
    the longest gap, and whether the delivery rate meets ``target``. A lost event counts on the
    day of the last one before it; an event on the day of its first delivery."""
    day_of = lambda c: F.to_date(c)
    arrived = events.filter(F.col(number).isNotNull()).groupBy(number).agg(F.min(when).alias("at"), F.count("*").alias("times")).groupBy(
        day_of("at").alias("event_day")).agg(F.count("*").alias("events"), F.sum(F.col("times") - 1).alias("repeats"))
    gaps = islands(events, number, when, block).filter("lost_before > 0").groupBy(day_of("before").alias("event_day")).agg(
        F.sum("lost_before").alias("lost"), F.count("*").alias("gaps"), F.max("lost_before").alias("longest_gap"))
    out = arrived.join(gaps, "event_day", "left").fillna(0, ["lost", "gaps", "longest_gap"])
    rate = ratio(F.col("events"), F.col("events") + F.col("lost"))
    return out.select("event_day", "events", "repeats", "lost", "gaps", "longest_gap", rnd(rate, 6).alias("delivery_rate"), (rate >= target).alias("meets_target"))
