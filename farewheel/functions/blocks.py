"""Running values over one user's history, cut into hour blocks.

A plain window per user sorts the whole history of that user in one task. Here the
rows are windowed per (user, hour), the carry between hours comes from a second
window over one pre-aggregated row per (user, hour), and the two are added. The
result is exact, and a user who owns a third of the table is spread over as many
tasks as there are hours in the history. Where most users are few rows each, blocks cost
more shuffles than they save: ``running_sums_of_users`` is the form for rows that lie by
user, to be used for all but the hot users.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def block_of(when: Column) -> Column:
    """Hours since 1970 as a number, without any time zone."""
    return F.datediff(F.to_date(when), F.lit("1970-01-01").cast("date")) * 24 + F.hour(when)


# A user with more rows than this goes through hour blocks, all others through their own windows.
ROWS_PER_USER = 1_000_000


def running_sums(
    rows: DataFrame,
    user: str,
    when: str,
    order: list[Column],
    totals: dict[str, str],
    attach: DataFrame,
) -> DataFrame:
    """Add ``totals`` = {new column: column to sum} accumulated in ``order``.

    Rows that tie in ``order`` all see the total of the whole tie, like a RANGE frame.
    The columns of ``attach`` (one row per user) are added as well; they travel with the
    block rows, so the detail rows are never joined on the user alone.
    """
    blocked = rows.withColumn("_block", block_of(F.col(when)))
    within = (
        Window.partitionBy(user, "_block").orderBy(*order)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    earlier = (
        Window.partitionBy(user).orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_block = blocked.groupBy(user, "_block").agg(
        *[F.sum(source).alias(f"_b_{name}") for name, source in totals.items()]
    )
    carry = per_block.select(
        user, "_block",
        *[F.coalesce(F.sum(f"_b_{name}").over(earlier), F.lit(0)).alias(f"_c_{name}") for name in totals],
    ).join(attach, user, "left")
    out = blocked.join(carry, [user, "_block"])
    for name, source in totals.items():
        out = out.withColumn(name, F.sum(source).over(within) + F.col(f"_c_{name}"))
    return out.drop("_block", *[f"_c_{name}" for name in totals])


def running_sums_of_users(
    rows: DataFrame,
    user: str,
    when: str,
    order: list[Column],
    totals: dict[str, str],
    attach: DataFrame,
) -> DataFrame:
    """What ``running_sums`` gives, for rows that are dealt by ``user`` already: the carry is a
    window over the same rows, so they are not shuffled again. A user's rows meet in one task."""
    blocked = rows.withColumn("_block", block_of(F.col(when))).filter(F.col(user).isNotNull() & F.col("_block").isNotNull())
    # one sort serves both windows
    so_far = Window.partitionBy(user).orderBy("_block", *order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(user).orderBy("_block").rangeBetween(Window.unboundedPreceding, -1)
    out = blocked.select("*", *[F.sum(source).over(so_far).alias(f"_r_{name}") for name, source in totals.items()]).select(
        "*", *[F.coalesce(F.sum(source).over(earlier), F.lit(0)).alias(f"_c_{name}") for name, source in totals.items()])
    # as in running_sums, a user whom ``attach`` holds several times has the rows of the hour as often
    times = attach.withColumn("_times", F.count(F.lit(1)).over(Window.partitionBy(user)))
    out = out.join(times, user, "left")
    for name in totals:
        inside = F.col(f"_r_{name}") - F.col(f"_c_{name}")
        out = out.withColumn(name, F.col(f"_c_{name}") + inside * F.coalesce("_times", F.lit(1)))
    return out.drop("_block", "_times", *[f"_{part}_{name}" for name in totals for part in "rc"])


def previous_and_running_max(
    rows: DataFrame,
    user: str,
    when: str,
    order: list[str],
    previous: str,
    running: dict[str, str],
) -> DataFrame:
    """Add the previous row's ``when`` as ``previous`` and running maxima.

    ``running`` = {new column: column}, the maximum over all rows up to this one.
    ``order`` starts with ``when`` and should make rows unique.
    """
    blocked = rows.withColumn("_block", block_of(F.col(when)))
    ordered = Window.partitionBy(user, "_block").orderBy(*order)
    within = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = (
        Window.partitionBy(user).orderBy("_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    per_block = blocked.groupBy(user, "_block").agg(
        F.max(when).alias("_last"),
        *[F.max(source).alias(f"_b_{name}") for name, source in running.items()],
    )
    carry = per_block.select(
        user, "_block",
        F.max("_last").over(earlier).alias("_c_last"),
        *[F.max(f"_b_{name}").over(earlier).alias(f"_c_{name}") for name in running],
    )
    out = blocked.join(carry, [user, "_block"]).withColumn(
        previous, F.coalesce(F.lag(when).over(ordered), F.col("_c_last"))
    )
    for name, source in running.items():
        out = out.withColumn(name, F.greatest(F.max(source).over(within), F.col(f"_c_{name}")))
    return out.drop("_block", "_c_last", *[f"_c_{name}" for name in running])
