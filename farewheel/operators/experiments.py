"""Experiment sizing and read-out in closed form."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from farewheel.functions.columns import ratio, rnd, since
from farewheel.functions.horizon import until_as_of
from farewheel.operators.funnel import channel_exposure
from farewheel.operators.profiles import event_totals, zero
from farewheel.params import CASUAL, DEFAULTS, Params


def z_quantile(probability: float) -> float:
    return NormalDist().inv_cdf(probability)


def sample_size(p1: Column, p2: Column, alpha: float, power: Column) -> Column:
    """Riders per arm for a two-sided test of two proportions; ``power`` is the normal
    quantile of the wanted power."""
    z_alpha = z_quantile(1 - alpha / 2)
    mean = (p1 + p2) / 2.0
    root = (
        F.sqrt(mean * 2.0 * (1.0 - mean)) * z_alpha
        + power * F.sqrt(p1 * (1.0 - p1) + p2 * (1.0 - p2))
    )
    gap = p2 - p1
    return F.ceil(ratio(root * root, gap * gap))


@until_as_of
def experiment_sizing(
    rides: DataFrame, users: DataFrame, events: DataFrame, p: Params = DEFAULTS,
    lookback: int = 90, alpha: float = 0.05, powers: tuple[float, ...] = (0.80, 0.90),
    first_lift: int = 10, last_lift: int = 60, lift_step: int = 5,
) -> DataFrame:
    """Sample size per arm and days to reach it, per persona and relative lift, from the
    conversion rate and exposure observed in the window."""
    start = p.days_ago(lookback)
    riders = (
        since(rides, "started_at", start).filter(F.col("user_type") == CASUAL).select("user_id").distinct()
        .join(users.filter(F.col("persona_segment").isNotNull()).select("user_id", "persona_segment"), "user_id")
        .join(event_totals(since(events, "event_at", start)), "user_id", "left")
    )
    measured = riders.groupBy("persona_segment").agg(
        ratio(F.sum(zero("completed")), F.count(F.lit(1))).alias("p1"),
        (F.sum(zero("shown")) / F.lit(float(lookback))).alias("daily"),
    )
    power_rows = F.array(*[
        F.struct(F.lit(q).alias("power"), F.lit(z_quantile(q)).alias("z")) for q in powers
    ])
    grid = measured.select(
        "*", F.explode(F.sequence(F.lit(first_lift), F.lit(last_lift), F.lit(lift_step))).alias("lift")
    ).select("*", F.explode(power_rows).alias("pw"))
    p2 = F.col("p1") * (100 + F.col("lift")) / 100.0
    possible = (F.col("p1") > 0) & (p2 < 1)
    n = F.when(possible, sample_size(F.col("p1"), F.when(possible, p2), alpha, F.col("pw.z")))
    return grid.select(
        "persona_segment",
        F.col("lift").cast("long").alias("lift_pct"),
        F.col("pw.power").alias("power"),
        rnd(F.col("p1"), 6).alias("baseline_rate"),
        rnd(p2, 6).alias("treatment_rate"),
        n.alias("n_per_arm"),
        F.ceil(ratio(n, F.col("daily") / 2.0)).alias("days_to_finish"),
    ).orderBy("persona_segment", "lift_pct", "power")


@until_as_of
def experiment_readout(
    events: DataFrame, p: Params = DEFAULTS, window_days: int = 28, alpha: float = 0.05,
    treatment: str = "treatment", control: str = "control",
) -> DataFrame:
    """Treatment against control per channel: rates, lift, z and significance."""
    def total(value: str, variant: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("nudge_variant") == variant, F.col(value))), F.lit(0))

    cells = channel_exposure(events, p, window_days).groupBy("source_channel", "nudge_variant").agg(
        F.count(F.lit(1)).alias("n"), F.sum("converted").alias("x")
    )
    wide = cells.groupBy("source_channel").agg(
        total("n", control).alias("control_users"), total("x", control).alias("control_conversions"),
        total("n", treatment).alias("treatment_users"), total("x", treatment).alias("treatment_conversions"),
    )
    nc, xc = F.col("control_users"), F.col("control_conversions")
    nt, xt = F.col("treatment_users"), F.col("treatment_conversions")
    pc, pt, pooled = ratio(xc, nc), ratio(xt, nt), ratio(xc + xt, nc + nt)
    error = F.sqrt(pooled * (1.0 - pooled) * (ratio(F.lit(1.0), nt) + ratio(F.lit(1.0), nc)))
    z = ratio(pt - pc, error)
    return wide.select(
        "*",
        rnd(pc, 4).alias("control_rate"), rnd(pt, 4).alias("treatment_rate"),
        rnd(ratio(pt - pc, pc), 4).alias("relative_lift"),
        rnd(z, 4).alias("z_statistic"),
        (F.abs(z) > z_quantile(1 - alpha / 2)).alias("significant"),
    ).orderBy("source_channel")
