"""Mixing sources to target weights by weighted fair queueing.

Every document joins its source's queue once per repetition, in shuffled order. Its virtual
finish time is the number of words its source has queued up to and with it, divided by the
source's target. All queues advance at the same virtual speed, so the documents sorted by
finish time interleave the sources in proportion to their targets at every point; the mix is
the longest beginning of that order within the total budget.

Running sums are taken in two levels (inside bins of the shuffled or sorted order, then over
the bins), so a source that holds a third of all rows, or one finish time shared by many, is
spread over many tasks. Only per-source rows meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.llm.staging import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)      # by code point order of the sources, repeating
BUDGET = 1.5             # of all words
REPEATS = 2              # a document is taken so often at most
ROWS_PER_BIN = 50_000    # queue entries whose running sum is one task's work


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, budget: float = BUDGET, repeats: int = REPEATS, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, size) rows.

    Targets share ``budget`` times all words by weight; what exceeds ``repeats`` times a
    source's size is shared again by weight among the others until none exceeds it. Only a
    fixed number of sums per round reaches the driver.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    sources = staged(
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("double"))
        .withColumn("most", repeats * F.col("source_size").cast("double")), "sources")
    wanted = budget * float(sources.agg(F.sum("source_size")).first()[0] or 0)
    fixed, open_weight = 0.0, float(sources.agg(F.sum("weight")).first()[0] or 0)
    while open_weight:
        # sources that their share would overfill keep their most
        full = F.col("weight") * F.lit(wanted - fixed) / F.lit(open_weight) >= F.col("most")
        now = sources.agg(
            F.sum(F.when(full, F.col("most")).otherwise(0.0)), F.sum(F.when(~full, F.col("weight")).otherwise(0.0))).first()
        if (now[0], now[1]) == (fixed, open_weight):
            break
        fixed, open_weight = now
    share = F.col("weight") * F.lit(wanted - fixed) / F.lit(open_weight or 1.0)
    target = F.least(F.col("most"), share) if open_weight else F.col("most")
    return sources.select("source", "source_size", target.alias("target"))


def _running(rows: DataFrame, group: list[str], bin_: str, order: list[str], value: str, name: str) -> DataFrame:
    """Sum of ``value`` up to and with each row, by ``order`` within ``group``; ``bin_`` rises
    with the order, so that sums inside bins and sums over bins add up."""
    inside = Window.partitionBy(*group, bin_).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    over = Window.partitionBy(*group).orderBy(bin_).rowsBetween(Window.unboundedPreceding, -1)
    bins = rows.groupBy(*group, bin_).agg(F.sum(value).alias("_sum"))
    before = bins.select(*[F.col(g).alias(f"_{g}") for g in group], F.col(bin_).alias("_bin"), F.coalesce(F.sum("_sum").over(over), F.lit(0)).alias("_before"))
    same = F.col(bin_) == F.col("_bin")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"_{g}"))
    return (
        rows.join(before, same).withColumn(name, F.col("_before") + F.sum(value).over(inside))
        .drop("_bin", "_before", *[f"_{g}" for g in group])
    )


def fair_mix(sizes: DataFrame, seed: str = "mix", budget: float = BUDGET, repeats: int = REPEATS) -> DataFrame:
    """(doc_id, source, size) rows with source_size, target and the words taken.

    The shuffled order is by MD5 of seed, repetition and doc_id, so reruns agree. A second
    repetition of a source starts when its first is through. Equal finish times go by hash,
    repetition and doc_id. Documents of size 0 and rows of sources without words take nothing;
    rows without doc_id are queued under an empty id. Rows that share doc_id, source and size
    are equal for the order: which of them is first does not matter, as each gets the same.
    """
    rows = staged(sizes.select("doc_id", "source", F.coalesce("size", F.lit(0)).cast("long").alias("size")), "sizes")
    targets = staged(source_targets(rows, budget, repeats), "targets")
    n = rows.count()
    bins = max(1, -(-n * repeats // ROWS_PER_BIN))
    wanted = float(targets.agg(F.sum("target")).first()[0] or 0)
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    queue = (
        rows.filter("size > 0").select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("round"))
        .withColumn("ticket", F.md5(F.concat_ws(":", F.lit(seed), F.col("round").cast("string"), number)))
        # the first digits of the hash cut the shuffled order into even bins, repetition by repetition
        .withColumn("slot", F.col("round") * bins + F.floor(F.conv(F.substring("ticket", 1, 8), 16, 10).cast("double") / 2**32 * bins).cast("int"))
    )
    queued = _running(queue, ["source"], "slot", ["ticket", "doc_id", "size"], "size", "queued")
    finish = queued.join(
        F.broadcast(targets) if targets.count() <= 10_000 else targets,
        queued["source"].eqNullSafe(targets["source"]),
    ).select(queued["*"], (F.col("queued") / F.col("target")).alias("finish"))
    # finish times are even by construction: equal ranges of them hold equal work
    ranked = finish.withColumn("range", F.floor(F.col("finish") * bins).cast("long"))
    taken = (
        _running(ranked, [], "range", ["finish", "ticket", "round", "doc_id", "source", "size"], "size", "total")
        .filter(F.col("total") <= F.lit(wanted))
        .groupBy("doc_id", "source", "size").agg(F.sum("size").alias("_words"))
    )
    copies = rows.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    out = copies.alias("r").join(taken.alias("t"), [F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}")) for c in ("doc_id", "source", "size")], "left").select(
        "r.*", F.coalesce("_words", F.lit(0)).alias("_words"))
    # repeated rows share what they took, in whole takes: the first ones get one more
    out = out.select("*", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).withColumn(
        "taken", F.when(F.col("size") > 0, F.col("size") * (
            F.floor(F.col("_words") / F.col("size") / F.col("copies"))
            + (F.col("copy") <= (F.col("_words") / F.col("size")) % F.col("copies")).cast("long"))).otherwise(0).cast("long"))
    return out.join(targets, out["source"].eqNullSafe(targets["source"])).select(
        "doc_id", out["source"], "size", "source_size", "target", "taken")


def mix_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """``fair_mix`` over word counts of whole texts."""
    return fair_mix(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), seed)
