"""The prefix trie of conversations, rolled up by centroid decomposition.

Turns are numbered in range-sorted rows and their texts leave the job at once: a turn travels as
a 128-bit digest of role and text and the text's length. A prefix is named by 128 bits that are
the exclusive-or of its turns' digests at their depths, so prefixes of one conversation follow
from running values over blocks of turns with a carry, and no task needs a whole conversation.
Nodes, their members and the members that end there are partial aggregations.

Totals of subtrees come from a centroid decomposition of the forest of parent edges. A component
is a connected piece of it, with its top. Its centroid is the deepest node whose part of the
component weighs more than half of it, where a node weighs as many rows as conversations share
it: the weight of a whole subtree then is known from the members' lengths alone. The totals of
the centroid's part are added to all nodes on the path from it to the top; the centroid is done,
and what is left falls into the components of its children and the rest around the top, none
heavier than half. Every path is as long as its component at most, so the work is in the order of
n log n however deep or wide the forest is.

Components of many nodes are split so in tables, all of a level together: whether a node lies
below a centroid is read from the conversation that represents it. Components that fit a task
are packed into tasks of bounded size and split there in arrays, level by level.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.functions.skew import join_hot_keys
from farewheel.llm.ordering import in_ranges
from farewheel.llm.shipping import on_workers
from farewheel.llm.staging import staged

FAMILY = 100          # ids of a family, whose first one lends its first turns
LENT = 6              # fewer turns than this are lent
RUN = 1024            # turns of a block of running values
TASK_NODES = 20_000   # nodes of a component that one task splits, and about so many of a task
ID_BLOCK = 4096       # ids that are put together before they are digested
ROOT = "0" * 32


def _lent(conv: Column, lent: int) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % lent


def _turns(conversations: DataFrame) -> DataFrame:
    """conv, turn, digest and length of every turn; rows without conversation are left out."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    return conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"),
        F.length(text).cast("long").alias("length"))


def rebuilt_turns(conversations: DataFrame, family: int = FAMILY, lent: int = LENT) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv, depth from 1, digest, length) and (conv, turns).

    Turns of equal number are taken in the order of their digests.
    """
    turns = in_ranges(_turns(conversations), [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest")], "turns")
    # one row per conversation and range: where it begins, and how many turns stand before
    pieces = turns.groupBy("conv", "range_id").agg(F.min("at").alias("from"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    pieces = staged(pieces.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0))), "pieces")
    own = pieces.groupBy("conv").agg(F.sum("n").alias("own"))
    lender = own.select(F.col("conv").alias("lender"), F.col("own").alias("lender_turns"))
    made = own.withColumn("lender", F.col("conv") - F.col("conv") % family).withColumn("head", _lent(F.col("conv"), lent)).join(
        lender, "lender", "left").select(
        "conv", "own", "lender", "head", F.least("head", F.coalesce("lender_turns", F.lit(0))).alias("taken"))
    made = staged(made, "rebuilt")
    places = pieces.join(made.select("conv", "head", "taken"), "conv")
    # a conversation meets its row once per range that holds a part of it
    counted = turns.join(places, ["conv", "range_id"]).withColumn("place", F.col("earlier") + F.col("at") - F.col("from") + 1)
    tails = counted.filter("place > head").select("conv", (F.col("taken") + F.col("place") - F.col("head")).alias("depth"), "digest", "length")
    first = counted.filter((F.col("place") < lent) & (F.col("conv") % family == 0)).select(F.col("conv").alias("lender"), "place", "digest", "length")
    heads = made.filter("taken > 0").select("conv", "lender", "taken").join(first, "lender").filter("place <= taken").select(
        "conv", F.col("place").alias("depth"), "digest", "length")
    lengths = made.select("conv", (F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0))).alias("turns"))
    return heads.union(tails), lengths


def _name(*halves: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in halves]))


def prefix_rows(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv, depth, node, above, length, turns): one row per prefix of every conversation, the
    empty one included. ``above`` names the prefix that is one turn shorter."""
    marked = rows.withColumns({
        "x": F.xxhash64("digest", "depth"), "y": F.xxhash64("depth", F.lit("second"), "digest"),
        "run": F.floor((F.col("depth") - 1) / RUN)})
    sums = marked.groupBy("conv", "run").agg(F.bit_xor("x").alias("x_run"), F.bit_xor("y").alias("y_run"))
    earlier = Window.partitionBy("conv").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    carry = sums.select("conv", "run", *[F.coalesce(F.bit_xor(f"{c}_run").over(earlier), zero).alias(f"{c}_before") for c in "xy"])
    # the conversation's length travels with the blocks, so no join meets all turns of one id
    carry = carry.join(lengths, "conv")
    within = Window.partitionBy("conv", "run").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = [F.bit_xor(c).over(within).bitwiseXOR(F.col(f"{c}_before")) for c in "xy"]
    named = marked.join(carry, ["conv", "run"]).select("conv", "depth", "length", "turns", "x", "y", here[0].alias("hx"), here[1].alias("hy"))
    above = F.when(F.col("depth") == 1, F.lit(ROOT)).otherwise(_name(F.col("hx").bitwiseXOR(F.col("x")), F.col("hy").bitwiseXOR(F.col("y"))))
    below_root = named.select("conv", "depth", _name(F.col("hx"), F.col("hy")).alias("node"), above.alias("above"), "length", "turns")
    root = lengths.select(
        "conv", zero.alias("depth"), F.lit(ROOT).alias("node"), F.lit(None).cast("string").alias("above"), zero.alias("length"), "turns")
    return root.union(below_root)


def _end_digests(prefixes: DataFrame) -> DataFrame:
    """(node, ends_sha256) of nodes where conversations end. Ids are joined block by block, and a
    node's blocks then pass through one digest in order, one block at a time."""
    ends = prefixes.filter("depth = turns").select("node", "conv")
    blocks = ends.groupBy("node", F.expr(f"conv div {ID_BLOCK}").alias("block")).agg(
        F.array_join(F.sort_array(F.collect_list("conv")).cast("array<string>"), ",").alias("ids"))

    def digest(batches):
        node, state, done = None, None, []
        for batch in batches:
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _pairs(done)
            done = []
        if node is not None:
            yield _pairs([(node, state.hexdigest())])

    return blocks.repartition("node").sortWithinPartitions("node", "block").select("node", "ids").mapInArrow(digest, "node string, ends_sha256 string")


def _pairs(rows: list) -> pa.RecordBatch:
    names, marks = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(marks, pa.string())], ["node", "ends_sha256"])


FOREST = ("node", "above", "depth", "conv", "weight", "part", "leaves", "saved")
TOTALS = "node string, leaves long, saved long"


class Forest:
    """Whole components in arrays: parents before children, -1 above a top."""

    def __init__(self, parent: np.ndarray, weight: np.ndarray, part: np.ndarray, values: np.ndarray):
        self.parent, self.weight, self.part, self.values = parent, weight, part.copy(), values
        n = len(parent)
        depth = np.zeros(n, np.int64)
        for i in range(n):  # bounded by the nodes of a task
            if parent[i] >= 0:
                depth[i] = depth[parent[i]] + 1
        self.depth = depth
        size = np.ones(n, np.int64)
        levels = [np.flatnonzero(depth == d) for d in range(int(depth.max()) + 1)] if n and depth.max() < 64 else None
        if levels is None:
            for i in range(n - 1, -1, -1):
                if parent[i] >= 0:
                    size[parent[i]] += size[i]
        else:
            for level in levels[:0:-1]:
                np.add.at(size, parent[level], size[level])
        # place of each node when children follow their parents: descendants are a range
        order = np.empty(n, np.int64)
        free, tops = {}, 0
        for i in range(n):
            if parent[i] < 0:
                order[i], tops = tops, tops + size[i]
            else:
                order[i] = free[int(parent[i])]
                free[int(parent[i])] += int(size[i])
            free[i] = int(order[i]) + 1
        self.order, self.size = order, size

    def totals(self) -> np.ndarray:
        """For every node, the sums of ``values`` over its subtree."""
        n = len(self.parent)
        result = np.zeros_like(self.values)
        top = np.arange(n)  # of the component each node is in
        for i in range(n):
            if self.parent[i] >= 0:
                top[i] = top[self.parent[i]]
        live = np.arange(n)
        part = self.part
        while len(live):
            # the deepest node that is heavier than half its component
            heavy = live[2 * part[live] > part[top[live]]]
            by = np.lexsort((-self.depth[heavy], top[heavy]))
            heavy = heavy[by]
            centre = heavy[np.concatenate([[True], top[heavy[1:]] != top[heavy[:-1]]])]
            of = np.full(n, -1)
            of[top[centre]] = centre
            mine = of[top[live]]  # centroid of each live node's component
            below = (self.order[live] >= self.order[mine]) & (self.order[live] < self.order[mine] + self.size[mine])
            # component totals: what lies at or below the centroid
            total = np.zeros_like(self.values)
            np.add.at(total, mine[below], self.values[live[below]])
            result[centre] += total[centre]
            # along the path from each centroid to its top
            walk, source = centre[centre != top[centre]], centre[centre != top[centre]]
            while len(walk):
                walk = self.parent[walk]
                np.add.at(result, walk, total[source])
                np.subtract.at(part, walk, part[source])
                on = walk != top[source]
                walk, source = walk[on], source[on]
            # new components: one below each child of a centroid, and what is left around the top
            inner = live[below & (live != mine)]
            child = inner[self.parent[inner] == of[top[inner]]]
            key = lambda nodes: self.order[of[top[nodes]]] * (n + 1) + self.order[nodes]  # noqa: E731, B023
            child = child[np.argsort(key(child))]
            if len(inner):
                new = child[np.searchsorted(key(child), key(inner), side="right") - 1]
                top[inner] = new
            live = live[live != mine]
        return result


def _split_in_task(table: pa.Table) -> pa.Table:
    """Totals of the components of one task, from their own nodes alone."""
    order = np.argsort(table.column("depth").to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    nodes = table.column("node").to_pylist()
    place = {name: i for i, name in enumerate(nodes)}
    same = table.column("component").to_pylist()
    above = table.column("above").to_pylist()
    # the top's parent is in another component
    parent = np.array([-1 if name == c else place[a] for name, a, c in zip(nodes, above, same)], np.int64)
    values = np.stack([table.column(c).to_numpy() for c in ("leaves", "saved")], 1)
    made = Forest(parent, table.column("weight").to_numpy(), table.column("part").to_numpy(), values).totals()
    return pa.Table.from_arrays([pa.array(nodes, pa.string()), pa.array(made[:, 0]), pa.array(made[:, 1])], ["node", "leaves", "saved"])


def rollup(nodes: DataFrame, paths: DataFrame, most: int = TASK_NODES) -> DataFrame:
    """(node, leaves, saved): sums over the subtree of every node of a forest.

    ``nodes`` has the columns FOREST: a node, the one above it, its depth, a conversation through
    it, its weight, the weight of its subtree, and the values to sum. ``paths`` has (conv, depth,
    node) of at least those conversations.
    """
    live = nodes.select(*FOREST, F.lit(ROOT).alias("component"))
    added, small = [], []
    while True:
        # weight and size of each component; its top has the heaviest part
        sizes = staged(live.groupBy("component").agg(F.max("part").alias("whole"), F.count("*").alias("n"), F.min("depth").alias("top_depth")), "components")
        fits = F.col("n") <= most
        ready = sizes.filter(fits).select("component", "n")
        small.append(join_hot_keys(live, ready, "component", ["node"], most * 8))
        if sizes.filter(~fits).isEmpty():
            break
        large = staged(join_hot_keys(live, sizes.filter(~fits), "component", ["node"], most * 8).drop("n"), "large_components")
        centre = large.filter(2 * F.col("part") > F.col("whole")).groupBy("component").agg(
            F.max(F.struct("depth", "node", "conv", "part", "top_depth")).alias("c")).select("component", "c.*")
        centre = staged(centre.select("component", F.col("node").alias("centre"), F.col("depth").alias("centre_depth"), F.col("conv").alias("centre_conv"),
                                      F.col("part").alias("gone"), "top_depth"), "centroids")
        # conversations through each centroid, and the child of it that they go on to
        through = paths.join(centre.select(F.col("centre").alias("node"), "component", "centre_depth"), "node").select("conv", "component", "centre_depth")
        after = paths.select("conv", (F.col("depth") - 1).alias("centre_depth"), F.col("node").alias("child"))
        through = through.join(after, ["conv", "centre_depth"], "left").select("conv", "component", "centre_depth", "child")
        placed = join_hot_keys(large, centre.select("component", "centre"), "component", ["node"], most * 8).join(
            through, ["conv", "component"], "left")
        inside = F.coalesce(F.col("depth") >= F.col("centre_depth"), F.lit(False))
        placed = staged(placed.withColumn("inside", inside), "placed")
        totals = placed.filter("inside").groupBy("component").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        totals = staged(centre.join(totals, "component"), "centroid_totals")
        # the centroid and the nodes from it to the top get what lies below it
        steps = totals.select(
            F.col("centre_conv").alias("conv"), F.explode(F.sequence("top_depth", "centre_depth")).alias("depth"), "leaves", "saved",
            F.when(F.col("depth") < F.col("centre_depth"), F.col("gone")).otherwise(0).alias("gone"))
        steps = staged(paths.select("conv", "depth", "node").join(steps, ["conv", "depth"]).select("node", "leaves", "saved", "gone"), "paths_to_tops")
        added.append(steps.select("node", "leaves", "saved"))
        left = placed.filter("node <> centre").join(steps.select("node", "gone"), "node", "left")
        live = staged(left.select(
            *[c for c in FOREST if c != "part"], (F.col("part") - F.coalesce("gone", F.lit(0))).alias("part"),
            F.when(F.col("inside"), F.col("child")).otherwise(F.col("component")).alias("component")), "split")
    pieces = None
    for part in small:
        pieces = part if pieces is None else pieces.unionByName(part)
    pieces = staged(pieces, "small_components")
    count = pieces.select("component", "n").distinct().agg(F.sum("n")).first()[0] or 0
    bins = max(1, -(-count // most))
    made = pieces.withColumn("bin", F.pmod(F.xxhash64("component"), F.lit(bins))).groupBy("bin").applyInArrow(_split_in_task, TOTALS)
    for part in added:
        made = made.union(part)
    return made.groupBy("node").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


@on_workers
def prefix_trie(conversations: DataFrame, family: int = FAMILY, lent: int = LENT, most: int = TASK_NODES) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256
    of every distinct prefix of the rebuilt conversations, the empty one included.

    Conversation c is rebuilt from the first h turns of the first id of its family of ``family``
    ids, h = crc32(c) modulo ``lent``, and its own turns after its first h. Null roles and texts
    are empty, a null turn comes first, turns of one number stand in the order of their digests,
    repeated rows are turns of their own. Rows without conv_id belong to no conversation; an empty
    table has no node, not even a root. Turns and prefixes are told apart by 128-bit digests.
    Texts of any length are digested in the task that reads them.
    """
    rows, lengths = rebuilt_turns(conversations, family, lent)
    prefixes = staged(prefix_rows(rows, lengths), "prefixes")
    grouped = prefixes.groupBy("node").agg(
        F.min("above").alias("above"), F.min("depth").alias("depth"), F.min("conv").alias("conv"), F.count("*").alias("weight"),
        F.sum(F.col("turns") - F.col("depth") + 1).alias("part"), F.max("length").alias("length"))
    grouped = staged(grouped, "nodes")
    children = grouped.filter("above IS NOT NULL").groupBy("above").agg(F.count("*").alias("n_children")).withColumnRenamed("above", "node")
    nodes = grouped.join(children, "node", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    forest = nodes.withColumns({
        "leaves": F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long"), "saved": (F.col("weight") - 1) * F.col("length")})
    forest = staged(forest, "forest")
    totals = rollup(forest.select(*FOREST), prefixes.select("conv", "depth", "node"), most)
    parents = forest.select(F.col("node").alias("above"), F.col("conv").alias("parent_conv_id"))
    known = join_hot_keys(forest.filter("above IS NOT NULL"), parents, "above", ["node"]).select("node", "parent_conv_id")
    return (
        forest.join(totals.select("node", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens")), "node")
        .join(known, "node", "left").join(_end_digests(prefixes), "node", "left")
        .select(
            F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("weight").alias("n_convs"), "n_children", "n_leaves", "saved_tokens",
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
    )
