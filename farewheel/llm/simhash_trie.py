"""Near duplicates by SimHash, joined in a binary trie.

Every text is reduced in one pass to a fingerprint of 64 bits: a bit is set if more than half of
its word shingles have it set in their XXH64. Equal fingerprints become one entry, so copies
cost a partial aggregation and nothing more.

A binary trie over fingerprints is joined with itself: node pairs are walked together from the
top, each step adds the bit in which the two children differ, and a pair of subtrees is left as
soon as its differing bits exceed the budget. Two fingerprints within a budget of b bits agree in
one of b + 1 blocks of their bits. So each fingerprint is placed in b + 1 tries, each with another
block first, and in each of them only equal top blocks are walked: a trie falls into the
subtrees below its block, which are dealt to tasks in runs of bounded size. A subtree that is
larger than a task may hold is walked from its top in tables of nodes and their sizes, until both
nodes of a pair fit a task together; the pairs are then the tasks.

Tasks return no pairs but, for the members of each component they find, its smallest member:
fewer rows than entries. Pairs of subtrees that lie in one component already are not walked
again, so a dense family costs little more than the links that hold it together. The stars meet
in one table of edges, whose connected components carry the smallest document id back.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from farewheel.functions.skew import join_hot_keys
from farewheel.llm.components import connected_components
from farewheel.llm.shipping import on_workers
from farewheel.llm.staging import staged
from farewheel.llm.words import ragged, slices

SHINGLE = 3            # words
BUDGET = 3             # differing bits of a link
SEED = 42
BITS = 64
TASK_ENTRIES = 1 << 16  # entries of a task, and of a subtree that one task walks alone
STEP = 4               # levels that a large subtree is opened by at a time
CHUNK = 1 << 20        # characters of a text that are split at once
PAIRS = 1 << 18        # node pairs that are opened at once
FEW = 64               # pairs of entries below two nodes that are compared without opening them
_U = np.uint64
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def shingle_hashes(text: str | None, width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every ``width`` consecutive words, repeats included; of the whole sequence if
    there are fewer words."""
    raw = (text or "").encode().lower()
    parts, carried, at = [], [], 0
    while at < len(raw):
        border = _SPACE.search(raw, at + CHUNK)
        end = border.start() if border else len(raw)
        words = carried + raw[at:end].split()
        if len(words) >= width:
            line = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            start = np.cumsum(size) - size
            stop = (start + size - 1)[width - 1:].tolist()
            parts.append(np.fromiter(
                (xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(start.tolist(), stop)), _U, len(stop)))
            carried = words[-(width - 1):] if width > 1 else []
        else:
            carried = words
        at = end
    if not parts:
        return np.array([xxhash.xxh64_intdigest(b" ".join(carried), seed)] if carried else [], _U)
    return np.concatenate(parts)


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each run of hashes, the bits that more than half of them have; 0 for an empty run."""
    size = np.diff(offsets)
    out = np.zeros(len(size), _U)
    some = np.flatnonzero(size)
    if len(some):
        begin, half = offsets[some], size[some].astype(_U)
        for bit in range(BITS):
            ones = np.add.reduceat((hashes >> _U(bit)) & _U(1), begin)
            out[some] |= (2 * ones > half).astype(_U) << _U(bit)
    return out


def _fingerprint(width: int, seed: int):
    def run(batches):
        for batch in slices(batches):
            hashes = [shingle_hashes(t, width, seed) for t in batch.column("_text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in hashes])]).astype(np.int64)
            marks = majority(np.concatenate(hashes), offsets)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(marks.view(np.int64))], ["doc_id", "fingerprint"])
    return run


@on_workers
def fingerprints(docs: DataFrame, width: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fingerprint (as signed 64-bit number) of every row."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").alias("_text")).mapInArrow(
        _fingerprint(width, seed), "doc_id long, fingerprint long")


class Components:
    """Labels of entries: the smallest place in each component."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        parent = self.label
        while len(a):
            x, y = parent[a], parent[b]
            apart = x != y
            if not apart.any():
                break
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
        self.label = parent

    def one(self, low: np.ndarray, high: np.ndarray, other_low: np.ndarray, other_high: np.ndarray) -> np.ndarray:
        """Whether all entries of both ranges are in one component."""
        edge = np.flatnonzero(np.concatenate([self.label[1:] != self.label[:-1], [True]])) + 1
        runs = np.repeat(edge, np.diff(np.concatenate([[0], edge])))  # end of the run of each place
        return (runs[low] >= high) & (runs[other_low] >= other_high) & (self.label[low] == self.label[other_low])


def trie_components(values: np.ndarray, pairs: tuple[np.ndarray, ...], depth: int, budget: int) -> np.ndarray:
    """Component label (place of the smallest member) of each of the sorted distinct
    ``values``. ``pairs`` are node pairs at ``depth``: the ranges of two nodes and the bits in
    which these differ; a node may be paired with itself."""
    found = Components(len(values))
    stack = [(depth, *pairs)]
    while stack:
        depth, low, high, other_low, other_high, bits = stack.pop()
        if len(low) > PAIRS:
            stack += [(depth, *(x[i:i + PAIRS] for x in (low, high, other_low, other_high, bits))) for i in range(0, len(low), PAIRS)]
            continue
        same = low == other_low
        open_ = ~found.one(low, high, other_low, other_high) & ~(same & (high - low < 2))
        low, high, other_low, other_high, bits, same = (x[open_] for x in (low, high, other_low, other_high, bits, same))
        if not len(low):
            continue
        size, other = high - low, other_high - other_low
        small = (size * other <= FEW) | (depth == BITS)
        if small.any():
            n = size[small] * other[small]
            within = ragged(np.zeros(len(n), np.int64), n)
            width = np.repeat(other[small], n)
            a = np.repeat(low[small], n) + within // width
            b = np.repeat(other_low[small], n) + within % width
            near = np.bitwise_count(values[a] ^ values[b]) <= budget
            found.join(a[near], b[near])
        rest = ~small
        low, high, other_low, other_high, bits, same = (x[rest] for x in (low, high, other_low, other_high, bits, same))
        if not len(low):
            continue
        mid, other_mid = _middle(values, low, high, depth), _middle(values, other_low, other_high, depth)
        across = ~same
        equal = [(low, mid, other_low, other_mid, bits), (mid, high, other_mid, other_high, bits)]
        differ = [(low, mid, other_mid, other_high, bits + 1),
                  tuple(x[across] for x in (mid, high, other_low, other_mid, bits + 1))]
        # what differs waits: by then its entries may be in one component
        for group in (differ, equal):
            low_, high_, other_low_, other_high_, bits_ = (np.concatenate(x) for x in zip(*group))
            go = (high_ > low_) & (other_high_ > other_low_) & (bits_ <= budget)
            stack.append((depth + 1, *(x[go] for x in (low_, high_, other_low_, other_high_, bits_))))
    return found.label


def _middle(values: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int) -> np.ndarray:
    """Where the bit after the first ``depth`` ones turns to 1 in each node's range."""
    bit = _U(BITS - 1 - depth)
    border = ((values[low] >> bit) | _U(1)) << bit
    return np.clip(np.searchsorted(values, border), low, high)


def _ranges(values: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix and range of every node at ``depth``."""
    top = values >> _U(BITS - depth) if depth else np.zeros(len(values), _U)
    begin = np.flatnonzero(np.concatenate([[True], top[1:] != top[:-1]])) if len(top) else np.zeros(0, np.int64)
    return top[begin], begin, np.append(begin[1:], len(values))


def _turn(values: np.ndarray, by: int) -> np.ndarray:
    by %= BITS
    return (values << _U(by)) | (values >> _U(BITS - by)) if by else values


STARS = "a long, b long"


def _stars(values: np.ndarray, label: np.ndarray, by: int) -> pa.Table:
    """Each entry of a component with its first one, with the bits back in their places."""
    own = _turn(values, BITS - by).view(np.int64)
    later = np.flatnonzero(label != np.arange(len(label)))
    return pa.Table.from_arrays([pa.array(own[later]), pa.array(own[label[later]])], ["a", "b"])


def _walk_subtrees(block: int, budget: int):
    """One task: a run of subtrees, each joined with itself."""
    def run(table: pa.Table) -> pa.Table:
        by = table.column("turned")[0].as_py()
        values = np.unique(table.column("value").to_numpy().view(_U))
        _, begin, end = _ranges(values, block)
        none = np.zeros(len(begin), np.int64)
        return _stars(values, trie_components(values, (begin, end, begin, end, none), block, budget), by)
    return run


def _walk_pair(budget: int):
    """One task: two nodes of a large subtree, or one and itself."""
    def run(table: pa.Table) -> pa.Table:
        first = {c: table.column(c)[0].as_py() for c in ("turned", "depth", "a", "b", "bits")}
        values = np.unique(table.column("value").to_numpy().view(_U))
        prefix, begin, end = _ranges(values, first["depth"])
        at = [int(np.searchsorted(prefix, _U(first[x] % (1 << 64)))) for x in "ab"]
        pair = tuple(np.array([x], np.int64) for x in (begin[at[0]], end[at[0]], begin[at[1]], end[at[1]], first["bits"]))
        return _stars(values, trie_components(values, pair, first["depth"], budget), first["turned"])
    return run


def _prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, BITS - depth) if depth < BITS else value


def _open_large(large: DataFrame, block: int, budget: int, most: int) -> DataFrame | None:
    """Node pairs (turned, depth, a, b, bits) below the large subtrees that are to be walked by a
    task each, of at most ``most`` entries together."""
    pairs = large.select("turned", _prefix(F.col("value"), block).alias("a")).distinct().select(
        "turned", "a", F.col("a").alias("b"), F.lit(0).alias("bits"))
    tasks, depth = None, block
    while True:
        deeper = min(BITS, depth + STEP)
        nodes = large.groupBy("turned", _prefix(F.col("value"), deeper).alias("node")).agg(F.count("*").alias("n"))
        nodes = staged(nodes.withColumn("above", F.shiftrightunsigned("node", deeper - depth)), "trie_nodes")
        side = lambda x: nodes.select("turned", F.col("above").alias(x), F.col("node").alias(f"{x}_node"), F.col("n").alias(f"{x}_n"))  # noqa: E731, B023
        opened = pairs.join(side("a"), ["turned", "a"]).join(side("b"), ["turned", "b"]).filter(
            (F.col("a") != F.col("b")) | (F.col("a_node") <= F.col("b_node")))
        differing = F.col("bits") + F.bit_count(F.col("a_node").bitwiseXOR(F.col("b_node")).bitwiseAND((1 << (deeper - depth)) - 1))
        opened = opened.select(
            "turned", F.col("a_node").alias("a"), F.col("b_node").alias("b"), differing.cast("int").alias("bits"), (F.col("a_n") + F.col("b_n")).alias("n"),
        ).filter(F.col("bits") <= budget)
        opened = staged(opened, "node_pairs")
        depth = deeper
        fit = (F.col("n") <= most) | F.lit(depth == BITS)
        ready = opened.filter(fit).filter("a <> b OR n > 2").select("turned", F.lit(depth).alias("depth"), "a", "b", "bits")
        tasks = ready if tasks is None else tasks.union(ready)
        pairs = opened.filter(~fit).drop("n")
        if pairs.isEmpty():
            return staged(tasks, "trie_tasks")


def near_entries(entries: DataFrame, budget: int = BUDGET, most: int = TASK_ENTRIES) -> DataFrame:
    """(a, b): edges whose components are those of all pairs of distinct ``entries`` (column
    fingerprint) that differ in at most ``budget`` bits."""
    block = BITS // (budget + 1)
    turn = lambda by: F.shiftleft("fingerprint", by).bitwiseOR(F.shiftrightunsigned("fingerprint", BITS - by)) if by else F.col("fingerprint")
    turns = F.explode(F.array(*[F.struct(F.lit(i * block).alias("turned"), turn(i * block).alias("value")) for i in range(budget + 1)]))
    placed = entries.select(turns.alias("t")).select("t.turned", "t.value")
    top = _prefix(F.col("value"), block)
    sizes = staged(placed.groupBy("turned", top.alias("top")).agg(F.count("*").alias("n")).filter("n > 1"), "subtrees")
    # subtrees in runs of at most 2 * most entries; there are 2^block of them in a turn at most
    before = Window.partitionBy("turned").orderBy("top").rowsBetween(Window.unboundedPreceding, -1)
    runs = sizes.filter(F.col("n") <= most).select(
        "turned", "top", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / most).cast("int").alias("run"))
    rows = placed.withColumn("top", top)
    found = rows.join(runs, ["turned", "top"]).select("turned", "run", "value").groupBy("turned", "run").applyInArrow(
        _walk_subtrees(block, budget), STARS)
    hot = sizes.filter(F.col("n") > most).select("turned", "top")
    if hot.isEmpty():
        return found
    large = staged(rows.join(hot, ["turned", "top"]).select("turned", "value"), "large_subtrees")
    tasks = _open_large(large, block, budget, most)
    depths = [r.depth for r in tasks.select("depth").distinct().collect()]  # one per STEP levels at most
    for depth in depths:
        here = tasks.filter(F.col("depth") == depth)
        node = _prefix(F.col("value"), depth)
        sides = [("a", here), ("b", here.filter("a <> b"))]
        dealt = None
        for name, some in sides:
            part = large.withColumn(name, node).join(some, ["turned", name]).select("turned", "depth", "a", "b", "bits", "value")
            dealt = part if dealt is None else dealt.union(part)
        found = found.union(dealt.groupBy("turned", "depth", "a", "b").applyInArrow(_walk_pair(budget), STARS))
    return found


@on_workers
def simhash_components(docs: DataFrame, width: int = SHINGLE, budget: int = BUDGET, most: int = TASK_ENTRIES) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id for every row of ``docs``.

    Words are runs of other bytes than space and the controls 9 to 13, ASCII letters lower-cased.
    Rows link when their fingerprints differ in at most ``budget`` bits; ``component_id`` is the
    smallest doc_id reachable. Null, empty and blank texts have fingerprint 0 and link like any
    other. Repeated rows and ids are nodes of one class; a row without doc_id links too, but gives
    its class no id: a class of such rows alone has a null component_id. Texts of any length are
    hashed in pieces, eight bytes a word. Other columns are dropped, whatever their names.
    """
    prints = staged(fingerprints(docs, width), "fingerprints")
    entries = staged(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")), "entries")
    component = staged(connected_components(near_entries(entries.select("fingerprint"), budget, most)), "components")
    linked = component.join(entries, F.col("id") == F.col("fingerprint")).select("fingerprint", "component", "first")
    least = linked.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = join_hot_keys(linked, least, "component", ["fingerprint"]).select("fingerprint", "component_id")
    alone = entries.join(component.select(F.col("id").alias("fingerprint")), "fingerprint", "left_anti")
    classes = classes.union(alone.select("fingerprint", F.col("first").alias("component_id")))
    return join_hot_keys(prints, classes, "fingerprint", ["doc_id"]).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
