"""N-gram Jaccard join with prefix trees.

Documents are sets of word shingles. With the shingles in one global order, rare ones first,
two sets of Jaccard similarity 3/4 or more share a shingle among the first few of each list (a
quarter of it), so only documents that meet there are candidates. The candidates of a neighbourhood go into a trie of their ordered lists; each
document walks it once, carries the overlap of the shared beginnings along, and leaves a
subtree as soon as the remaining lengths cannot make up the needed overlap.

How it is spread out:

1. Every task packs the shingles of its documents by hash range; one task per range finds
   which shingles occur in several documents, and how often. Shingles that many documents of
   one batch share are counted apart and ordered last, so no range holds a hot one.
2. Per document only shared shingles come back; the others merely count towards its length.
   Documents that have too few of them to match anything end here.
3. Equal sets collapse to one representative. Representatives that share a shingle among
   their first ones form neighbourhoods (connected components of a pruned graph).
4. A neighbourhood is cut into blocks of bounded size and every pair of blocks is one task.
   Very large ones are first split by the shingles that tie them where that makes fewer copies
   of their lists than all pairs of blocks; a family of edited copies, whose heads are alike,
   is not. A task returns a spanning set of its links, never all pairs.
5. Components of links and equal sets give the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farewheel.llm.components import connected_components
from farewheel.llm.shipping import on_workers
from farewheel.llm.staging import shuffle_parts, staged
from farewheel.llm.words import give_back, hash_words, lower_ascii, mix, slices, text_buffer, windows

WIDTH = 5                   # words of a shingle
RANGE_SHINGLES = 2_000_000  # shingles of a hash range
BATCH_BYTES = 3 << 20      # text that is packed at once
HOT_SHARE, HOT_LEAST = 64, 48   # a shingle in 1/64 of a batch's documents (48 at least) is hot
BLOCK_DOCS, BLOCK_SHINGLES = 1000, 2_000_000
MOST_BLOCKS = 32            # neighbourhoods of more blocks are split by shingle if that is less work
_U = np.uint64
_HOT = 255                  # documents of a shingle are counted up to here


def shingle_sets(column: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Row number and 56-bit hash of the distinct shingles of each text, sorted by both.

    A text of fewer words than ``width`` has its whole word sequence as one shingle; a text
    without words has none."""
    data, offsets = text_buffer(column)
    words = hash_words(lower_ascii(data), offsets)
    counts, first = words.counts(), words.first[:-1]
    value, row = [], []
    grams = windows(words.hash, width)
    n = np.maximum(counts - width + 1, 0)
    if len(grams):
        rows = np.repeat(np.arange(len(n)), n)
        at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(len(rows))
        value.append(grams[at])
        row.append(rows)
    for k in range(1, width):
        short = np.flatnonzero(counts == k)
        if len(short):
            value.append(windows(words.hash, k)[first[short]])
            row.append(short)
    if not value:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    value, row = np.concatenate(value) >> _U(8), np.concatenate(row)
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    return row[keep], value[keep]


def _set_marks(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit mark of each set."""
    size = np.bincount(row, minlength=n)
    ends = np.cumsum(size)
    sums = np.concatenate([[_U(0)], np.cumsum(mix(value ^ _U(0x2545F4914F6CDD1D)), dtype=_U)])
    return size, mix(sums[ends] - sums[ends - size] + size.astype(_U))


def _sets(batches, name: str = "text"):
    """Batches cut to bounded size, with their shingle sets."""
    for batch in slices(batches, 10_000, BATCH_BYTES):
        row, value = shingle_sets(batch.column(name))
        yield batch, row, value, *_set_marks(row, value, batch.num_rows)


SIZES = "kind int, doc_id long, n long, mark long"


def _measure(batches):
    """Kind 0: id, size and mark of each document's set. Kind 1: a shingle (mark) that many
    documents of one batch hold."""
    for batch, row, value, size, mark in _sets(batches):
        k = batch.num_rows
        hot = np.zeros(0, _U)
        if len(value):
            ordered = np.sort(value)
            edge = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1], [True]]))
            hot = ordered[edge[:-1]][np.diff(edge) >= max(HOT_LEAST, k // HOT_SHARE)]
        yield pa.RecordBatch.from_arrays([
            pa.array(np.repeat(np.array([0, 1], np.int32), [k, len(hot)])),
            pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(len(hot), pa.int64())]),
            pa.array(np.concatenate([size, np.zeros(len(hot), np.int64)])),
            pa.array(np.concatenate([mark, hot]).view(np.int64)),
        ], ["kind", "doc_id", "n", "mark"])


def _bytes_of(deltas: np.ndarray) -> bytes:
    """64-bit numbers as byte planes: small numbers leave planes of zeros for compression."""
    return np.ascontiguousarray(deltas.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _pack(ids: np.ndarray, marks: np.ndarray, size: np.ndarray, row: np.ndarray, value: np.ndarray, df: np.ndarray | None = None) -> dict:
    """Documents and their shingles as byte strings; rows of one sort order."""
    used, local = np.unique(row, return_inverse=True)
    out = {
        "docs": ids[used].astype("<i8").tobytes() + marks[used].astype("<u8").tobytes() + size[used].astype("<u4").tobytes(),
        "rows": _bytes_of(local.astype(_U)),
        "shingles": _bytes_of(np.diff(value, prepend=_U(0))),
    }
    return out if df is None else out | {"df": df.astype("u1").tobytes()}


def _unpack(r: dict) -> tuple[np.ndarray, ...]:
    n = len(r["docs"]) // 20
    ids = np.frombuffer(r["docs"], "<i8", n)
    marks = np.frombuffer(r["docs"], "<u8", n, 8 * n)
    size = np.frombuffer(r["docs"], "<u4", n, 16 * n).astype(np.int64)
    value = np.cumsum(_numbers(r["shingles"]), dtype=_U)
    return ids, marks, size, _numbers(r["rows"]).astype(np.int64), value


PACKED = "part int, docs binary, rows binary, shingles binary"
_PACKED = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("rows", pa.binary()), ("shingles", pa.binary())])
_SHARED = _PACKED.append(pa.field("df", pa.binary()))


def _deal(ranges: int, hot: np.ndarray):
    """Shingles of each batch by hash range; hot ones go to ranges of their own turn, by
    document, where no count is needed."""
    def run(batches):
        for batch, row, value, size, mark in _sets(batches):
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False)
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            keep = known[row]
            row, value = row[keep], value[keep]
            part = (value >> _U(24)) * _U(ranges) >> _U(32)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, value), len(hot) - 1)
                is_hot = hot[at] == value
                own = (mix(ids[row].astype(np.int64).view(_U)) % _U(ranges)).astype(np.int64)
                part = np.where(is_hot, -1 - own, part.astype(np.int64))
            part = part.astype(np.int64)
            order = np.lexsort((value, part))
            part, row, value = part[order], row[order], value[order]
            cuts = np.flatnonzero(np.diff(part)) + 1
            rows = []
            for p, r, v in zip(part[np.concatenate([[0], cuts])] if len(part) else [], np.split(row, cuts), np.split(value, cuts)):
                rows.append({"part": int(p)} | _pack(ids, mark, size, r, v))
            yield pa.RecordBatch.from_pylist(rows, _PACKED)
    return run


def _count(parts: int):
    """One hash range: shingles of at least two documents with their number of documents,
    dealt to parts of documents."""
    def run(table: pa.Table) -> pa.Table:
        give_back()
        rows = [_unpack(r) for r in table.to_pylist()]
        part = table.column("part")[0].as_py()
        base = np.cumsum([0] + [len(r[0]) for r in rows])
        ids, marks, size = (np.concatenate([r[i] for r in rows]) for i in range(3))
        doc = np.concatenate([r[3] + b for r, b in zip(rows, base)])
        value = np.concatenate([r[4] for r in rows])
        order = np.argsort(value, kind="stable")
        doc, value = doc[order], value[order]
        if part < 0:
            df = np.full(len(value), _HOT, np.int64)
        else:
            edge = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1], [True]]))
            df = np.minimum(np.repeat(np.diff(edge), np.diff(edge)), _HOT)
        keep = df > 1
        doc, value, df = doc[keep], value[keep], df[keep]
        to = (mix(ids.view(_U)) % _U(parts)).astype(np.int64)[doc]
        order = np.lexsort((value, to))
        to, doc, value, df = to[order], doc[order], value[order], df[order]
        cuts = np.flatnonzero(np.diff(to)) + 1
        out = [
            {"part": int(t)} | _pack(ids, marks, size, d, v, f)
            for t, d, v, f in zip(to[np.concatenate([[0], cuts])] if len(to) else [], np.split(doc, cuts), np.split(value, cuts), np.split(df, cuts))
        ]
        return pa.Table.from_pylist(out, _SHARED)
    return run


LISTS = "doc_id long, mark long, n long, all_shared boolean, shingles binary, head array<long>"
_LISTS = pa.schema([
    ("doc_id", pa.int64()), ("mark", pa.int64()), ("n", pa.int64()), ("all_shared", pa.bool_()),
    ("shingles", pa.binary()), ("head", pa.list_(pa.int64()))])


def _order(table: pa.Table) -> pa.Table:
    """One part of documents: the shared shingles, and those among the first
    ``n - ceil(3n/4) + 1`` of the whole list in global order (rare ones first). Documents
    without such a head match nothing."""
    give_back()
    pieces = table.to_pylist()
    rows = [_unpack(r) for r in pieces]
    base = np.cumsum([0] + [len(r[0]) for r in rows])
    ids, marks, size = (np.concatenate([r[i] for r in rows]) for i in range(3))
    doc = np.concatenate([r[3] + b for r, b in zip(rows, base)])
    value = np.concatenate([r[4] for r in rows])
    df = np.concatenate([np.frombuffer(r["df"], "u1") for r in pieces])
    # equal documents (id and set) arrive in several pieces
    key = np.stack([ids.view(_U), marks], 1)
    _, first, same = np.unique(key, axis=0, return_index=True, return_inverse=True)
    doc = same.ravel()[doc]
    order = np.lexsort((value, df, doc))
    doc, value, df = doc[order], value[order], df[order]
    keep = np.ones(len(doc), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    doc, value, df = doc[keep], value[keep], df[keep]
    edge = np.concatenate([[0], np.flatnonzero(np.diff(doc)) + 1, [len(doc)]])
    out = []
    for a, b in zip(edge[:-1].tolist(), edge[1:].tolist()):
        at = first[doc[a]]
        n, shared = int(size[at]), b - a
        head = n - -(-3 * n // 4) + 1 - (n - shared)
        if head > 0:
            out.append({
                "doc_id": int(ids[at]), "mark": int(marks[at:at + 1].view(np.int64)[0]), "n": n, "all_shared": shared == n,
                "shingles": _bytes_of(np.diff(np.sort(value[a:b]), prepend=_U(0))), "head": value[a:a + head].view(np.int64).tolist()})
    return pa.Table.from_pylist(out, _LISTS)


class _Sets:
    """Union-find over small numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.inserted = [0] * n   # members of each class that are in the trie

    def join(self, x: int, y: int) -> int:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[y] = x
            self.inserted[x] += self.inserted[y]
        return x

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x


class Trie:
    """Radix tree of ordered shingle numbers. A node holds a run of numbers; below it are
    children by first number and the documents that end there."""

    __slots__ = ("run", "children", "ends", "deep", "least")

    def __init__(self, run: np.ndarray):
        self.run, self.children, self.ends = run, {}, []
        self.deep = len(run)     # numbers on the longest way down, this run included
        self.least = 1 << 62     # smallest set size below

    def insert(self, numbers: np.ndarray, doc: int, size: int) -> None:
        node = self
        node.deep, node.least = max(node.deep, len(node.run) + len(numbers)), min(node.least, size)
        while len(numbers):
            child = node.children.get(int(numbers[0]))
            if child is None:
                child = node.children[int(numbers[0])] = Trie(numbers)
                child.ends.append(doc)
                child.least = size
                return
            m = min(len(child.run), len(numbers))
            differ = np.flatnonzero(child.run[:m] != numbers[:m])
            same = int(differ[0]) if len(differ) else m
            if same < len(child.run):
                upper = Trie(child.run[:same])
                upper.deep, upper.least = child.deep, child.least
                child.run, child.deep = child.run[same:], child.deep - same
                upper.children[int(child.run[0])] = child
                node.children[int(numbers[0])] = child = upper
            numbers = numbers[same:]
            child.deep, child.least = max(child.deep, len(child.run) + len(numbers)), min(child.least, size)
            node = child
        node.ends.append(doc)


def links(lists: list[np.ndarray], sizes: list[int], left: int | None = None) -> list[tuple[int, int]]:
    """A spanning set of the links among ordered sets: pairs whose overlap o fulfils
    7 * o >= 3 * (n + m), the same as a Jaccard similarity of 3/4. With ``left``, only links
    between the first ``left`` sets and the others count, besides those that they imply."""
    known = _Sets(len(lists))
    root = Trie(np.zeros(0, np.int64))
    found = []
    marks = np.zeros(1 + max((int(x[-1]) for x in lists if len(x)), default=0), bool)

    def walk(doc: int) -> None:
        own, n = lists[doc], sizes[doc]
        marks[own] = True
        top = known.find(doc)
        stack = [(root, 0)]
        # once the walker's class is all that the trie holds, nothing is left to find
        while stack and known.inserted[top] < inserted:
            node, overlap = stack.pop()
            run = node.run
            if len(run):
                if not node.children and all(known.find(e) == top for e in node.ends):
                    continue
                # what the walker still has from the run's first number on
                mine = len(own) - int(np.searchsorted(own, run[0]))
                if 7 * (overlap + min(node.deep, mine)) < 3 * (n + node.least):
                    continue
                overlap += int(np.count_nonzero(marks[run]))
            for other in node.ends:
                if 7 * overlap >= 3 * (n + sizes[other]) and known.find(other) != top:
                    found.append((doc, other))
                    top = known.join(doc, other)
            stack += [(c, overlap) for c in node.children.values()]
        marks[own] = False

    rank = sorted(range(len(lists)), key=lambda i: sizes[i]) if left is None else [*range(len(lists))]
    inserted = 0
    for i in rank:
        if left is None or i >= left:
            walk(i)
        if left is None or i < left:
            root.insert(lists[i], i, sizes[i])
            inserted += 1
            known.inserted[known.find(i)] += 1
    return found


def _compare(table: pa.Table) -> pa.Table:
    """Links inside one block or between two blocks of a neighbourhood."""
    rows = sorted(table.select(["doc_id", "n", "shingles", "side"]).to_pylist(), key=lambda r: (r["side"], r["n"], r["doc_id"]))
    value = [np.cumsum(_numbers(r["shingles"]), dtype=_U) for r in rows]
    # number the task's shingles in the global order of their hashes
    _, code = np.unique(np.concatenate(value), return_inverse=True)
    numbers = np.split(code, np.cumsum([len(v) for v in value])[:-1])
    left = sum(r["side"] == 0 for r in rows)
    found = links(numbers, [r["n"] for r in rows], left if left < len(rows) else None)
    ids = [r["doc_id"] for r in rows]
    return pa.Table.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], ["a", "b"])


def _neighbourhoods(heads: DataFrame, lists: DataFrame) -> DataFrame:
    """(doc_id, area): representatives that may match share an area."""
    shared = heads.groupBy("shingle").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).filter("low < high")
    met = staged(heads.join(shared, "shingle").select("shingle", "doc_id", "low"), "met")
    near = connected_components(met.filter("doc_id <> low").select(F.col("doc_id").alias("a"), F.col("low").alias("b")).distinct())
    members = lists.select("doc_id", (F.octet_length("shingles") / 8).alias("k")).join(near, F.col("doc_id") == F.col("id")).select("doc_id", "component", "k")
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK_DOCS), F.ceil(F.sum("k") / BLOCK_SHINGLES)).cast("int").alias("blocks")
    sizes = staged(members.groupBy("component").agg(blocks, F.count("*").alias("docs")), "neighbourhoods")
    large = sizes.filter(F.col("blocks") > MOST_BLOCKS)
    area = lambda rows: rows.select("doc_id", F.col("component").alias("area"), F.lit(0).cast("long").alias("by"), "blocks")
    if large.isEmpty():
        return area(members.join(sizes, "component"))
    # only those that share a certain shingle meet, if each list is then copied less often
    wide = met.join(members.join(large.select("component"), "component"), "doc_id")
    ties = staged(wide.groupBy("component", "shingle").agg(blocks, F.count("*").alias("docs")), "ties")
    copies = ties.groupBy("component").agg(F.sum(F.col("docs") * F.col("blocks")).alias("copies"))
    apart = copies.join(large, "component").filter(F.col("copies") < F.col("docs") * F.col("blocks")).select("component")
    plain = area(members.join(sizes.join(apart, "component", "left_anti"), "component"))
    ties = ties.join(apart, "component").select(F.col("component").alias("c"), F.col("shingle").alias("s"), "blocks")
    split = wide.join(ties, (F.col("component") == F.col("c")) & (F.col("shingle") == F.col("s"))).select(
        "doc_id", F.col("component").alias("area"), F.col("shingle").alias("by"), "blocks")
    return plain.union(split)


@on_workers
def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of ``docs``.

    Two documents link when their sets of five-word shingles (ASCII letters lower-cased) have
    a Jaccard similarity of at least 0.75; ``component_id`` is the smallest doc_id reachable.
    A null or empty text, or one without words, has no shingle and links with nothing.
    Rows of one doc_id are one node of the graph: each row's set can link it. A row without
    doc_id links with nothing and has no component. Shingles are compared by 56-bit hashes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    measured = staged(texts.mapInArrow(_measure, SIZES), "set_sizes")
    total = measured.filter("kind = 0").agg(F.sum("n")).first()[0] or 0
    ranges = max(shuffle_parts(spark), -(-total // RANGE_SHINGLES))
    # in at least 1/HOT_SHARE of some batch, so at most HOT_SHARE average sets per batch
    hot = np.sort(np.array([r.mark for r in measured.filter("kind = 1").groupBy("mark").agg(F.count("*").alias("batches"))
                            .orderBy(F.desc("batches"), "mark").limit(1 << 20).select("mark").collect()], np.int64).view(_U))
    packed = texts.mapInArrow(_deal(ranges, hot), PACKED)
    counted = packed.groupBy("part").applyInArrow(_count(ranges), PACKED + ", df binary")
    lists = staged(counted.groupBy("part").applyInArrow(_order, LISTS), "ordered_sets")
    # equal sets: one representative, the smallest id
    alike = lists.filter("all_shared").groupBy("mark", "n").agg(F.min("doc_id").alias("first"))
    equal = lists.filter("all_shared").join(alike, ["mark", "n"]).filter("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b"), "mark")
    equal = staged(equal, "equal_sets")
    chosen = lists.join(equal.select(F.col("a").alias("doc_id"), "mark"), ["doc_id", "mark"], "left_anti")
    heads = chosen.select("doc_id", F.explode("head").alias("shingle"))
    areas = _neighbourhoods(heads, chosen)
    block = F.pmod(F.xxhash64("doc_id", "area"), F.col("blocks")).cast("int")
    # block i meets itself and every other block
    placed = areas.withColumn("own", block).select(
        "doc_id", "area", "by", F.col("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "doc_id", "area", "by", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    found = placed.join(chosen.select("doc_id", "n", "shingles"), "doc_id").groupBy("area", "by", "i", "j").applyInArrow(_compare, "a long, b long")
    component = connected_components(found.union(equal.select("a", "b")))
    sizes = measured.filter("kind = 0").select("doc_id", F.col("n").alias("n_shingles"))
    return sizes.join(component, F.col("doc_id") == F.col("id"), "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
