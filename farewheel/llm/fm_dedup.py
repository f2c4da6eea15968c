"""Substring deduplication with a compressed FM-index per shard.

A window is ``width`` consecutive words. Every window is sent to the shard of its anchor, the
word n-gram inside it with the smallest hash, so equal windows always meet. Neighbouring
windows with one anchor travel together as a segment, as text compressed with zstandard.

A shard keeps the segments whose anchor occurs in several documents, writes equal segments
once, and indexes them: their words sorted into a Burrows-Wheeler transform, held in a wavelet
tree of bit vectors with rank counts. The segments then stream against the index: backward
search extends a match word by word and gives the matching statistic of each position, the
length of the longest match up to the threshold, with the index interval of its occurrences.
Where the statistic reaches the threshold and the interval holds an occurrence in a document
with a smaller id, the interval of words is reported. Reports meet the whole texts again by
document, and what they cover is cut out.

Copies of one segment in a batch are decided before the shuffle, except those of the smallest
document, so the inside of a passage that a third of all documents share reaches its shard once
per batch. Where the passage begins and ends, a segment holds a document's own words too and
differs in each of them. Segments are therefore counted by anchor first (sums per batch, of
anchors that a batch holds twice). Segments of an anchor above HOT_PART of a shard fall into
their windows, equal windows of a batch are decided there, and the rest is dealt by the hash of
the whole window, on which equal windows agree as well. So an anchor brings to its shard no more
than that share and one segment per batch, a window one copy per batch (of its smallest document
there, all places). The driver gets the list of hot anchors only: at most one in as many
segments as make an anchor hot.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farewheel.llm.shipping import on_workers
from farewheel.llm.staging import parts_of
from farewheel.llm.words import Words, _powers, _BASE, _INVERSE, give_back, hash_words, mix, ragged, slices, text_buffer, windows

WIDTH = 13              # words of a window
ANCHOR = 4              # words of an anchor
SHARD_BYTES = 3 << 20   # text per shard and per part of documents
BATCH_BYTES = 2 << 20
HOT_PART = 512          # an anchor of one segment per so many bytes of a shard is hot
_U = np.uint64


class BitVector:
    """Bits with constant-time rank: packed words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[:len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8").astype(_U)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))]).astype(np.int32)
        self.zeros = int(len(bits) - self.before[-1])

    def ones_before(self, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        low = self.words[word] & ((_U(1) << (at & 63).astype(_U)) - _U(1))
        return self.before[word] + np.bitwise_count(low).astype(np.int64)


class WaveletTree:
    """Rank of any symbol in a sequence, level by level from the highest bit (all nodes of a
    level share one bit vector, zeros before ones)."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = []
        bits = max(1, int(alphabet - 1).bit_length())
        order = symbols
        for level in reversed(range(bits)):
            bit = (order >> level) & 1
            self.levels.append((level, BitVector(bit.astype(np.uint8))))
            order = np.concatenate([order[bit == 0], order[bit == 1]])
        # where each symbol's run starts below the last level
        edge = np.flatnonzero(np.concatenate([[True], order[1:] != order[:-1]])) if len(order) else np.zeros(0, np.int64)
        self.start = np.zeros(alphabet, np.int64)
        self.start[order[edge]] = edge

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each place."""
        for level, vector in self.levels:
            ones = vector.ones_before(at)
            at = np.where((symbol >> level) & 1, vector.zeros + ones, at - ones)
        return at - self.start[symbol]


class FmIndex:
    """Index of word sequences (numbers from 1 on) for matches of up to ``limit`` words."""

    def __init__(self, sequences: np.ndarray, offsets: np.ndarray, alphabet: int, limit: int):
        size = np.diff(offsets)
        n = len(sequences) + len(size)
        text = np.zeros(n, np.int64)  # every sequence ends with 0
        text[ragged(offsets[:-1] + np.arange(len(size)), size)] = sequences
        self.owner = np.repeat(np.arange(len(size), dtype=np.int32), size + 1)
        # rank of each suffix by its first 1, 2, 4, ... and at last ``limit`` words
        rank, have = text, 1
        while have < limit:
            step = min(have, limit - have)
            after = np.concatenate([rank[step:], np.zeros(step, np.int64)])
            _, rank = np.unique(rank * (int(rank.max()) + 1) + after, return_inverse=True)
            have += step
        self.suffixes = np.argsort(rank, kind="stable").astype(np.int32)
        last = text[self.suffixes - 1]  # the word before each suffix
        self.tree = WaveletTree(last, alphabet)
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])
        self.limit = limit

    def matching_statistics(
        self, words: np.ndarray, begin: np.ndarray, end: np.ndarray, occurrences: int = 1
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each end place, the longest match that ends before it, not longer than the limit
        and not reaching before ``begin``; and the interval of its occurrences. Matches are
        extended as long as they occur at least ``occurrences`` times."""
        n = len(end)
        length, low, high = np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, len(self.suffixes))
        live = np.flatnonzero(end > begin)
        lo, hi = low[live], high[live]
        for step in range(self.limit):
            symbol = words[end[live] - 1 - step]
            if step:
                ranks = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
                lo, hi = self.below[symbol] + ranks[:len(live)], self.below[symbol] + ranks[len(live):]
            else:
                lo, hi = self.below[symbol], self.below[symbol + 1]
            found = hi - lo >= occurrences
            live, lo, hi = live[found], lo[found], hi[found]
            length[live], low[live], high[live] = step + 1, lo, hi
            more = end[live] - begin[live] > step + 1
            live, lo, hi = live[more], lo[more], hi[more]
            if not len(live):
                break
        return length, low, high


def sequence_marks(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit mark of each range of words."""
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(mix(hashes + _U(0x632BE59BD9B4E019)) * _powers(_BASE, len(hashes)), out=sums[1:])
    return mix((sums[end] - sums[start]) * _powers(_INVERSE, len(hashes) + 1)[start] + (end - start).astype(_U))


def _smallest(grams: np.ndarray, width: int) -> np.ndarray:
    """Place of the (first) smallest of every ``width`` consecutive values."""
    at, have = np.arange(len(grams)), 1
    while have < width:
        step = min(have, width - have)
        left, right = at[:-step], at[step:]
        at = np.where(grams[right] < grams[left], right, left)
        have += step
    return at


def _anchor_marks(grams: np.ndarray) -> np.ndarray:
    return mix(grams ^ _U(0x9FB21C651E98DF25))


def segments(words: Words, width: int = WIDTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first word, number of windows and anchor hash of each segment."""
    none = np.zeros(0, np.int64)
    if len(words.hash) < width:
        return none, none, none, np.zeros(0, _U)
    grams = windows(words.hash, anchor)
    place = _smallest(grams, width - anchor + 1)
    rows = words.rows()
    n = len(words.hash) - width + 1
    inside = rows[:n] == rows[width - 1:]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (place[1:n] != place[:n - 1])
    start = np.flatnonzero(new)
    # a segment ends before the next one or the next window that crosses texts
    stop = np.concatenate([np.flatnonzero(new[1:] | ~inside[1:]) + 1, [n]])
    count = stop[np.searchsorted(stop, start, side="right")] - start
    return rows[start], start, count, _anchor_marks(grams[place[start]])


def _planes(numbers: np.ndarray) -> bytes:
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _part_of(ids: np.ndarray, parts: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(_U)) % _U(parts)).astype(np.int64)


def _marks(column: pa.Array) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t or "") for t in column.to_pylist()], _U)


def _docs(ids: np.ndarray, marks: np.ndarray) -> bytes:
    return ids.astype("<i8").tobytes() + marks.astype("<u8").tobytes()


def _ids_and_marks(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 16
    return np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n)


def _groups(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Borders of equal neighbours."""
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    return edge, np.concatenate([edge[1:], [len(part)]]) if len(part) else edge


DEALT = "part int, docs binary, places binary, text binary"
_DEALT = pa.schema([("part", pa.int32()), ("docs", pa.binary()), ("places", pa.binary()), ("text", pa.binary())])


def _report_rows(ids, marks, row, start, count, parts: int, sign: int) -> list[dict]:
    """Reported windows (first word and number per text) packed by part of documents."""
    part = _part_of(ids[row], parts)
    order = np.lexsort((start, row, part))
    part, row, start, count = part[order], row[order], start[order], count[order]
    # neighbours travel as one
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + count[:-1])
    new = np.flatnonzero(new)
    part, row, start, count = part[new], row[new], start[new], np.add.reduceat(count, new)
    out = []
    for a, b in zip(*_groups(part)):
        used, local = np.unique(row[a:b], return_inverse=True)
        out.append({
            "part": int(part[a]) if sign > 0 else -1 - int(part[a]), "docs": _docs(ids[used], marks[used]),
            "places": _planes(np.concatenate([local, start[a:b], count[a:b]])), "text": None})
    return out


def _copies(ids: np.ndarray, content: np.ndarray) -> np.ndarray:
    """Which entries have equal content in a document with a smaller id."""
    order = np.lexsort((ids, content))
    begin, stop = _groups(content[order])
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(ids[order[begin]], stop - begin)
    return ids > least


def _batch_segments(batches, width: int):
    """Batches of texts with id, cut to bounded size, with their segments, and which of these
    are copies inside the batch."""
    for batch in slices(batches, 10_000, BATCH_BYTES):
        known = np.flatnonzero(batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
        own = batch.take(pa.array(known))
        data, offsets = text_buffer(own.column("text"))
        words = hash_words(data, offsets)
        row, start, count, anchor = segments(words, width)
        if len(row):
            content = sequence_marks(words.hash, start, start + count + width - 1)
            copy = _copies(own.column("doc_id").to_numpy()[row], content)
            yield own, data, words, row, start, count, anchor, copy


ANCHORS = "anchor long, segments long"


def _count_anchors(width: int):
    """Anchors of several segments of a batch, copies inside the batch left out."""
    def run(batches):
        for *_, anchor, copy in _batch_segments(batches, width):
            anchor = np.sort(anchor[~copy])
            begin, stop = _groups(anchor)
            size = stop - begin
            some = size > 1
            yield pa.RecordBatch.from_arrays([pa.array(anchor[begin[some]].view(np.int64)), pa.array(size[some])], ["anchor", "segments"])
    return run


def _is_hot(anchor: np.ndarray, hot: np.ndarray) -> np.ndarray:
    if not len(hot):
        return np.zeros(len(anchor), bool)
    return hot[np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)] == anchor


def _deal(shards: int, parts: int, width: int, hot: np.ndarray):
    """Segments by shard, those of hot anchors window by window; reports on copies inside the
    batch by part of documents, under negative numbers."""
    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=3).compress
        for own, data, words, row, start, count, anchor, copy in _batch_segments(batches, width):
            ids, marks = own.column("doc_id").to_numpy(), _marks(own.column("text"))
            split = _is_hot(anchor, hot) & ~copy
            if split.any():
                each = np.where(split, count, 1)
                single = np.repeat(split, each)
                start = ragged(start, each)
                row, copy = np.repeat(row, each), np.repeat(copy, each)
                count, anchor = np.where(single, 1, np.repeat(count, each)), np.repeat(anchor, each)
                at = np.flatnonzero(single)
                content = sequence_marks(words.hash, start[at], start[at] + width)
                copy[at] = _copies(ids[row[at]], content)
                anchor[at] = content
            in_doc = start - words.first[row]
            copy, keep = np.flatnonzero(copy), np.flatnonzero(~copy)
            out = _report_rows(ids, marks, row[copy], in_doc[copy], count[copy], parts, -1) if len(copy) else []
            shard = ((anchor[keep] >> _U(32)) * _U(shards) >> _U(32)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            keep, shard = keep[order], shard[order]
            raw, begin = data.tobytes(), words.start[start[keep]].tolist()
            end = words.end[start[keep] + count[keep] + width - 2].tolist()
            for a, b in zip(*_groups(shard)):
                some = keep[a:b]
                text = b"\n".join([raw[x:y] for x, y in zip(begin[a:b], end[a:b])])
                used, local = np.unique(row[some], return_inverse=True)
                out.append({
                    "part": int(shard[a]), "docs": _docs(ids[used], marks[used]),
                    "places": _planes(np.concatenate([local, in_doc[some], count[some]])), "text": press(text + b"\n")})
            yield pa.RecordBatch.from_pylist(out, _DEALT)
    return run


def repeated_windows(sequences: np.ndarray, offsets: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """For every window of word sequences, the smallest owner (document id) of a sequence that
    holds it, by matching statistics against the index of all of them."""
    distinct, code = np.unique(sequences, return_inverse=True)
    symbols = code + 1
    index = FmIndex(symbols, offsets, len(distinct) + 1, width)
    count = np.maximum(np.diff(offsets) - width + 1, 0)
    end = ragged(offsets[:-1] + width, count)
    # what occurs once is found at its own place: only what occurs again is followed
    length, low, high = index.matching_statistics(symbols, np.repeat(offsets[:-1], count), end, occurrences=2)
    result = np.repeat(owner, count)
    whole = np.flatnonzero(length == width)
    holders = owner[index.owner[index.suffixes]]
    # full-length intervals are equal or disjoint
    begin, first, same = np.unique(low[whole], return_index=True, return_inverse=True)
    if len(begin):
        stop = high[whole][first]
        cuts = np.stack([begin, stop], 1).ravel()
        if cuts[-1] == len(holders):
            cuts = cuts[:-1]
        result[whole] = np.minimum.reduceat(holders, cuts)[::2][same]
    return result


def _search(shards: int, parts: int, width: int, hot: np.ndarray):
    """One shard: reports on its windows. Reports made before pass through."""
    def run(table: pa.Table) -> pa.Table:
        import zstandard

        give_back()
        rows = table.to_pylist()
        if rows[0]["part"] < 0:
            return pa.Table.from_pylist([r | {"part": -1 - r["part"]} for r in rows], _DEALT)
        expand = zstandard.ZstdDecompressor().decompress
        docs = [_ids_and_marks(r["docs"]) for r in rows]
        base = np.cumsum([0] + [len(d[0]) for d in docs])
        ids, marks = (np.concatenate([d[i] for d in docs]) for i in range(2))
        places = [_numbers(r["places"]).reshape(3, -1) for r in rows]
        doc, start, count = (np.concatenate([p[i] + (b if i == 0 else 0) for p, b in zip(places, base)]) for i in range(3))
        data = np.frombuffer(b"".join(expand(r["text"]) for r in rows), np.uint8)
        words = hash_words(data, np.array([0, len(data)]))
        size = count + width - 1
        first = np.cumsum(size) - size
        # anchors in one document only can repeat nothing
        grams = windows(words.hash, ANCHOR)
        anchor = grams[first]
        for i in range(1, width - ANCHOR + 1):
            anchor = np.minimum(anchor, grams[first + i])
        anchor = _anchor_marks(anchor)
        # windows of a hot anchor came alone
        single = np.flatnonzero(_is_hot(anchor, hot))
        anchor[single] = sequence_marks(words.hash, first[single], first[single] + width)
        order = np.lexsort((ids[doc], anchor))
        begin, stop = _groups(anchor[order])
        several = ids[doc[order[begin]]] < ids[doc[order[stop - 1]]]
        keep = np.sort(order[np.repeat(several, stop - begin)])
        if not len(keep):
            return _DEALT.empty_table()
        doc, start, count, first, size = doc[keep], start[keep], count[keep], first[keep], size[keep]
        # equal segments are indexed once, under the smallest document
        content = sequence_marks(words.hash, first, first + size)
        order = np.lexsort((ids[doc], content))
        begin, stop = _groups(content[order])
        chosen = order[begin]
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(begin)), stop - begin)
        sequences = words.hash[ragged(first[chosen], size[chosen])]
        offsets = np.concatenate([[0], np.cumsum(size[chosen])])
        least = repeated_windows(sequences, offsets, ids[doc[chosen]], width)
        at = np.cumsum(count[chosen]) - count[chosen]
        hit = least[ragged(at[which], count)] < np.repeat(ids[doc], count)
        # runs of reported windows of each segment
        entry = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(hit)) - np.repeat(np.cumsum(count) - count, count)
        head = hit.copy()
        head[1:] &= ~hit[:-1] | (entry[1:] != entry[:-1])
        tail = hit.copy()
        tail[:-1] &= ~hit[1:] | (entry[1:] != entry[:-1])
        head, tail = np.flatnonzero(head), np.flatnonzero(tail)
        if not len(head):
            return _DEALT.empty_table()
        return pa.Table.from_pylist(_report_rows(
            ids, marks, doc[entry[head]], start[entry[head]] + within[head], tail - head + 1, parts, 1), _DEALT)
    return run


PACKED = "part int, rows binary, text binary, others binary"
_PACKED = pa.schema([("part", pa.int32()), ("rows", pa.binary()), ("text", pa.binary()), ("others", pa.binary())])


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _pack_texts(parts: int, others: list[str]):
    """Whole texts by part of documents. Texts without id are dealt by their number."""
    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1).compress
        for batch in slices(batches, 10_000, BATCH_BYTES):
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            marks = _marks(batch.column("text"))
            data, offsets = text_buffer(batch.column("text"))
            size = np.diff(offsets)
            part = np.where(known, _part_of(ids, parts), np.arange(len(ids)) % parts)
            order = np.argsort(part, kind="stable")
            out = []
            for a, b in zip(*_groups(part[order])):
                some = order[a:b]
                out.append({
                    "part": int(part[some[0]]),
                    "rows": _docs(ids[some], marks[some]) + size[some].astype("<i8").tobytes() + known[some].astype("u1").tobytes(),
                    "text": press(data[ragged(offsets[some], size[some])].tobytes()),
                    "others": press(_to_bytes(batch.select(others).take(pa.array(some)))) if others else None})
            yield pa.RecordBatch.from_pylist(out, _PACKED)
    return run


def _cut(keep_text: bool, others: list[str], width: int):
    """One part of documents: texts without the words that reported windows cover."""
    def run(texts: pa.Table, reports: pa.Table) -> pa.Table:
        import zstandard

        give_back()
        expand = zstandard.ZstdDecompressor().decompress
        found: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        for r in reports.to_pylist():
            ids, marks = _ids_and_marks(r["docs"])
            local, start, count = _numbers(r["places"]).reshape(3, -1)
            edge, stop = _groups(local)  # packed in order of documents
            for a, b in zip(edge, stop):
                found.setdefault((int(ids[local[a]]), int(marks[local[a]])), []).append((start[a:b], count[a:b]))
        out, kept_columns = [], []
        for r in texts.to_pylist():
            if others:
                kept_columns.append(pa.ipc.open_stream(expand(r["others"])).read_all())
            n = len(r["rows"]) // 25
            ids, marks = _ids_and_marks(r["rows"][:16 * n])
            size = np.frombuffer(r["rows"], "<i8", n, 16 * n)
            known = np.frombuffer(r["rows"], "u1", n, 24 * n)
            text, at = expand(r["text"]), 0
            for i in range(n):
                raw = text[at:at + int(size[i])]
                at += int(size[i])
                words = raw.split()
                kept = words
                spans = found.get((int(ids[i]), int(marks[i]))) if known[i] else None
                if spans:
                    cover = np.zeros(len(words) + 1, np.int64)
                    for start, count in spans:
                        np.add.at(cover, start, 1)
                        np.add.at(cover, start + count + width - 1, -1)
                    kept = list(compress(words, (np.cumsum(cover[:-1]) == 0).tolist()))
                joined = b" ".join(kept)
                row = [int(ids[i]) if known[i] else None, len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest()]
                # a text that loses nothing keeps its own white space
                out.append((*row, (joined if spans else raw).decode()) if keep_text else row)
        names, kinds = ["doc_id", "n_words", "n_removed", "kept_sha256"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if keep_text:
            names, kinds = [*names, "text"], [*kinds, pa.string()]
        columns = list(zip(*out)) or [()] * len(names)
        made = pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        for name in others if kept_columns else []:
            made = made.append_column(name, pa.concat_tables(kept_columns).column(name))
        return made
    return run


@on_workers
def remove_repeats(docs: DataFrame, width: int = WIDTH, keep_text: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and, if asked for, the kept text) per row, and
    the columns ``keep`` as they were.

    A word goes if a window of ``width`` words that covers it has a word sequence that also
    starts in a document with a smaller doc_id. All windows are judged on the input. Words are
    runs of other bytes than space and the controls 9 to 13, and are compared by 64-bit hashes.
    A null text has no word. A row without doc_id loses nothing and takes nothing from others;
    rows of one doc_id take nothing from each other, repeated rows lose the same. The kept text
    is the kept words joined by one space where anything was removed, else the text as it was
    (a null text comes back empty).
    """
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    parts = parts_of(docs, SHARD_BYTES)
    counted = texts.mapInArrow(_count_anchors(width), ANCHORS).groupBy("anchor").agg(F.sum("segments").alias("segments"))
    hot = counted.filter(F.col("segments") > SHARD_BYTES // HOT_PART).select("anchor").collect()
    hot = np.sort(np.array([r.anchor for r in hot], np.int64).view(_U))
    reports = texts.mapInArrow(_deal(parts, parts, width, hot), DEALT).groupBy("part").applyInArrow(_search(parts, parts, width, hot), DEALT)
    # kept columns travel under names of their own
    others = [f"keep_{i}" for i in range(len(keep))]
    whole = docs.select(F.col("doc_id").cast("long"), "text", *[F.col(c).alias(o) for c, o in zip(keep, others)])
    packed = whole.mapInArrow(_pack_texts(parts, others), PACKED)
    types = dict(docs.dtypes)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if keep_text else "")
    schema += "".join(f", {o} {types[c]}" for c, o in zip(keep, others))
    cut = packed.groupBy("part").cogroup(reports.select("part", "docs", "places").groupBy("part")).applyInArrow(_cut(keep_text, others, width), schema)
    return cut.withColumnsRenamed(dict(zip(others, keep)))
