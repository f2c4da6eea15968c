"""Words and pieces of whole Arrow text columns as numpy arrays.

A word is a maximal run of bytes other than space and the controls 9 to 13. UTF-8 keeps
those six values out of longer characters, so bytes can be scanned without decoding.
"""

from __future__ import annotations

import ctypes
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240229).integers(1, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = {_BASE: np.ones(1, _U), _INVERSE: np.ones(1, _U)}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and doubled when too short."""
    table = _POWERS[base]
    while len(table) < n:
        table = np.concatenate([table, table * _U(pow(base, len(table), 2**64))])
    _POWERS[base] = table
    return table[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a text column and the n+1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0]:ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


@dataclass
class Words:
    """Words of several texts: byte ranges, hashes, and the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    prefix: np.ndarray | None  # hash of the first ``prefix_bytes`` bytes
    first: np.ndarray          # n+1 positions into the words

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """Text number of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def _cuts(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Chunk borders near every CHUNK bytes that split no word."""
    cuts, at = [0], 0
    while at < len(data):
        at = min(at + CHUNK, len(data))
        border = int(offsets[np.searchsorted(offsets, at)])
        while at < border:
            space = np.flatnonzero(_SPACE[data[at:min(at + CHUNK, border)]])
            if len(space):
                border = at + int(space[0])
                break
            at = min(at + CHUNK, border)
        at = border
        cuts.append(at)
    return cuts


def hash_words(data: np.ndarray, offsets: np.ndarray, prefix_bytes: int = 0) -> Words:
    """Every word with a 64-bit polynomial hash, in memory of a few chunks beside the result."""
    parts: list[tuple] = []
    cuts = _cuts(data, offsets)
    for a, b in zip(cuts, cuts[1:]):
        chunk = data[a:b]
        word = ~_SPACE[chunk]
        breaks = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        starts = word.copy()
        starts[1:] &= ~word[:-1]
        starts[breaks[word[breaks]]] = True
        start = np.flatnonzero(starts)
        ends = word.copy()
        ends[:-1] &= ~word[1:]
        inner = breaks[breaks > 0] - 1
        ends[inner[word[inner]]] = True
        end = np.flatnonzero(ends) + 1
        sums = np.zeros(len(chunk) + 1, _U)
        np.cumsum(_BYTE[chunk] * _powers(_BASE, len(chunk)), out=sums[1:])
        shift = _powers(_INVERSE, len(chunk))[start]
        value = mix((sums[end] - sums[start]) * shift + (end - start).astype(_U) * _U(_BASE))
        head = None
        if prefix_bytes:
            stop = np.minimum(end, start + prefix_bytes)
            head = mix((sums[stop] - sums[start]) * shift + _U(0x5851F42D4C957F2D))
        parts.append((start + a, end + a, value, head))
    if not parts:
        none, no = np.zeros(0, np.int64), np.zeros(0, _U)
        return Words(none, none, no, no if prefix_bytes else None, np.zeros(len(offsets), np.int64))
    start, end, value = (np.concatenate([p[i] for p in parts]) for i in range(3))
    head = np.concatenate([p[3] for p in parts]) if prefix_bytes else None
    return Words(start, end, value, head, np.searchsorted(start, offsets))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def windows(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of every ``width`` consecutive entries; those that cross texts are to be ignored."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = np.full(n, _U((seed * 0x9E3779B97F4A7C15 + width) % 2**64))
    for i in range(width):
        out = out * _U(0xD6E8FEB86659FD93) + hashes[i:i + n]
    return mix(out)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges starts[i] .. starts[i]+lengths[i]-1."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)


_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,!?;:$%&#*"]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def hash_pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """Texts cut at every space, and once more where plain letters or digits are followed by
    nothing but punctuation. Also whether a space stands before each piece; the hash tells
    that apart. Between two neighbouring spaces there is no piece."""
    parts: list[tuple] = []
    cuts = _cuts(data, offsets)
    for a, b in zip(cuts, cuts[1:]):
        chunk = data[a:b]
        inside = chunk != 32
        breaks = offsets[np.searchsorted(offsets, a):np.searchsorted(offsets, b)] - a
        starts = inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[breaks[inside[breaks]]] = True
        start = np.flatnonzero(starts)
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        inner = breaks[breaks > 0] - 1
        ends[inner[inside[inner]]] = True
        end = np.flatnonzero(ends) + 1
        spaced = np.zeros(len(start), bool)
        later = start > 0
        spaced[later] = chunk[start[later] - 1] == 32
        if a and len(start) and start[0] == 0:
            spaced[0] = data[a - 1] == 32
        spaced[np.isin(start, breaks)] = False
        tail = end.copy()
        open_ = np.flatnonzero(_TAIL[chunk[end - 1]])
        while len(open_):
            tail[open_] -= 1
            open_ = open_[tail[open_] > start[open_]]
            open_ = open_[_TAIL[chunk[tail[open_] - 1]]]
        cut = (tail < end) & (tail > start)
        cut[cut] = _PLAIN[chunk[tail[cut] - 1]]
        twice = 1 + cut
        second = np.cumsum(twice)[cut] - 1
        start, end, spaced = (np.repeat(x, twice) for x in (start, end, spaced))
        start[second], spaced[second], end[second - 1] = tail[cut], False, tail[cut]
        sums = np.zeros(len(chunk) + 1, _U)
        np.cumsum(_BYTE[chunk] * _powers(_BASE, len(chunk)), out=sums[1:])
        value = mix((sums[end] - sums[start]) * _powers(_INVERSE, len(chunk))[start] + (2 * (end - start) + spaced).astype(_U) * _U(_BASE))
        parts.append((start + a, end + a, value, spaced))
    if not parts:
        none, no = np.zeros(0, np.int64), np.zeros(0, _U)
        return Words(none, none, no, None, np.zeros(len(offsets), np.int64)), np.zeros(0, bool)
    start, end, value, spaced = (np.concatenate([p[i] for p in parts]) for i in range(4))
    return Words(start, end, value, None, np.searchsorted(start, offsets)), spaced


class TokenMemory:
    """Token ids of pieces, found by hash. When ``most`` pieces are kept, it starts anew."""

    def __init__(self, encode, most: int = 300_000):
        self.encode, self.most = encode, most
        self._clear()

    def _clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.size, self.at, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def tokens(self, data: np.ndarray, words: Words, spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in order, and the n+1 offsets of the texts in them."""
        distinct, where, code = np.unique(words.hash, return_index=True, return_inverse=True)
        if len(self.slot) + len(distinct) > self.most:
            self._clear()
        slots = np.fromiter((self.slot.get(h, -1) for h in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(slots < 0)
        if len(new):
            raw, first = data.tobytes(), where[new]
            texts = [(" " if space else "") + raw[s:e].decode() for s, e, space in zip(words.start[first].tolist(), words.end[first].tolist(), spaced[first].tolist())]
            ids = self.encode(texts)
            size = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
            slots[new] = len(self.size) + np.arange(len(new))
            self.slot.update(zip(distinct[new].tolist(), slots[new].tolist()))
            self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(size) - size])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
        slots = slots[code]
        size = self.size[slots]
        ids = self.flat[ragged(self.at[slots], size)]
        return ids, np.concatenate([[0], np.cumsum(size)])[words.first]


def give_back() -> None:
    """Return freed memory to the system. A worker process outlives its task, and what its
    allocators keep would count against the executor while others work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches, rows: int = 2000, size: int = 4 << 20):
    """Record batches cut so that each has at most ``rows`` rows and about ``size`` bytes."""
    for batch in batches:
        step = max(1, min(rows, math.ceil(size * batch.num_rows / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
        give_back()
