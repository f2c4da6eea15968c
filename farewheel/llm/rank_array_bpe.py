"""BPE encoding and decoding with contiguous rank arrays.

A word is held as the array of its parts and the array of the merge ranks of neighbouring
parts. The smallest rank is looked for again and again; its boundary is deleted, both arrays
close up, and the two ranks beside it are refreshed. Short words of a batch are the rows of
one matrix, so that every step works on all of them; words above SHORT parts hold the same
arrays one by one, and above LONG the scan is replaced by a heap of ranks, which makes the
same merges in the same order.

Each task encodes every distinct piece of a batch once and keeps a bounded number of pieces
for the next batches. No shuffle takes place.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from farewheel.llm.shipping import on_workers
from farewheel.llm.words import TokenMemory, hash_pieces, ragged, slices

SHORT, LONG = 32, 256
_NONE = np.int32(2**31 - 1)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: printable Latin-1 for itself, the
    others in order from code point 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(own) else chr(next(rest)) for b in range(256)]


class Bpe:
    """Vocabulary and merges of a tokenizer file whose words end in a suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([self.vocab[a] for a, _ in pairs], np.int64)
        right = np.array([self.vocab[b] for _, b in pairs], np.int64)
        made = np.array([self.vocab[a + b] for a, b in pairs], np.int32)
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made
        self.rank_of = dict(zip(keys.tolist(), range(len(keys))))
        letters = byte_letters()
        self.inner = np.array([self.vocab[c] for c in letters], np.int32)
        self.final = np.array([self.vocab[c + self.suffix] for c in letters], np.int32)

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _short(self, words: list[bytes], width: int) -> list[list[int]]:
        n = np.array([len(w) for w in words])
        raw = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(-1, width)
        parts = self.inner[raw]
        row = np.arange(len(words))
        parts[row, n - 1] = self.final[raw[row, n - 1]]
        column = np.arange(width)
        ranks = np.full((len(words), width), _NONE)
        ranks[:, :-1] = self._look_up(parts[:, :-1], parts[:, 1:])
        ranks[column >= n[:, None] - 1] = _NONE
        done_parts, count = np.zeros_like(parts), n.copy()
        live = row
        while len(live):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(live)), at]
            over = best == _NONE
            if over.any():
                done_parts[live[over]] = parts[over]
                keep = ~over
                live, parts, ranks, at, best = live[keep], parts[keep], ranks[keep], at[keep], best[keep]
                if not len(live):
                    break
            here = np.arange(len(live))
            count[live] -= 1
            close = np.minimum(column + (column > at[:, None]), width - 1)
            parts = np.take_along_axis(parts, close, 1)
            parts[here, at] = self.made[best]
            # the boundary behind the merged part goes; its neighbours get new ranks
            ranks = np.take_along_axis(ranks, np.minimum(column + (column >= at[:, None]), width - 1), 1)
            ranks[:, -1] = _NONE
            has = at + 1 < count[live]
            after = self._look_up(parts[here, at], parts[here, np.minimum(at + 1, width - 1)])
            ranks[here, at] = np.where(has, after, _NONE)
            before = np.flatnonzero(at > 0)
            ranks[before, at[before] - 1] = self._look_up(parts[before, at[before] - 1], parts[before, at[before]])
        return [p[:k] for p, k in zip(done_parts.tolist(), count.tolist())]

    def _parts(self, word: bytes) -> list[int]:
        return [*self.inner[np.frombuffer(word[:-1], np.uint8)].tolist(), int(self.final[word[-1]])]

    def _scan(self, word: bytes) -> list[int]:
        parts, rank_of = self._parts(word), self.rank_of
        rank = lambda i: rank_of.get(parts[i] << 20 | parts[i + 1], _NONE) if i + 1 < len(parts) else _NONE
        ranks = [rank(i) for i in range(len(parts))]
        while (best := min(ranks)) != _NONE:
            at = ranks.index(best)
            parts[at] = int(self.made[best])
            del parts[at + 1], ranks[at + 1]
            ranks[at] = rank(at)
            if at:
                ranks[at - 1] = rank(at - 1)
        return parts

    def _heap(self, word: bytes) -> list[int]:
        parts, rank_of = self._parts(word), self.rank_of
        n = len(parts)
        behind, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank_of.get(parts[i] << 20 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = behind[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[rank]), -1
            behind[i] = behind[j]
            if behind[j] < n:
                ahead[behind[j]] = i
            for k in (ahead[i], i):
                if k >= 0 and behind[k] < n:
                    pair = parts[k], parts[behind[k]]
                    if (r := rank_of.get(pair[0] << 20 | pair[1])) is not None:
                        heapq.heappush(heap, (r, k, *pair))
        return [p for p in parts if p >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word; a word is a non-empty byte string without its suffix."""
        out: list[list[int]] = [[]] * len(words)
        size = [len(w) for w in words]
        for low, high in ((0, 8), (8, 16), (16, SHORT)):
            own = [i for i, k in enumerate(size) if low < k <= high]
            for at in range(0, len(own), 1 << 16):
                some = own[at:at + (1 << 16)]
                for i, ids in zip(some, self._short([words[i] for i in some], high)):
                    out[i] = ids
        for i, k in enumerate(size):
            if k > SHORT:
                out[i] = self._scan(words[i]) if k <= LONG else self._heap(words[i])
        return out

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by one space, special ones included: the file names no decoder."""
        return " ".join(self.token[i] for i in ids)


class TextCoder:
    """Normalises, splits and encodes whole texts."""

    # Fixed value: how the tokenizer file cuts normalised text into words.
    WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex

        self.bpe = Bpe(path)
        self.word = regex.compile(self.WORD)
        self.mark = regex.compile("|".join(map(regex.escape, self.bpe.special))) if self.bpe.special else None
        self.memory = TokenMemory(self._pieces)
        self.number = Pool([b"%d " % i for i in range(len(self.bpe.token))])
        self.letters = Pool([self.bpe.token[i].encode() + b" " for i in range(len(self.bpe.token))])

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            # one letter at a time, so the final sigma is as any other
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def _pieces(self, texts: list[str]) -> list[list[int]]:
        """Ids of pieces of normalised text."""
        words = [[t.encode()] if t.isascii() and t.isalpha() else [w.encode() for w in self.word.findall(t)] for t in texts]
        distinct = list({w for ws in words for w in ws})
        ids = dict(zip(distinct, self.bpe.encode_words(distinct)))
        return [ids[ws[0]] if len(ws) == 1 else [i for w in ws for i in ids[w]] for ws in words]

    def _marked(self, text: str) -> list[int]:
        """Ids of a text that names special tokens."""
        ids, at = [], 0
        for m in self.mark.finditer(text):
            ids += [*self._pieces([self.normal(text[at:m.start()])])[0], self.bpe.special[m[0]]]
            at = m.end()
        return ids + self._pieces([self.normal(text[at:])])[0]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the n+1 offsets of the texts in them."""
        texts = [t or "" for t in texts]
        marked = [i for i, t in enumerate(texts) if self.mark and "<" in t and self.mark.search(t)]
        raw = [self.normal(t).encode() for t in texts]
        for i in marked:
            raw[i] = b""
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        data = np.frombuffer(b"".join(raw), np.uint8)
        ids, at = self.memory.tokens(data, *hash_pieces(data, offsets))
        if marked:
            own = np.split(ids, at[1:-1])
            for i in marked:
                own[i] = np.array(self._marked(texts[i]), np.uint32)
            ids, at = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        return ids, at


class Pool:
    """Byte strings by number, joined in bulk."""

    def __init__(self, strings: list[bytes]):
        self.size = np.array([len(s) for s in strings])
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer(b"".join(strings), np.uint8)

    def join(self, ids: np.ndarray, at: np.ndarray) -> list[memoryview]:
        """For each text the strings of its ids in a row, without the last byte."""
        size = self.size[ids]
        out = memoryview(self.flat[ragged(self.start[ids], size)])
        ends = np.concatenate([[0], np.cumsum(size)])[at].tolist()
        return [out[a:max(a, b - 1)] for a, b in zip(ends, ends[1:])]


@lru_cache(maxsize=2)
def _coder(path: str) -> TextCoder:
    return TextCoder(path)


SCHEMA = "n_tokens long, ids binary, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def _encoded(path: str, column: str, keep: list[str], digests: bool, with_ids: bool = False):
    def run(batches):
        coder = _coder(path)
        for batch in slices(batches, 10_000, 1 << 20):
            ids, at = coder.encode(batch.column(column).to_pylist())
            texts = coder.letters.join(ids, at)
            if digests:
                first = [hashlib.sha256(x).hexdigest() for x in coder.number.join(ids, at)]
                second = [hashlib.sha256(x).hexdigest() for x in texts]
            else:
                first = [x.tobytes() for x in np.split(ids.astype("<u4"), at[1:-1])]
                second = [str(x, "utf-8") for x in texts]
            made = [pa.array(np.diff(at), pa.int64()), pa.array(first, pa.string() if digests else pa.binary()), pa.array(second, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"] if digests else ["n_tokens", "ids", "decoded"]
            if digests and with_ids:
                made.append(pa.array([x.tobytes() for x in np.split(ids.astype("<u4"), at[1:-1])], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], [*keep, *names])
    return run


@on_workers
def bpe_encode(docs: DataFrame, tokenizer: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), digests: bool = False, with_ids: bool = False) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and decoded text of every whole text.

    ``tokenizer`` is the path of the tokenizer file on every executor. A null or empty text
    has no token and decodes to an empty string; each row is encoded for itself, so repeated
    rows and ids stay as they are. Other columns than ``keep`` are dropped, whatever their names.
    With ``digests``, hashes take the place of ids and text: of the decimal ids joined by one
    space, and of the decoded text; ``with_ids`` adds the ids to them.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.select(*keep, F.col(text).alias("_text")).mapInArrow(
        _encoded(tokenizer, "_text", list(keep), digests, with_ids), f"{schema}, {DIGESTS if digests else SCHEMA}" + (", ids binary" if digests and with_ids else ""))


@on_workers
def bpe_decode(encoded: DataFrame, tokenizer: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Text of each row of little-endian unsigned 32-bit ids; null ids decode to an empty string."""
    def run(batches):
        bpe = _coder(tokenizer).bpe
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x, "<u4").tolist()) if x else "" for x in batch.column("_ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(texts, pa.string())], [*keep, "decoded"])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in keep)
    return encoded.select(*keep, F.col(ids).alias("_ids")).mapInArrow(run, f"{schema}, decoded string")
