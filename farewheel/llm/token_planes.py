"""Token ids on disk in bit-plane shuffled blocks.

A file holds the ids of whole documents. They are cut into blocks of BLOCK ids; a block is
transposed into byte planes (all first bytes, all second bytes, ...) or bit planes, each plane
is compressed with zstandard, and a chunk index tells where every plane lies. A document index
(ids of documents and their lengths) follows, so a file can be read on its own and any
document found without decoding the blocks before it.

Documents are range-partitioned and sorted by doc_id. Tasks encode one file after the other
and hand the bytes to Spark's writer, which commits them once even if a task is repeated, on
any file system the session reaches. Reading needs no shuffle.
"""

from __future__ import annotations

import os
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from farewheel.llm.shipping import on_workers
from farewheel.llm.staging import parts_of
from farewheel.llm.words import TokenMemory, hash_pieces, slices
from farewheel.sources.storage import scratch_dir

BLOCK = 1 << 16          # ids in a block
FILE_IDS = 1 << 21       # a file ends after the first document that reaches so many
SHARD_BYTES = 32 << 20   # text of a partition
_MAGIC = b"IDPLANE1"
_HEAD = struct.Struct("<8sBIQQQ")  # magic, planes per block, block size, ids, documents, start of the indexes


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of little-endian 32-bit ids: 4 byte planes or 32 bit planes."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [p.tobytes() for p in np.packbits(np.unpackbits(raw, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    return [p.tobytes() for p in np.ascontiguousarray(raw.T)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        bits = np.unpackbits(np.frombuffer(b"".join(planes), np.uint8).reshape(32, -1), axis=1, bitorder="little")[:, :n]
        raw = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    else:
        raw = np.frombuffer(b"".join(planes), np.uint8).reshape(4, n).T
    return np.ascontiguousarray(raw).view("<u4").ravel()


def encode_file(ids: np.ndarray, doc_ids: list, lengths: np.ndarray, bits: bool = False, block: int = BLOCK) -> bytes:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    body, index, at = [], [], _HEAD.size
    for start in range(0, len(ids), block):
        for plane in to_planes(ids[start:start + block], bits):
            packed = press(plane)
            body.append(packed)
            index.append((at, len(packed)))
            at += len(packed)
    known = np.array([d is not None for d in doc_ids], bool)
    tail = press(b"".join([
        np.array(index, "<u8").tobytes(), np.packbits(known).tobytes(),
        np.array([d or 0 for d in doc_ids], "<i8").tobytes(), lengths.astype("<u8").tobytes(),
    ]))
    head = _HEAD.pack(_MAGIC, 32 if bits else 4, block, len(ids), len(doc_ids), at)
    return b"".join([head, *body, tail])


class PlaneFile:
    """A file's indexes; blocks are decoded when asked for."""

    def __init__(self, raw: bytes):
        import zstandard

        self.raw, self.expand = raw, zstandard.ZstdDecompressor().decompress
        magic, self.planes, self.block, self.n, docs, at = _HEAD.unpack_from(raw)
        if magic != _MAGIC:
            raise ValueError("not an id plane file")
        tail = self.expand(raw[at:])
        blocks = -(-self.n // self.block)
        cut = np.cumsum([0, blocks * self.planes * 16, -(-docs // 8), docs * 8, docs * 8]).tolist()
        self.index = np.frombuffer(tail[cut[0]:cut[1]], "<u8").reshape(blocks, self.planes, 2)
        self.known = np.unpackbits(np.frombuffer(tail[cut[1]:cut[2]], np.uint8))[:docs].astype(bool)
        self.doc_ids = np.frombuffer(tail[cut[2]:cut[3]], "<i8")
        self.lengths = np.frombuffer(tail[cut[3]:cut[4]], "<u8").astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def ids_of_block(self, number: int) -> np.ndarray:
        planes = [self.expand(self.raw[at:at + size]) for at, size in self.index[number].tolist()]
        return from_planes(planes, min(self.block, self.n - number * self.block))

    def ids_between(self, start: int, stop: int) -> np.ndarray:
        first, last = start // self.block, -(-stop // self.block)
        if start >= stop:
            return np.zeros(0, "<u4")
        some = np.concatenate([self.ids_of_block(i) for i in range(first, last)])
        return some[start - first * self.block:stop - first * self.block]

    def documents(self):
        """Position and ids of every document, in order; few blocks are held at a time."""
        held, held_from, number = np.zeros(0, "<u4"), 0, 0
        for i, (start, size) in enumerate(zip(self.starts.tolist(), self.lengths.tolist())):
            parts = [held[start - held_from:]]
            have = len(parts[0])
            while have < size:
                parts.append(self.ids_of_block(number))
                number += 1
                have += len(parts[-1])
            held, held_from = np.concatenate(parts) if len(parts) > 1 else parts[0], start
            yield i, held[:size]


@lru_cache(maxsize=2)
def _memory(path: str) -> TokenMemory:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    memory = TokenMemory(lambda texts: [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)], most=1_500_000)
    memory.tokenizer = tokenizer
    return memory


def encode_texts(path: str, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in order and the n+1 offsets of the texts in them.

    The byte-level tokenizer never joins what stands before a single space with what follows
    it, so the library encodes every distinct piece between spaces once. Texts in which two
    spaces meet are encoded as a whole.
    """
    memory = _memory(path)
    texts = [t or "" for t in texts]
    whole = [i for i, t in enumerate(texts) if "  " in t or t.endswith(" ")]
    raw = [t.encode() for t in texts]
    for i in whole:
        raw[i] = b""
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, at = memory.tokens(np.frombuffer(b"".join(raw), np.uint8), *hash_pieces(np.frombuffer(b"".join(raw), np.uint8), offsets))
    if whole:
        own = np.split(ids, at[1:-1])
        for i, e in zip(whole, memory.tokenizer.encode_batch([texts[i] for i in whole], add_special_tokens=False)):
            own[i] = np.array(e.ids, np.uint32)
        ids, at = np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
    return ids, at


FILES = "shard int, part int, n_ids long, n_docs long, payload binary"


def _write(tokenizer: str, end_id: int | None, bits: bool, file_ids: int):
    def run(batches):
        shard, part = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        docs, lengths, held = [], [], 0

        def flush():
            nonlocal ids, docs, lengths, held, part
            payload = encode_file(np.concatenate(ids), docs, np.array(lengths, np.int64), bits)
            row = pa.RecordBatch.from_pylist(
                [{"shard": shard, "part": part, "n_ids": held, "n_docs": len(docs), "payload": payload}],
                pa.schema([("shard", pa.int32()), ("part", pa.int32()), ("n_ids", pa.int64()), ("n_docs", pa.int64()), ("payload", pa.binary())]))
            ids, docs, lengths, held, part = [], [], [], 0, part + 1
            return row

        for batch in slices(batches, 10_000, 3 << 20):
            flat, at = encode_texts(tokenizer, batch.column("text").to_pylist())
            own = batch.column("doc_id").to_pylist()
            if end_id is not None:
                ends = at[1:]
                flat, at = np.insert(flat, ends, np.uint32(end_id)), at + np.arange(len(at))
            size = np.diff(at)
            begin = 0
            while begin < len(own):
                # up to and with the first document that fills the file
                stop = min(begin + int(np.searchsorted(np.cumsum(size[begin:]), file_ids - held)) + 1, len(own))
                ids.append(flat[at[begin]:at[stop]])
                docs += own[begin:stop]
                lengths += size[begin:stop].tolist()
                held += int(at[stop] - at[begin])
                begin = stop
                if held >= file_ids:
                    yield flush()
        if docs:
            yield flush()
    return run


@on_workers
def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = None, bits: bool = False, file_ids: int = FILE_IDS) -> None:
    """Encode every whole text in ascending doc_id order and write the files to ``path``.

    A null text counts as empty; with ``end_id`` every document, empty ones too, ends with that
    id. Rows without doc_id come last; rows of one doc_id are ordered by text. Other columns
    are not read. An empty table writes no file.
    """
    shards = parts_of(docs, SHARD_BYTES)
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc_nulls_first()]
    (
        docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(shards, order[0]).sortWithinPartitions(*order)
        .mapInArrow(_write(tokenizer, end_id, bits, file_ids), FILES).write.parquet(path)
    )


def _digests(batches):
    for batch in batches:
        for row in batch.to_pylist():
            file = PlaneFile(row["payload"])
            crc = [zlib.crc32(ids.tobytes()) for _, ids in file.documents()]
            n = len(crc)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, row["shard"], np.int32)), pa.array(np.full(n, row["part"], np.int32)),
                pa.array(file.doc_ids.astype(np.int64), mask=~file.known),
                pa.array(file.starts), pa.array(file.lengths), pa.array(crc, pa.int64()),
            ], ["shard", "part", "doc_id", "start_in_file", "n_tokens", "ids_crc32"])


def _ids(batches):
    for batch in batches:
        for row in batch.to_pylist():
            file = PlaneFile(row["payload"])
            for i, ids in file.documents():
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(file.doc_ids[i]) if file.known[i] else None], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64())),
                ], ["doc_id", "ids"])


@on_workers
def read_ids(files: DataFrame) -> DataFrame:
    """The ids of every document, from files that ``write_ids`` wrote."""
    return files.select("payload").mapInArrow(_ids, "doc_id long, ids array<long>")


@on_workers
def read_positions(files: DataFrame) -> DataFrame:
    """Per document its first position in the whole sequence, its length and the CRC-32 of its
    ids as little-endian unsigned 32-bit integers. Ids before a file are summed over the
    (small) list of files."""
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("shard", "part", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("before"))
    docs = files.select("shard", "part", "payload").mapInArrow(
        _digests, "shard int, part int, doc_id long, start_in_file long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["shard", "part"]).select(
        "doc_id", (F.col("before") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def write_and_read(docs: DataFrame, tokenizer: str, end_id: int | None = None, bits: bool = False) -> DataFrame:
    """``write_ids`` to the shared folder, then ``read_positions``."""
    path = scratch_dir(docs.sparkSession, "token_planes")
    write_ids(docs, tokenizer, path, end_id, bits)
    return read_positions(docs.sparkSession.read.schema(FILES).parquet(path))
