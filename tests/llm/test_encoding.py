"""Token files and BPE against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from farewheel.llm import rank_array_bpe, token_planes

BYTES, WORDS = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
LETTERS = [*"abcdefgHIJ'stvml 'd  \n\t.,!?0123é́ßΣσς 　İ漢字🙂‍", "<|endoftext|>", "<|startoftext|>", "<|", "don't", "SHE'LL", ".,. ", "9!"]


def texts(n=1500, seed=4):
    rnd = random.Random(seed)
    some = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 60))) for _ in range(n)]
    long = ["".join(rnd.choice("abcde") for _ in range(rnd.randint(20, 600))) for _ in range(60)]
    return [*some, *long, "", "x" * 5000, "ab" * 3000, "the " * 500 + "x", "\n a\n  b", "ΟΔΟΣ Ångström"]


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(5)
    for n in (0, 1, 7, 8, 1000, 4097):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert (token_planes.from_planes(token_planes.to_planes(ids, bits), n) == ids).all()
    lengths = rng.integers(0, 90, 100)
    ids = rng.integers(0, 50_000, lengths.sum(), dtype=np.uint32)
    docs = [None if i % 9 == 0 else i - 5 for i in range(100)]
    file = token_planes.PlaneFile(token_planes.encode_file(ids, docs, lengths, bits, block=64))
    assert [x.tolist() for _, x in file.documents()] == [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])]
    assert [int(d) if k else None for d, k in zip(file.doc_ids, file.known)] == docs
    assert file.ids_between(100, 1000).tolist() == ids[100:1000].tolist()
    with pytest.raises(ValueError):
        token_planes.PlaneFile(b"x" * 100)


def test_token_files_equal_the_library(spark, docs, clashing, odd):
    rows = [*enumerate(texts(300), 100), *odd]
    library = Tokenizer.from_file(BYTES)
    got = token_planes.write_and_read(clashing(*rows), BYTES, end_id=2).orderBy("start", "n_tokens").collect()
    wanted, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        wanted.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    # rows of one id are ordered by text, as Spark orders strings
    assert sorted((r[0] or -1, r[2], r[3]) for r in got) == sorted((r[0] or -1, r[2], r[3]) for r in wanted)
    assert [tuple(r) for r in got if r.doc_id and r.doc_id >= 100] == [r for r in wanted if r[0] and r[0] >= 100]
    assert token_planes.write_and_read(docs(*odd).limit(0), BYTES, end_id=2).count() == 0


def test_files_end_between_documents(spark, docs, tmp_path):
    rows = [(i, "word " * (i % 50)) for i in range(200)]
    token_planes.write_ids(docs(*rows), BYTES, str(tmp_path / "ids"), file_ids=300)
    files = spark.read.parquet(str(tmp_path / "ids"))
    assert files.count() > 5
    library = Tokenizer.from_file(BYTES)
    got = {r.doc_id: r.ids for r in token_planes.read_ids(files).collect()}
    assert got == {d: library.encode(t, add_special_tokens=False).ids for d, t in rows}


def test_bpe_equals_the_library(spark, docs, clashing, odd):
    rows = [*enumerate(texts(), 100), *odd]
    library = Tokenizer.from_file(WORDS)
    coded = [library.encode(t or "", add_special_tokens=False).ids for _, t in rows]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = sorted((d or -1, len(i), sha(" ".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for (d, _), i in zip(rows, coded))
    got = rank_array_bpe.bpe_encode(clashing(*rows), WORDS, digests=True).collect()
    assert sorted((r[0] or -1, *r[1:]) for r in got) == wanted
    both = rank_array_bpe.bpe_encode(docs(*rows), WORDS)
    back = rank_array_bpe.bpe_decode(both.withColumnRenamed("decoded", "was"), WORDS, keep=("doc_id", "was"))
    assert all(r.was == r.decoded for r in back.collect())
    assert rank_array_bpe.bpe_encode(docs(*odd).limit(0), WORDS).count() == 0


def test_the_three_ways_agree():
    bpe = rank_array_bpe.Bpe(WORDS)
    rnd = random.Random(6)
    for _ in range(200):
        word = bytes(rnd.choice(b"abcdefghinorst\xc3\xa9") for _ in range(rnd.randint(1, 30)))
        assert bpe.encode_words([word])[0] == bpe._scan(word) == bpe._heap(word)
