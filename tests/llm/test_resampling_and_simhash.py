"""Importance resampling and SimHash near duplicates against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from compare import compare, connect
from farewheel.llm import importance_resampling as resampling, simhash_trie as simhash
from farewheel.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, longest):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def brute_resample(docs, target, longest=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source = Counter(bucket(f) for _, t in docs for f in features(t, longest)[1])
    wanted = Counter(bucket(f) for t in target for f in features(t, longest)[1])
    n_s, n_t = sum(source.values()), sum(wanted.values())
    rows = []
    for i, t in docs:
        words, found = features(t, longest)
        weight = sum(math.floor(1000 * math.log((wanted[b] + 1) * (n_s + buckets) / ((source[b] + 1) * (n_t + buckets)))) for b in map(bucket, found))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[:percent * len(able) // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_spans_overlap_and_stop_at_word_borders():
    line = resampling.collapsed("A1, b\x00c!!d É-ü漢 \n")
    assert line == "a1 b c d É ü漢".encode()  # letters beyond ASCII stay as they are
    two = [m[0].decode() for m in resampling.spans(2)[1].finditer(line, overlapped=True)]
    assert two == ["a1 b", "b c", "c d", "d É", "É ü漢"]
    assert [m[0] for m in resampling.spans(3)[2].finditer(b"x y", overlapped=True)] == []


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (2, 300), (3, 65_536)])
def test_resampling_equals_brute_force(spark, docs, clashing, odd, longest, buckets):
    rng = random.Random(longest)
    words = [f"w{i}" for i in range(60)] + ["Éa", "ß", "Z9"]
    many = [(100 + i, " ".join(rng.choices(words, k=rng.randrange(0, 80)))) for i in range(120)]
    rows = [*odd, *many, (50, "The end. " * 200_000)]  # a text of megabytes
    target = [" ".join(rng.choices(words[:9], k=50)), None, "", "z9 z9"]
    wanted = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(target)], "item_id long, text string, buckets string")
    got = resampling.resample(clashing(*rows), wanted, longest, buckets)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, target, longest, buckets)


def test_resampling_of_empty_tables_and_ties(spark, docs):
    target = spark.createDataFrame([("a b",)], "text string")
    rows = [(7, "same words " * 10)] * 30
    got = resampling.resample(docs(*rows), target).collect()
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3] and len({r.score for r in got}) == 1
    assert resampling.resample(docs(*rows).limit(0), target).count() == 0
    assert resampling.resample(docs(*rows), target.limit(0)).count() == 30
    with pytest.raises(ValueError):
        resampling.resample(docs(*rows), target, buckets=1 << 17)


def test_resampling_query_equals_sql(spark):
    name = "op12_importance_resampling"
    assert compare(QUERIES[name](spark, SF), connect(SF), ORACLE_SQL[name]) is None


def brute_print(text):
    words = (text or "").translate(LOWER).encode()
    words = [w for w in re.split(rb"[\x20\x09-\x0d]+", words) if w]
    shingles = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    marks = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(m >> b & 1 for m in marks) > len(marks))


def components_of(prints, budget):
    """Smallest index reachable from each."""
    label = list(range(len(prints)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    array = np.array(prints, np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= budget) + i + 1:
            a, b = find(i), find(int(j))
            label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def brute_simhash(rows, budget=3):
    prints = [brute_print(t) for _, t in rows]
    label = components_of(prints, budget)
    least = {}
    for (i, _), c in zip(rows, label):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f"{p:016x}", least.get(c)) for (i, _), p, c in zip(rows, prints, label)), key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 50])
def test_fingerprints_are_hashed_in_pieces(monkeypatch, chunk):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    rng = random.Random(chunk)
    for _ in range(40):
        text = "".join(rng.choices(["ab", "C", "É", " ", "\n", "\x0b ", "漢", "zzzz"], k=rng.randrange(0, 400)))
        hashes = simhash.shingle_hashes(text)
        assert int(simhash.majority(hashes, np.array([0, len(hashes)]))[0]) == brute_print(text)


def near(rng, value, bits):
    for b in rng.sample(range(64), bits):
        value ^= 1 << b
    return value


@pytest.mark.parametrize("most, budget", [(1 << 16, 3), (24, 3), (40, 2), (8, 0)])
def test_trie_join_equals_brute_force(spark, most, budget):
    """Families around common values, dense ones, and a hot block; with small tasks the large
    subtrees are opened in tables."""
    rng = random.Random(most + budget)
    values = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(8):
        middle = rng.getrandbits(64)
        values |= {near(rng, middle, rng.randrange(0, 5)) for _ in range(25)}
    values |= {(0xABCD << 48) | rng.getrandbits(9) << rng.randrange(0, 39) for _ in range(120)} | {0, (1 << 64) - 1, 1, 1 << 63}
    values = sorted(values)
    label = components_of(values, budget)
    entries = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "fingerprint long")
    from farewheel.llm.components import connected_components
    edges = simhash.near_entries(entries, budget, most)
    got = {r.id % (1 << 64): r.component for r in connected_components(edges).collect()}
    mine = {}
    for v, c in zip(values, label):
        mine.setdefault(c, set()).add(v)
    theirs = {}
    for v in values:
        theirs.setdefault(got.get(v, ("alone", v)), set()).add(v)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_trie_of_dense_entries_in_one_task():
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 1 << 13, 5000).astype(np.uint64))
    label = simhash.trie_components(values, tuple(np.array([x]) for x in (0, len(values), 0, len(values), 0)), 0, 3)
    assert (label == 0).all()
    far = np.array([0x0, 0xF, 0xF0, 0xFFFF], np.uint64)
    assert simhash.trie_components(far, tuple(np.array([x]) for x in (0, 4, 0, 4, 0)), 0, 3).tolist() == [0, 1, 2, 3]
    assert simhash.trie_components(far, tuple(np.array([x]) for x in (0, 4, 0, 4, 0)), 0, 4).tolist() == [0, 0, 0, 3]


def test_simhash_rows(spark, docs, clashing, odd):
    text = "the quick brown fox jumps over the lazy dog and runs away from it " * 5
    rows = [*odd, (30, text), (20, text + "now"), (21, text.upper()), (40, "long words " * 300_000), (None, "only one"), (None, "only one")]
    got = simhash.simhash_components(clashing(*rows))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute_simhash(rows)
    assert simhash.simhash_components(docs(*rows).limit(0)).count() == 0


def test_simhash_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op13_simhash_trie"](spark, SF).collect()
    assert sorted(map(tuple, got), key=repr) == brute_simhash(rows)
    assert len({r.component_id for r in got}) < len(rows)
