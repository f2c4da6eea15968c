"""Substring deduplication and the n-gram Jaccard join against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest

from farewheel.llm import components, fm_dedup, trie_join

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def joined(ids, edges):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {i: find(i) for i in ids}


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i:i + 5]) for i in range(len(words) - 4)}


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    edges = [(a, b) for i, (a, s) in enumerate(sets) for b, t in sets[:i]
             if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t)]
    roots = joined({d for d, _ in rows if d is not None}, edges)
    return sorted((-1 if d is None else d, len(s), -1 if d is None else roots[d]) for d, s in sets)


def near_copies(rnd, n, length=60, vocabulary=300):
    """Families of edited copies beside unrelated texts and texts that share a passage."""
    words = [f"w{i}" for i in range(vocabulary)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(5, length))] for _ in range(max(2, n // 12))]
    passage = [rnd.choice(words) for _ in range(25)]
    rows = []
    for i in range(n):
        text = list(rnd.choice(base)) if rnd.random() < 0.7 else [rnd.choice(words) for _ in range(rnd.randint(0, length))]
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
            if text:
                text[rnd.randrange(len(text))] = rnd.choice(words)
        if rnd.random() < 0.3:
            text = text + passage
        rows.append((i, rnd.choice([" ", "\n"]).join(text).replace("w1", rnd.choice(["w1", "W1"]))))
    return rows


def found(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_join_equals_brute_force(docs, clashing, odd, seed):
    rows = [(d + 100, t) for d, t in near_copies(random.Random(seed), 220)] + odd
    assert found(trie_join.jaccard_components(clashing(*rows))) == brute_components(rows)


def test_small_blocks_and_hot_shingles_give_the_same(docs, monkeypatch):
    rows = near_copies(random.Random(3), 160)
    for name, value in (("RANGE_SHINGLES", 500), ("BLOCK_DOCS", 4), ("MOST_BLOCKS", 2), ("HOT_LEAST", 3), ("HOT_SHARE", 40)):
        monkeypatch.setattr(trie_join, name, value)
    assert found(trie_join.jaccard_components(docs(*rows))) == brute_components(rows)


def test_a_wide_family_is_not_copied_by_every_shingle(docs, monkeypatch):
    """Above MOST_BLOCKS a list is placed by shingle only where that makes fewer copies of it."""
    for name, value in (("BLOCK_DOCS", 4), ("MOST_BLOCKS", 2)):
        monkeypatch.setattr(trie_join, name, value)
    placed, seen = trie_join._neighbourhoods, []

    def watched(*args):
        areas = placed(*args)
        seen.extend(areas.collect())
        return areas

    monkeypatch.setattr(trie_join, "_neighbourhoods", watched)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(120)]
    family = [(i, " ".join(base[:-1] + [f"x{i}"])) for i in range(40)]
    # every pair of twelve passages: few shingles in a head, each in few texts
    parts = [" ".join(f"p{i}x{j}" for j in range(12)) for i in range(12)]
    pairs = [(i, j) for i in range(12) for j in range(i)]
    tied = [(100 + k, f"{parts[i]} {parts[j]}") for k, (i, j) in enumerate(pairs)]
    rows = family + tied
    rnd.shuffle(rows)
    assert found(trie_join.jaccard_components(docs(*rows))) == brute_components(rows)
    assert {r.by for r in seen if r.doc_id < 100} == {0}
    copies = sum(r.blocks for r in seen if r.doc_id < 100)
    assert copies == 40 * 10
    assert any(r.by != 0 for r in seen)


def test_join_of_empty_tables(docs, odd):
    assert trie_join.jaccard_components(docs(*odd).limit(0)).count() == 0
    assert found(trie_join.jaccard_components(docs((1, None), (None, "x")))) == [(-1, 1, -1), (1, 0, 1)]


def test_threshold_is_met_exactly():
    exactly = [np.arange(6), np.array([0, 1, 2, 3, 4, 5, 6, 7])]          # 6 of 8
    below = [np.arange(5), np.array([0, 1, 2, 3, 4, 5, 6])]               # 5 of 7
    assert trie_join.links(exactly, [6, 8]) and not trie_join.links(below, [5, 7])


def test_trie_links_equal_brute_force():
    rnd = random.Random(5)
    for _ in range(150):
        universe = rnd.choice([8, 20, 60])
        base = [rnd.sample(range(universe), rnd.randint(1, min(universe, 25))) for _ in range(3)]
        sets = []
        for _ in range(rnd.randint(2, 25)):
            one = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 3)):
                one ^= {rnd.randrange(universe)}
            if one:
                sets.append(np.array(sorted(one)))
        size = [len(s) + rnd.randint(0, 2) for s in sets]
        true = {(i, j) for i in range(len(sets)) for j in range(i) if 7 * len({*sets[i]} & {*sets[j]}) >= 3 * (size[i] + size[j])}
        got = trie_join.links(sets, size)
        assert {(max(p), min(p)) for p in got} <= true and len(got) < max(1, len(sets))
        assert joined(range(len(sets)), got) == joined(range(len(sets)), true)
        half = len(sets) // 2
        across = {(i, j) for i, j in true if (i >= half) != (j >= half)}
        assert joined(range(len(sets)), trie_join.links(sets, size, half)) == joined(range(len(sets)), across)


def test_components(spark):
    rnd = random.Random(6)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)] + [(7, 7), (8, 9), (8, 9)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    wanted = joined({x for e in edges for x in e}, edges)
    assert all(got.get(i, i) == c for i, c in wanted.items()) and set(got) <= set(wanted)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, width=13):
    tokens = [(d, t, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, _, w in tokens:
        if d is not None:
            for i in range(len(w) - width + 1):
                key = tuple(w[i:i + width])
                least[key] = min(least.get(key, d), d)
    out = []
    for d, t, w in tokens:
        gone = [False] * len(w)
        for i in range(len(w) - width + 1 if d is not None else 0):
            if least[tuple(w[i:i + width])] < d:
                gone[i:i + width] = [True] * width
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((-1 if d is None else d, len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode() if any(gone) else t or ""))
    return sorted(out)


def passages(rnd, n):
    words = ["a", "b", "c", "dd", "Ee", "é"]
    base = [[rnd.choice(words) for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(rnd.randint(0, 4)):
            a = rnd.randint(0, 40)
            text += rnd.choice(base)[a:a + rnd.randint(5, 25)] if rnd.random() < 0.5 else [rnd.choice(words) for _ in range(rnd.randint(0, 30))]
        rows.append((rnd.choice([i, i, i, rnd.randint(0, n)]), rnd.choice([" ", "\n", " \t "]).join(text)))
    return rows


@pytest.mark.parametrize("size", [None, 600])
def test_repeats_equal_brute_force(docs, clashing, odd, monkeypatch, size):
    if size:
        monkeypatch.setattr(fm_dedup, "SHARD_BYTES", size)
        monkeypatch.setattr(fm_dedup, "BATCH_BYTES", 2000)
    rows = [(d + 100, t) for d, t in passages(random.Random(7), 90)] + odd
    got = fm_dedup.remove_repeats(clashing(*rows), keep_text=True, keep=("source", "n_chars")).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == brute_repeats(rows)
    assert all(r.source == "web" for r in got)
    assert sum(r.n_chars for r in got) == sum(len(t or "") for _, t in rows)


@pytest.mark.parametrize("passage", [13, 40])
def test_a_common_passage_fills_no_shard(docs, monkeypatch, tmp_path, passage):
    """Where the passage begins and ends, every document sends a segment of its own."""
    monkeypatch.setattr(fm_dedup, "SHARD_BYTES", 4000)
    monkeypatch.setattr(fm_dedup, "BATCH_BYTES", 20_000)
    rnd = random.Random(5)
    own = lambda n: [f"w{rnd.randrange(10**6)}" for _ in range(n)]
    common = own(passage)
    rows = [(i, " ".join(own(20) + common + own(20) if i % 3 else own(60))) for i in range(600)]
    search, folder = fm_dedup._search, str(tmp_path)

    def watched(*args):
        run = search(*args)

        def inner(table):
            if table.column("part")[0].as_py() >= 0:
                places = sum(len(x.as_py()) for x in table.column("places")) // 12
                with open(f"{folder}/{table.column('part')[0].as_py()}", "w") as f:
                    f.write(str(places))
            return run(table)
        return inner

    monkeypatch.setattr(fm_dedup, "_search", watched)
    got = fm_dedup.remove_repeats(docs(*rows), keep_text=True).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256, r.text) for r in got) == brute_repeats(rows)
    sizes = [int(p.read_text()) for p in tmp_path.iterdir()]
    assert len(sizes) > 30 and max(sizes) < 2 * np.median(sizes)


def test_repeats_of_empty_tables(docs, odd):
    assert fm_dedup.remove_repeats(docs(*odd).limit(0)).count() == 0


def test_index_against_brute_force():
    rnd = random.Random(8)
    for _ in range(40):
        width = rnd.choice([1, 2, 3, 5])
        texts = [[rnd.randint(1, 4) for _ in range(rnd.randint(1, 30))] for _ in range(rnd.randint(1, 12))]
        flat = np.array([x for t in texts for x in t])
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        index = fm_dedup.FmIndex(flat, offsets, 6, width)
        query = np.array([rnd.randint(1, 5) for _ in range(40)])
        end = np.arange(1, 41)
        length, low, high = index.matching_statistics(query, np.zeros(40, np.int64), end)
        occurs = lambda p: sum(t[i:i + len(p)] == p for t in texts for i in range(len(t) - len(p) + 1))
        for e, n, a, b in zip(end, length, low, high):
            best = max((k for k in range(1, min(width, e) + 1) if occurs(query[e - k:e].tolist())), default=0)
            assert n == best
            if n:
                assert b - a == occurs(query[e - n:e].tolist())


def test_wavelet_rank():
    rng = np.random.default_rng(9)
    for alphabet in (1, 2, 5, 64, 1000):
        seq = rng.integers(0, alphabet, 500)
        tree = fm_dedup.WaveletTree(seq, alphabet)
        symbol, at = rng.choice(seq, 200), rng.integers(0, 501, 200)
        assert tree.rank(symbol, at).tolist() == [int((seq[:a] == s).sum()) for s, a in zip(symbol, at)]
