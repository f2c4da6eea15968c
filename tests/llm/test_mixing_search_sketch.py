"""Mixing, exact search and version sketches against brute force."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from farewheel.llm import fair_mixing, impact_topk, paragraph_iblt


def water_fill(sizes, budget, repeats, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    most = {s: repeats * sizes[s] for s in names}
    target, open_ = {}, set(names)
    left = budget * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = {s for s in open_ if share[s] >= most[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most[s]
            left -= most[s]
        open_ -= over
    return target


def test_targets_and_mix(spark, docs, clashing):
    rnd = random.Random(7)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 40)), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(600)] + [(1000, "w " * 900, "d")]
    got = fair_mixing.mix_documents(clashing(*rows)).collect()
    size = {d: len(t.split()) for d, t, _ in rows}
    total = Counter()
    for d, _, s in rows:
        total[s] += size[d]
    target = water_fill(dict(total), 1.5, 2)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == total[r.source]
        assert math.isclose(r.target, target[r.source], rel_tol=1e-12)
        assert r.taken in (0, r["size"], 2 * r["size"])
        taken[r.source] += r.taken
    for s in total:
        assert abs(taken[s] - target[s]) <= 900 if s == "d" else abs(taken[s] - target[s]) <= 80
    assert sum(taken.values()) <= 1.5 * sum(total.values()) + 1e-6
    again = fair_mixing.mix_documents(docs(*rows, parts=7)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_mix_of_odd_rows(spark, docs, clashing, odd):
    got = fair_mixing.mix_documents(clashing(*odd)).collect()
    assert len(got) == len(odd)
    assert all(r.taken <= 2 * r["size"] for r in got)
    assert all(r.taken == 0 for r in got if r.doc_id in (1, 2, 3))
    assert fair_mixing.mix_documents(docs(*odd).limit(0)).count() == 0
    assert [r.taken for r in fair_mixing.mix_documents(docs((1, ""), (2, None))).collect()] == [0, 0]


def test_bins_do_not_change_the_mix(spark, docs, monkeypatch):
    rows = [(i, "w " * (i % 23), "abc"[i % 3]) for i in range(300)]
    one = sorted(map(tuple, fair_mixing.mix_documents(docs(*rows)).collect()))
    monkeypatch.setattr(fair_mixing, "ROWS_PER_BIN", 20)
    assert sorted(map(tuple, fair_mixing.mix_documents(docs(*rows)).collect())) == one


def test_search_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(700, 16)) * 0.2)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]                              # ties
    rows += [(50, None), (2000, [None] * 16), (2050, [float("nan")] * 16), (2100, [float("inf")] + [0.0] * 15), (None, rows[5][1]), (2150, []), (2200, [0.5, 0.5]), (2250, [0.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("clash")).withColumn("v", F.lit("clash")).repartition(4)
    got = {}
    for r in impact_topk.top_k_embeddings(df).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ints = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ints[i] = [math.floor(256 * float(np.float32(x))) for x in v]
    wanted = {}
    for q in ints:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(ints[q], v)), i) for i, v in ints.items() if i != q))[:5]
            wanted[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert {q: sorted(r) for q, r in got.items()} == wanted
    assert impact_topk.top_k_embeddings(df.limit(0)).count() == 0
    assert impact_topk.top_k_embeddings(df.filter("vec_id = 100")).count() == 0


def test_small_blocks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, v) for i, v in enumerate((rng.normal(size=(300, 8)) * 0.3).tolist())], "vec_id long, embedding array<double>")
    one = sorted(map(tuple, impact_topk.top_k_embeddings(df, every=5).collect()))
    for name, value in (("SHARD_ROWS", 37), ("BLOCK_ROWS", 11), ("AT_ONCE", 3), ("FEW", 1)):
        monkeypatch.setattr(impact_topk, name, value)
    assert sorted(map(tuple, impact_topk.top_k_embeddings(df, every=5).collect())) == one


def test_sketches_recover_differences():
    rng = np.random.default_rng(10)
    for shared, left, right in ((0, 0, 0), (50, 0, 0), (50, 3, 4), (0, 30, 1), (200, 90, 80), (5, 1000, 0)):
        x = np.unique(rng.integers(0, 2**63, shared + left + right).astype(np.uint64))
        rng.shuffle(x)
        a, b = x[: shared + left], np.concatenate([x[:shared], x[shared + left:]])
        only_a, only_b, cells = paragraph_iblt.reconcile(a, b)
        assert set(only_a) == set(a) - set(b) and set(only_b) == set(b) - set(a)
        union = len(set(a) | set(b))
        assert paragraph_iblt.likeness(a, b) == (len(set(a) & set(b)) / union if union else 1.0)
        text = paragraph_iblt.Sketch.of(a).text()
        assert paragraph_iblt.Sketch.from_text(text).text() == text
    assert paragraph_iblt.Sketch.of(np.zeros(0, np.uint64)).peel() is not None


def brute_versions(rows):
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or "\0"))
    out = []
    for i, (d, t) in enumerate(order):
        own, after = t or "", order[(i + 1) % len(order)][1] or ""
        k = len(own) // 3
        out.append((d, len(own), hashlib.sha256((own[: len(own) - k] + after[:k]).encode()).hexdigest()))
    return out


def test_versions_equal_brute_force(spark, docs, clashing):
    rnd = random.Random(11)
    rows = [(i * 3 - 50, "\n".join(" ".join(rnd.choice(["é", "b", "cc"]) for _ in range(rnd.randint(0, 30))) for _ in range(rnd.randint(0, 6)))) for i in range(150)]
    rows += [(500, None), (501, ""), (None, "no id")]
    got = paragraph_iblt.fingerprint_versions(clashing(*rows)).collect()
    assert sorted(((r[0] if r[0] is not None else -99), *r[1:3]) for r in got) == sorted(((r[0] if r[0] is not None else -99), *r[1:]) for r in brute_versions(rows))
    by_text = {}
    texts = dict(rows)
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(texts[r.doc_id] or "", r.fingerprint) == r.fingerprint
        if r.fingerprint == r.edited_fingerprint:
            assert r.near_edited == 1
    assert paragraph_iblt.fingerprint_versions(docs((7, "alone\ntext"))).collect()[0].near_next == 1.0
    assert paragraph_iblt.fingerprint_versions(docs((1, "x")).limit(0)).count() == 0
    assert paragraph_iblt.fingerprints(docs(*rows)).count() == len(rows)


def test_versions_of_odd_rows(docs, odd):
    assert paragraph_iblt.fingerprint_versions(docs(*odd)).count() == len(odd)
