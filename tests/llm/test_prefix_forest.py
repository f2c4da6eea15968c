"""The conversation trie against plain Python, and the centroid decomposition by itself."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from compare import compare, connect
from farewheel.llm import prefix_forest as forest
from farewheel.llm.queries import ORACLE_SQL, QUERIES

TURNS = "conv_id long, turn long, role string, text string, depth string, node string, component string"


def brute(rows):
    own = {}
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            mark = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, mark), (role or "", text or "")))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = own.get(c - int(np.fmod(c, 100)), [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            nodes.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    kids, leaves, saved = {}, {}, {}
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    for path, members in nodes.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] = leaves.get(path[:d], 0) + (path not in kids)
            saved[path[:d]] = saved.get(path[:d], 0) + (len(members) - 1) * (len(path[-1][1]) if path else 0)
    first = {path: min(c for c, _ in members) for path, members in nodes.items()}
    return sorted(((
        first[p], len(p), first[p[:-1]] if p else None, len(m), kids.get(p, 0), leaves[p], saved[p],
        hashlib.sha256(",".join(str(c) for c in sorted(c for c, end in m if end)).encode()).hexdigest()) for p, m in nodes.items()), key=repr)


def result(spark, rows, **kw):
    table = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], TURNS).repartition(5)
    return sorted(map(tuple, forest.prefix_trie(table, **kw).collect()), key=repr)


def copies(rng, n, turns=9):
    """Conversations that share first turns, whole copies, and families that borrow."""
    lines = [(r, f"{r} says {i} é漢") for i in range(3) for r in ("user", "assistant")]
    rows = []
    for c in range(n):
        base = rng.randrange(5)
        kind = random.Random(base)
        talk = [kind.choice(lines) for _ in range(rng.randrange(0, turns))] + [rng.choice(lines) for _ in range(rng.randrange(0, 3))]
        rows += [(c * 7 if c % 3 else c * 100, t, *x) for t, x in enumerate(talk)]
    return rows


@pytest.mark.parametrize("most", [20_000, 6, 1])
def test_trie_equals_brute_force(spark, most):
    rows = copies(random.Random(most), 150)
    rows += [(None, 1, "user", "lost"), (10**12, None, None, None), (10**12, None, "user", "x"), (10**12, 5, "user", None), (10**12, 5, "a", "tie"),
             (10**12, 5, "a", "tie"), (-100, 0, "user", "below zero"), (-130, 0, "user", "y"), (-130, 1, "user", "z")]
    rows += [(999_901, t, "user", f"alone {t}") for t in range(4)]  # the family's first one is absent
    assert result(spark, rows, most=most) == brute(rows)


def test_long_conversations(spark, monkeypatch):
    """One conversation holds most rows: a path deeper than a block of running values and than
    what a task may hold; its copy leaves it half way."""
    monkeypatch.setattr(forest, "RUN", 16)
    rows = [(1, t, "user", f"t{t}") for t in range(700)]
    rows += [(2, t, "user", f"t{t}" if t < 350 else f"other {t}") for t in range(400)]
    rows += [(100 + i, 0, "user", "x" * i) for i in range(30)]
    assert result(spark, rows, most=100) == brute(rows)


def test_empty_and_blank_tables(spark):
    assert result(spark, [(None, 1, "user", "lost")]) == []
    rows = [(100, 0, "user", "a" * 3_000_000), (150, 0, "user", "b"), (200, 0, None, None)]
    assert result(spark, rows) == brute(rows)


def test_members_that_end_at_one_node_pass_in_blocks(spark):
    rows = [(c, 0, "user", "hello") for c in range(20_000, 40_000, 2) if zlib.crc32(str(c).encode()) % 6 == 0]
    assert result(spark, rows) == brute(rows)


def test_centroids_of_any_forest():
    rng = np.random.default_rng(7)
    for shape in ("random", "path", "star", "comb"):
        for n in (1, 2, 3, 50, 400):
            parent = np.full(n, -1)
            for i in range(1, n):
                parent[i] = {"random": rng.integers(-1, i), "path": i - 1, "star": 0, "comb": max(0, i - 1 - i % 2)}[shape]
            depth = np.zeros(n, int)
            for i in range(n):
                depth[i] = 0 if parent[i] < 0 else depth[parent[i]] + 1
            order = np.argsort(depth, kind="stable")
            place = np.empty(n, int)
            place[order] = np.arange(n)
            parent = np.where(parent[order] < 0, -1, place[parent[order]])
            weight, values = rng.integers(1, 50, n), rng.integers(0, 9, (n, 2))
            whole, part = values.copy(), weight.copy()
            for i in range(n - 1, -1, -1):
                if parent[i] >= 0:
                    whole[parent[i]] += whole[i]
                    part[parent[i]] += part[i]
            assert (forest.Forest(parent, weight, part, values).totals() == whole).all()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_trie_query_equals_sql(spark, sf):
    name = "op11_prefix_forest"
    assert compare(QUERIES[name](spark, f"/root/testdata/{sf}"), connect(f"/root/testdata/{sf}"), ORACLE_SQL[name]) is None
