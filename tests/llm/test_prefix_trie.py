"""Prefix trie and its totals against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from flagstone.llm import prefix_trie as pt
from tests.conftest import rows

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(data):
    turns = {}
    for c, turn, role, text in data:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            turns.setdefault(c, []).append((turn is not None, turn or 0, key, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c > 0 else -1)
        built[c] = tuple(turns.get(base, [])[:h] + own[h:])
    members = {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for n in members:
        if n:
            kids[n[:-1]] += 1
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += kids[n] == 0
            saved[n[:d]] += (len(m) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(n))
        out.append((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), kids[n], leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(count, seed, longest=12, kinds=3):
    rng = random.Random(seed)
    out = []
    for c in range(count):
        for t in range(rng.randrange(1, longest)):
            out.append((c, t, ("user", "assistant")[t % 2], f"é{rng.randrange(kinds)}" * (1 + t % 3)))
    rng.shuffle(out)
    return out


def trie(spark, data):
    return sorted(rows(pt.prefix_trie(spark.createDataFrame(data, SCHEMA).repartition(5))), key=str)


@pytest.mark.parametrize("n", [1, 2, 50, 700])
def test_centroid_sums(n):
    """Random, deep and wide forests."""
    rng = np.random.default_rng(n)
    nodes = np.arange(n)
    for parent in (
        np.where(rng.random(n) < 0.05, -1, rng.integers(0, np.maximum(nodes, 1))),
        nodes - 1,
        np.where(nodes == 0, -1, 0),
        np.where(nodes == 0, -1, np.maximum(nodes - 1 - rng.integers(0, 3, n), 0)),
    ):
        parent[0] = -1
        depth = np.zeros(n, np.int64)
        for v in range(n):
            depth[v] = 0 if parent[v] < 0 else depth[parent[v]] + 1
        weights = rng.integers(0, 100, (2, n))
        want = weights.copy()
        for v in reversed(range(n)):
            if parent[v] >= 0:
                want[:, parent[v]] += want[:, v]
        assert (pt.centroid_sums(parent, depth, weights) == want).all()


def test_equals_brute_force(spark):
    data = conversations(120, 1)
    assert trie(spark, data) == plain(data)


@pytest.mark.parametrize(("depth", "forest"), [(2, 7), (3, 1)])
def test_paths_cut_more_than_once_and_many_forests(spark, monkeypatch, depth, forest):
    monkeypatch.setattr(pt, "DEPTH", depth)
    monkeypatch.setattr(pt, "FOREST", forest)
    monkeypatch.setattr(pt, "NUMBERS", 2)
    data = conversations(40, 2, longest=20, kinds=1)
    assert trie(spark, data) == plain(data)


def test_hot_conversation_and_hot_copies(spark):
    """A third of the turns in one conversation, a third in copies of another, one common first turn."""
    data = [(3, t, "user", f"t{t % 7}") for t in range(1200)]
    data += [(100 + c, t, "user", f"u{t}") for c in range(150) for t in range(8)]
    data += [(1000 + c, t, "user", "hello" if t == 0 else f"{c}") for c in range(100) for t in range(9)]
    assert trie(spark, data) == plain(data)


def test_odd_rows(spark):
    data = conversations(30, 5)
    data += [(None, 0, "user", "x"), (31, None, None, None), (31, 1, "user", None), (31, 1, "user", "b"), (31, 1, "user", "b"), (32, 0, "", ""), (-7, 0, "a", "b"), (-7, 5, "a", "c"), (-5, 0, "z", "y")]
    data += [(33, 0, "ab", "c"), (34, 0, "a", "bc"), (35, 0, "user", "w " * 200_000), (2**62, 0, "u", "v")]
    assert trie(spark, data) == plain(data)


def test_extra_columns_and_empty_table(spark):
    data = conversations(10, 6)
    wide = spark.createDataFrame([(*r, 1, "q", 2) for r in data], SCHEMA + ", conv int, block string, depth int")
    assert sorted(rows(pt.prefix_trie(wide)), key=str) == plain(data)
    assert trie(spark, []) == []
    assert trie(spark, [(None, 1, "a", "b")]) == []
