"""Hard negatives against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flagstone.llm import hard_negatives as hn
from tests.conftest import rows

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(data, every=50, positives=5, negatives=3):
    good = {}
    for i, label, v in data:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(x * 256) >= hn.LARGEST for x in v):
            continue
        good[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    out = []
    for a, la, va in good:
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v, strict=True)), i, label) for i, label, v in good if len(v) == len(va))
        same = [(i, -s) for s, i, label in scored if label == la and i != a][:positives]
        for pid, p in same:
            met = [(i, -s) for s, i, label in scored if label != la and 50 * p <= -100 * s <= 95 * p][:negatives]
            out += [(a, pid, r + 1, i, p, s) for r, (i, s) in enumerate(met)]
    return sorted(out)


def vectors(count, dim, labels, seed, spread=1.0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(labels, dim))
    out = []
    for i in range(count):
        label = int(rng.integers(labels))
        v = (centres[label] + centres[(label + 1) % labels] * 0.7 + rng.normal(size=dim)) * spread / math.sqrt(dim)
        out.append((i, label, v.astype(np.float32).tolist()))
    return out


def mined(spark, data, **more):
    df = spark.createDataFrame(data, SCHEMA)
    return rows(hn.hard_negatives(df, F.col("vec_id") % 50 == 0, **more))


def test_lookups_give_the_inner_products():
    rng = np.random.default_rng(1)
    for dim, top in ((1, 2), (7, 300), (8, 300), (64, 300), (65, 1 << 25), (0, 1)):
        a, b = rng.integers(-top, top, (5, dim)), rng.integers(-top, top, (9, dim))
        assert (hn.scores(hn.tables_of(a), hn.planes_of(b.astype(np.int32))) == a @ b.T).all()


@pytest.mark.parametrize("dim", [3, 16])
def test_equals_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(hn, "ANCHORS", 4)
    monkeypatch.setattr(hn, "BLOCK", 60)
    data = vectors(900, dim, 6, dim)
    got = mined(spark, data)
    assert got == plain(data) and len(got) > 100


def test_ties_copies_and_one_hot_label(spark, monkeypatch):
    """A third of the rows is one vector and label, another third one vector with all labels."""
    monkeypatch.setattr(hn, "BLOCK", 50)
    rng = random.Random(2)
    data = vectors(200, 4, 3, 5)
    hot, near = [0.5, 0.25, 0.0, -0.5], [0.4, 0.2, 0.0, -0.4]
    data += [(200 + i, 1, hot) for i in range(200)] + [(400 + i, rng.randrange(4), near) for i in range(200)]
    rng.shuffle(data)
    got = mined(spark, data)
    assert got == plain(data) and any(r[0] == 250 for r in got)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    data = vectors(120, 4, 3, 7)
    odd = [(0, 1, None), (50, None, [1.0] * 4), (100, 1, [nan, 0.0, 0.0, 0.0]), (100, 2, [inf, 0.0, 0.0, 0.0]), (200, 0, [None, 1.0, 1.0, 1.0]), (None, 1, [1.0] * 4)]
    odd += [(250, 1, [1.0, 2.0]), (251, 1, [1.0, 2.5]), (252, 2, [0.5, 1.5]), (300, 1, []), (301, 1, []), (302, 2, []), (350, 1, [3e38, 0.0, 0.0, 0.0])]
    odd += [(0, 2, [0.3, 0.3, 0.1, 0.2]), data[0], data[50], (-50, 1, [0.1, 0.9, 0.5, -0.3])]
    got = mined(spark, data + odd)
    assert got == plain(data + odd)
    assert {r[0] for r in got} >= {0, 250, 300}


def test_extra_columns_and_empty_table(spark):
    data = vectors(120, 4, 3, 8)
    wide = spark.createDataFrame([(*r, "x", 1, b"") for r in data], SCHEMA + ", id string, mark int, data binary")
    assert rows(hn.hard_negatives(wide, F.col("vec_id") % 50 == 0)) == plain(data)
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == []
