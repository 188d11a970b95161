"""Near-duplicate documents against all pairs; signatures against the similarity they estimate."""

import random
import re

import numpy as np
import pytest

from flagstone.llm import near_dup
from flagstone.llm.components import components
from flagstone.llm.shingles import shingles, word_hashes


def shingle_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain(rows, percent):
    sets = {i: shingle_set(t) for i, t in rows}
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(sets[i]), top(i), top(i) == i) for i in ids)


def fixture(seed=5):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(800)]
    new = lambda n: [rng.choice(words) for _ in range(n)]
    rows, at = [], 0
    for size in (1,) * 60 + (2,) * 20 + (5,) * 8 + (40, 60):
        base = new(rng.randint(3, 250))
        for _ in range(size):
            text = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((at, rng.choice([" ", "\n", "\t"]).join(text)))
            at += 3
    # drifting copies: neighbours are linked, ends are not
    base = new(200)
    for k in range(40):
        base[5 * k % 200] = f"drift{k}"
        rows.append((at + k, " ".join(base)))
    at += 100
    rows += [(at + k, t) for k, t in enumerate([None, "", " \n ", "one", "One", "two words", "Ä", "ä", "x " * 60000, "x " * 50000])]
    rng.shuffle(rows)
    return rows


def test_equals_all_pairs(spark):
    rows = fixture()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(docs).collect())) == plain(rows, 85)


@pytest.mark.parametrize(("block", "shingles_"), [(512, 2_000_000), (3, 2_000_000), (512, 150)])
def test_large_buckets_go_by_blocks(spark, monkeypatch, block, shingles_):
    """With no pairs allowed in a join, all is found by blocks, small by members or by shingles."""
    monkeypatch.setattr(near_dup, "OPEN_PER_MEMBER", 0)
    monkeypatch.setattr(near_dup, "BLOCK", block)
    monkeypatch.setattr(near_dup, "BLOCK_SHINGLES", shingles_)
    rows = fixture(6)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, near_dup.near_duplicates(docs, percent=80).collect())) == plain(rows, 80)


def test_null_and_tied_ids_and_clashing_columns(spark):
    rows = [(None, "a b c d e f", 1), (1, "a b c d e f", 2), (2, "A b c d e f", 3), (2, "A b c d e f", 3), (2, "p q r s t", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bucket int").withColumnRenamed("bucket", "class")
    got = sorted(map(tuple, near_dup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(None, 2, None, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False), (2, 1, 1, False)], key=str)
    assert near_dup.near_duplicates(docs.limit(0)).collect() == []


def test_ids_with_several_texts_are_linked_with_what_any_of_them_is(spark):
    rows = fixture(8)
    by_id = {}
    rng = random.Random(3)
    tied = [(i if rng.random() < 0.9 else rng.choice([0, 3, 6, 9]), t) for i, t in rows]
    for i, t in tied:
        by_id.setdefault(i, []).append(shingle_set(t))
    root = {i: i for i in by_id}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    flat = [(i, s) for i, sets in by_id.items() for s in sets if s]
    for k, (a, x) in enumerate(flat):
        for b, y in flat[k + 1 :]:
            if 100 * len(x & y) >= 85 * len(x | y) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    want = sorted((i, len(shingle_set(t)), top(i) if shingle_set(t) else i) for i, t in tied)
    got = near_dup.near_duplicates(spark.createDataFrame(tied, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == want


def test_one_row_of_each_group(spark):
    a, b, c = "a b c d e f g h i j", "p q r s t u v w x y", "k l m n o p"
    rows = [(5, a, 1), (3, a, 2), (3, a, 2), (None, a, 3), (None, b, 4), (None, b, 4), (None, b, 5), (7, c, 6), (8, "", 7), (None, None, 8), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group int")
    got = sorted(map(tuple, near_dup.one_of_each(docs).collect()), key=str)
    assert [r for r in got if r[1] == b] in ([(None, b, 4)], [(None, b, 5)])
    assert [r for r in got if r[1] != b] == sorted([(3, a, 2), (7, c, 6), (8, "", 7), (8, "", 7), (None, None, 8)], key=str)
    rows = fixture(9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = {i for i, _, _, kept in plain(rows, 80) if kept}
    assert {r.doc_id for r in near_dup.one_of_each(docs, 80).collect()} == want


def test_signature_estimates_similarity_with_less_spread_than_independent_positions():
    rng = np.random.default_rng(0)
    gaps = []
    for _ in range(300):
        shared, left, right = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (60, 20, 20))
        a, b = (near_dup.super_min_hash(np.unique(np.concatenate([shared, x]))) for x in (left, right))
        gaps.append((a == b).mean() - 0.6)
    assert abs(np.mean(gaps)) < 0.01
    assert np.var(gaps) < 0.8 * 0.6 * 0.4 / near_dup.POSITIONS


def test_few_and_many_elements_make_the_same_signature(monkeypatch):
    x = np.random.default_rng(1).integers(0, 2**63, 20).astype(np.uint64)
    direct = near_dup.super_min_hash(x)
    start = (near_dup.mix(x ^ near_dup.GOLDEN) % np.uint64(257)).astype(np.int64)
    stride = 1 + (near_dup.mix(x + near_dup.GOLDEN) % np.uint64(256)).astype(np.int64)
    out = np.full(257, 2**64 - 1, np.uint64)
    for j in range(257):
        value = near_dup.mix(x + np.uint64((j + 1) * int(near_dup.GOLDEN) & (2**64 - 1))) >> np.uint64(16)
        np.minimum.at(out, (start + j * stride) % 257, np.uint64(j << 48) | value)
    assert (direct == out).all()


def test_components_of_chains_and_hubs(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)] + [(300, 301), (301, 300), (302, 301)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "u long, v long").repartition(8)).collect()))
    assert got == {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {300: 300, 301: 300, 302: 300}


def test_shingles_of_short_texts():
    assert len(shingles(word_hashes(""))) == 0
    assert len(shingles(word_hashes("a b"))) == 1
    assert shingles(word_hashes("a b"))[0] != shingles(word_hashes("a b c d e"))[0]
