"""HNSW search against all inner products."""

import numpy as np

from flagstone.llm import ann


def exact(ids, vectors, queries, k):
    out = {}
    for q, v in queries:
        score = vectors.astype(np.float64) @ np.asarray(v, np.float64)
        best = sorted(((-s, i) for s, i in zip(score.tolist(), ids, strict=True) if i != q))[:k]
        out[q] = [(i, -s) for s, i in best]
    return out


def test_recall_on_one_shard():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(3000, 48)).astype(np.float32) * rng.uniform(0.3, 2, (3000, 1)).astype(np.float32)
    ids = rng.permutation(3000)
    graph = ann.Graph.built(ids, vectors)
    met, score = graph.search(vectors[:200], 20)
    want = np.argsort(-(vectors[:200].astype(np.float64) @ vectors.T.astype(np.float64)), 1)[:, :20]
    recall = np.mean([len(set(graph.ids[met[i]]) & set(ids[want[i]])) / 20 for i in range(200)])
    assert recall >= 0.9
    assert all((layer < size).all() and (layer[:, 0] >= 0).all() for layer, size in zip(graph.layers, graph.sizes, strict=True) if size > 1)


def test_frame_equals_exact_on_few_rows_with_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(2)
    vectors = np.round(rng.normal(size=(60, 5)), 2).astype(np.float32)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(vectors)]
    rows += [(100 + i, rows[7][1], 1) for i in range(80)]  # a hot vector
    good = [(i, v) for i, v, _ in rows]
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 5, 1), (903, [1.0, None, 1.0, 1.0, 1.0], 1), (904, [1.0, float("nan"), 0.0, 0.0, 0.0], 1),
             (905, [float("inf"), 1.0, 1.0, 1.0, 1.0], 1), (None, [1.0] * 5, 1), (906, [1.0, 2.0], 1), (3, rows[3][1], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = {}
    for r in ann.nearest(table, table.filter("vec_id % 20 = 0 or vec_id = 906"), k=20).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(got[r.query_id])
    want = exact([i for i, _ in good], np.array([v for _, v in good], np.float32), [(i, v) for i, v in good if i % 20 == 0], 20)
    assert set(got) == set(want)
    for q, pairs in want.items():
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in pairs]
        assert got[q][0][0] == pairs[0][0] and len({i for i, _ in got[q]}) == 20
    assert ann.nearest(table.limit(0), table, k=20).collect() == []


def test_shards_and_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(500, 8)).astype(np.float32)
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.nearest(table, table.filter("vec_id % 20 = 0"), k=10).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = exact(range(500), vectors, [(i, vectors[i]) for i in range(0, 500, 20)], 10)
    assert np.mean([len(got[q] & {i for i, _ in p}) / 10 for q, p in want.items()]) >= 0.95
