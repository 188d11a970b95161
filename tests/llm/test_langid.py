"""Language identification on held-out rows; the learner and the calibration by themselves."""

import numpy as np
from pyspark.sql import functions as F

from flagstone.llm import langid, queries
from tests.conftest import SF01


def test_held_out_accuracy_and_score(spark):
    got = queries.op7_language_id(spark, SF01).join(spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 1000 and 150 < len(held) < 250
    right = np.mean([r.lang == r.lang_pred for r in held])
    assert right >= 0.95
    assert abs(np.mean([r.score for r in held]) - right) < 0.05
    assert all(0 <= r.score <= 1 for r in got)


def test_edge_rows_and_no_model(spark):
    rows = [(1, "hello there", "en", 0.5), (2, "hallo du", "de", 0.5), (3, None, "de", 0.5), (4, "", None, 0.5), (5, "12 !? 3", "en", 0.5), (1, "hello there", "en", 0.5), (6, "x" * 300000, None, 0.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    model = langid.train(docs, F.xxhash64("doc_id", "text"))
    assert model.langs == ["de", "en"]
    got = langid.predict(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    preds = [(r.doc_id, r.lang_pred) for r in got.orderBy("doc_id").collect()]
    assert preds[:6] == [(1, "en"), (1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und")] and preds[6][1] in ("de", "en")
    none = langid.train(docs.limit(0), F.xxhash64("doc_id"))
    assert none is None
    assert {(r.lang_pred, r.score) for r in langid.predict(docs.filter("doc_id = 1"), none).collect()} == {("und", 0.0)}


def test_sample_ends_of_hot_and_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_PER_LANG", 30)
    monkeypatch.setattr(langid, "RANGE_BITS", 4)
    hashed = F.xxhash64("id")
    rows = spark.range(20000).select(F.when(F.col("id") % 100 < 90, "hot").when(F.col("id") % 100 < 99, "some").otherwise("rare").alias("lang"), hashed.alias("order"))
    rows = rows.union(spark.range(5).select(F.lit("few").alias("lang"), hashed)).union(spark.range(500).select(F.lit("equal").alias("lang"), F.lit(-7).cast("long")))
    ends = langid.sample_ends(rows)
    held: dict[str, list[int]] = {}
    for r in rows.collect():
        held.setdefault(r["lang"], []).append(r["order"])
    assert set(ends) == set(held)
    for lang, orders in held.items():
        orders.sort()
        assert ends[lang] >= orders[min(30, len(orders)) - 1]
        assert sum(x <= ends[lang] for x in orders) <= (500 if lang == "equal" else 60)
    assert langid.sample_ends(rows.limit(0)) == {}


def test_penalties_make_the_weights_sparse():
    rng = np.random.default_rng(0)
    kept = []
    for l1 in (0.0, 0.5):
        learner = langid.Ftrl(2, l1=l1)
        for _ in range(300):
            lang = int(rng.integers(2))
            found = np.append(rng.choice(1000, 10, replace=False) + 10, lang)
            learner.learn(found, np.full(11, 0.3), lang)
        w = learner.weights(np.arange(langid.FEATURES))
        kept.append((w != 0).sum())
        assert w[0, 0] > w[0, 1] and w[1, 1] > w[1, 0]
    assert kept[1] < kept[0] / 5


def test_temperature_is_found():
    rng = np.random.default_rng(1)
    true = rng.normal(size=(4000, 3))
    p = np.exp(true) / np.exp(true).sum(1, keepdims=True)
    right = np.array([rng.choice(3, p=x) for x in p])
    assert abs(langid.best_temperature(5 * true, right) - 5) < 0.5
