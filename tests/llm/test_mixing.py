"""Raking against a plain version, and what sampling keeps."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flagstone.llm import mixing
from tests.conftest import SF01


def docs(spark, n=1500):
    rows = [
        (i, f"s{(i * i) % 7 if i % 3 else 0}", ["en", "de", None][i % 5 % 3], " ".join(f"w{i}x{k}" for k in range(5 + (i * 37) % 400)), "t", 1.0)
        for i in range(n)
    ]
    rows += [(-1, None, None, None, "t", 1.0), (-2, "s1", "en", "", "t", 1.0), (-3, "s1", "en", "{} [] () <> " * 20000, "t", 1.0), (None, "s1", "en", "a b", "t", 1.0)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, topic string, rate double")


def counted(spark, table=None):
    cells = mixing.measured(table or docs(spark), ["doc_id"]).select("__cell.*").groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens"))
    return cells, {(r.source, r.lang, r.topic): r.tokens for r in cells.collect()}


def marginals(cells, weights):
    out = defaultdict(float)
    for c in cells:
        for d in range(3):
            out[d, c[d]] += weights[c]
    return out


def crossed(spark, n=3000):
    """All sources have all languages and lengths: the targets can hold."""
    rng = random.Random(4)
    rows = [(i, rng.choice(["s0"] * 6 + ["s1", "s2", "s2"]), rng.choice(["en"] * 5 + ["de", "fr"]), " ".join(["w"] * rng.choice([20, 150, 400, 1200])), "t", 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, topic string, rate double")


def plain_targets(cells, flatten):
    sums = marginals(cells, cells)
    flat = {k: v**flatten for k, v in sums.items() if v}
    return {(d, v): x / sum(y for (e, _), y in flat.items() if e == d) for (d, v), x in flat.items()}


def test_without_full_cells_the_rates_are_those_of_the_textbook(spark):
    cells, counts = counted(spark, crossed(spark))
    got = {(r.source, r.lang, r.topic): r.rate for r in mixing.keep_rates(cells, {}, 0.5, 0.1).collect()}
    targets, weight = plain_targets(counts, 0.5), {c: t / sum(counts.values()) for c, t in counts.items()}
    for _ in range(200):
        for d in range(3):
            have = marginals(counts, weight)
            weight = {c: w * targets[d, c[d]] / have[d, c[d]] for c, w in weight.items()}
    assert max(got.values()) < 1
    for c, w in weight.items():
        assert got[c] * counts[c] == pytest.approx(0.1 * sum(counts.values()) * w, rel=5e-3)


def check_targets(rated, counts, flat, share):
    """Targets add up to 1, ask for no more than there is, and are in proportion where there is enough; gaps are those of the rates."""
    told = {(mixing.DIMENSIONS.index(r.dimension), r.value): (r.target, r.share) for r in mixing.gaps(rated).collect()}
    rates = {(r.source, r.lang, r.topic): r.rate for r in rated.collect()}
    assert all(0 <= r <= 1 for r in rates.values())
    kept = {c: r * counts[c] for c, r in rates.items()}
    have, supply = marginals(kept, kept), marginals(counts, counts)
    total = sum(counts.values())
    for d in range(3):
        mine = {v: told[e, v][0] for e, v in told if e == d and (d, v) in flat}
        assert sum(mine.values()) == pytest.approx(1)
        open_ = [v for v in mine if mine[v] < supply[d, v] / total / share * (1 - 1e-9)]
        assert all(mine[v] <= supply[d, v] / total / share * (1 + 1e-9) for v in mine)
        ratios = [mine[v] / flat[d, v] for v in open_]
        assert not ratios or max(ratios) == pytest.approx(min(ratios))
        assert all(mine[v] <= flat[d, v] * max(ratios, default=math.inf) * (1 + 1e-9) for v in mine)
    for key, (_, got) in told.items():
        assert got == pytest.approx(have[key] / sum(kept.values()))
    return told, kept


@pytest.mark.parametrize("share", [0.3, 0.7, 0.9, 1.0])
def test_kept_shares_fit_all_marginals_although_cells_are_full(spark, share):
    cells, counts = counted(spark, crossed(spark))
    rated = mixing.keep_rates(cells, {}, 0.5, share)
    told, kept = check_targets(rated, counts, plain_targets(counts, 0.5), share)
    assert rated.first().fits
    assert all(abs(t - got) <= mixing.TOLERANCE for t, got in told.values())
    assert sum(kept.values()) == pytest.approx(share * sum(counts.values()), rel=0.005)


@pytest.mark.parametrize("share", [0.7, 0.8])
def test_the_query_fits_its_marginals(spark, share):
    """On a given table: kept token shares within 0.01 of the targets."""
    cells, counts = counted(spark, spark.read.parquet(f"{SF01}/documents.parquet"))
    rated = mixing.keep_rates(cells, {}, 0.5, share)
    told, kept = check_targets(rated, counts, plain_targets(counts, 0.5), share)
    assert rated.first().fits and len(told) > 8
    assert all(abs(t - got) < 0.01 for t, got in told.values())
    assert sum(kept.values()) == pytest.approx(share * sum(counts.values()), rel=0.005)


def test_targets_that_contradict_each_other_are_told(spark):
    """Of ``docs``, the topic code lies wholly inside a source with a smaller target."""
    cells, counts = counted(spark)
    rated = mixing.keep_rates(cells, {}, 0.5, 0.3)
    told, _ = check_targets(rated, counts, plain_targets(counts, 0.5), 0.3)
    assert not rated.first().fits
    assert max(abs(t - got) for t, got in told.values()) > 0.01
    assert {r.mix.fits for r in mixing.mix(docs(spark), kept_share=0.3).select("mix").collect()} == {False}


def test_rare_values_do_not_shrink_the_mixture(spark):
    """A language with one document in a thousand is kept whole; the wanted share of tokens stays."""
    table = crossed(spark).withColumn("lang", F.when(F.col("doc_id") < 3, "rare").otherwise(F.col("lang")))
    cells, counts = counted(spark, table)
    rated = mixing.keep_rates(cells, {}, 0.5, 0.8)
    _, kept = check_targets(rated, counts, plain_targets(counts, 0.5), 0.8)
    assert sum(kept.values()) == pytest.approx(0.8 * sum(counts.values()), rel=0.01)
    assert all(r.rate > 0.99 for r in rated.where("lang = 'rare'").collect())


def test_explicit_targets(spark):
    cells, _ = counted(spark, crossed(spark))
    told = {r.value: r.share for r in mixing.gaps(mixing.keep_rates(cells, {"lang": {"en": 3.0, "de": 1.0}}, 1.0, 0.5)).where("dimension = 'lang'").collect()}
    assert told["fr"] == 0 and told["en"] == pytest.approx(0.75, abs=0.003) and told["de"] == pytest.approx(0.25, abs=0.003)


def test_too_many_cells_are_refused(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_CELLS", 3)
    with pytest.raises(ValueError, match="coarser"):
        mixing.keep_rates(counted(spark)[0], {}, 0.5, 0.7)


def test_all_rows_come_back_and_sampling_follows_the_rates(spark):
    table = docs(spark)
    mixed = mixing.mix(table.withColumn("mix", F.lit(1)))
    got = mixed.collect()
    assert mixed.columns == [*table.columns, "mix"] and len(got) == table.count()
    expected, kept = sum(r.mix.rate for r in got), sum(r.mix.sampled for r in got)
    assert abs(kept - expected) < 4 * expected**0.5
    assert all(r.mix.n_tokens == len((r.text or "").split()) for r in got)
    assert {r.doc_id: r.mix.topic for r in got if r.doc_id in (-1, -2, -3)} == {-1: "none", -2: "none", -3: "code"}
    again = {r.doc_id: r.mix.sampled for r in mixing.mix(table).collect()}
    assert again == {r.doc_id: r.mix.sampled for r in got}
    assert mixing.mix(table.limit(0)).collect() == []
