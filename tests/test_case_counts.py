"""Counts by changes against recounts."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from flagstone.operators import flagging
from flagstone.sources import case_counts as C
from flagstone.sources import review_log as L
from tests.test_review_log import batch, create, edit, reviews


def flagged(spark, n=40):
    """Cases 0 to n - 1 of rules 3 and 14; some have several flagged rows."""
    rows = [(rule, f"{k}|n|s") for rule in ("3", "14") for k in range(n) for _ in range(1 + k % 3)]
    return spark.createDataFrame(rows, "rule_id string, case_key string")


def recount(spark, keys, log, version=None):
    left = flagging.unreviewed(keys, L.read_log(spark, log, version))
    return {r.rule_id: r.flagged for r in flagging.counts(left, spark).collect()}


def counts(spark, log, root, version=None):
    return {r.rule_id: r.flagged for r in C.open_counts(spark, log, root, version).collect()}


@pytest.fixture
def started(spark, tmp_path):
    log, root, keys = str(tmp_path / "log"), str(tmp_path / "counts"), flagged(spark)
    L.create_log(reviews(spark, range(0, 10)), log)
    assert C.start_counts(keys, log, root) == 0
    return log, root, keys


def test_equal_to_a_recount_after_any_batches(spark, tmp_path, started):
    log, root, keys = started
    rng = random.Random(3)
    for step in range(5):
        rows = [(create if rng.random() < 0.7 else edit)(100 * step + n, rng.randrange(60), rule=rng.choice(["3", "14"])) for n in range(8)]
        L.commit_batch(log, batch(spark, tmp_path, rows))
        if step % 2:
            assert counts(spark, log, root) == recount(spark, keys, log)
    L.compact(spark, log)
    L.commit_batch(log, batch(spark, tmp_path, []))
    assert counts(spark, log, root) == recount(spark, keys, log)
    for v in L.versions(spark, log):
        assert counts(spark, log, root, v) == recount(spark, keys, log, v)
    assert C.counted_versions(spark, root) == L.versions(spark, log)


def test_a_case_with_several_rows_and_one_that_is_not_flagged(spark, tmp_path, started):
    log, root, _ = started
    before = counts(spark, log, root)
    done = L.commit_batch(log, batch(spark, tmp_path, [create(1, 20), create(2, 20), create(3, 999), edit(4, 21), create(5, 5)]))
    after = counts(spark, log, root)
    assert {r: before[r] - after[r] for r in before if before[r] != after[r]} == {"3": 1 + 20 % 3}
    change = C.change_of(spark, log, root, done)
    assert [tuple(r) for r in change.collect()] == [("3", -3)]
    # the commit's outcomes and the ledger are all that is read
    files = {f.rsplit("/", 3)[1] if "rule_id=" not in f else "ledger" for f in change.inputFiles()}
    assert files == {done.outcomes, "ledger"} or all("/ledger/" in f or "/outcomes/" in f for f in change.inputFiles())


def test_two_updates_at_once_write_the_same(spark, tmp_path, started):
    log, root, keys = started
    for k in range(3):
        L.commit_batch(log, batch(spark, tmp_path, [create(k, 30 + k)]))
    threads = [threading.Thread(target=C.update_counts, args=(spark, log, root)) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert counts(spark, log, root) == recount(spark, keys, log)
    assert C.counted_versions(spark, root) == [0, 1, 2, 3]


def test_no_flagged_cases_and_no_start(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "counts")
    L.create_log(reviews(spark, range(3)), log)
    with pytest.raises(FileNotFoundError):
        C.open_counts(spark, log, root)
    C.start_counts(flagged(spark).where(F.lit(False)), log, root)
    assert set(counts(spark, log, root).values()) == {0}
