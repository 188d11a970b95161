"""Concurrent commits and merge on read of the review log, against the whole rewrite."""

import datetime as dt
import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from flagstone.operators.reviews import KEYS, apply_decisions
from flagstone.operators.rules import find_rule
from flagstone.sources import review_log as L
from flagstone.sources.snapshot import _fs

REVIEWS = (
    "rule_id string, case_key string, oldest_order_number string, newest_order_no string, sales_person string, total_amount double,"
    " auditor string, decision_types string, decided_sales_person string, comments string,"
    " created_by string, created_at timestamp, updated_by string, updated_at timestamp"
)
DECISIONS = (
    "seq long, action string, rule_id string, case_key string, has_record boolean, oldest_order_number string, newest_order_no string,"
    " sales_person string, total_amount string, auditor string, decision_types string, decided_sales_person string, comments string,"
    " user_email string, submitted_at timestamp"
)
START = dt.datetime(2026, 1, 1)


def reviews(spark, keys, rule="3"):
    rows = [(rule, f"{k}|n|s", str(k), "n", "s", 1.5, "a", "Genuine", None, f"old {k}", "u", START, "u", START) for k in keys]
    return spark.createDataFrame(rows, REVIEWS)


def create(seq, k, rule="3", by="x"):
    return (seq, "create", rule, None, True, str(k), "n", "s", "2.5", by, "Fraud", None, f"by {by}", by, START + dt.timedelta(seconds=seq))


def edit(seq, k, rule="3", by="x"):
    return (seq, "edit", rule, f"{k}|n|s", False, None, None, None, None, by, "Genuine", None, f"edit {by}", by, START + dt.timedelta(seconds=seq))


def batch(spark, tmp_path, rows, name=None):
    """A stored batch, as submitted batches are."""
    path = str(tmp_path / f"batch-{name or random.getrandbits(60)}")
    spark.createDataFrame(rows, DECISIONS).coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def same(a, b):
    assert set(a.columns) == set(b.columns)
    cols = sorted(a.columns)
    assert sorted(map(str, a.select(cols).collect())) == sorted(map(str, b.select(cols).collect()))


def test_a_commit_equals_the_whole_rewrite(spark, tmp_path):
    root, base = str(tmp_path / "log"), reviews(spark, range(50))
    assert L.create_log(base, root) == 0
    with pytest.raises(FileExistsError):
        L.create_log(base, root)
    b = batch(spark, tmp_path, [create(1, 10), create(2, 100), create(3, 100), edit(4, 100), edit(5, 7), edit(6, 999), (7, "create", "3", None, False, *[None] * 10)])
    done = L.commit_batch(root, b)
    rows, outcomes = apply_decisions(base, b)
    same(L.read_log(spark, root), rows)
    same(L.outcomes(spark, root, done), outcomes)
    same(L.read_log(spark, root, version=0), base)
    delta = spark.read.parquet(f"{root}/data/{done.data}")
    assert sorted(r.case_key for r in delta.collect()) == ["100|n|s", "7|n|s"]  # touched cases alone


def test_interleaved_batches_lose_nothing_and_the_loser_gets_conflicts(spark, tmp_path):
    root, base = str(tmp_path / "log"), reviews(spark, range(20))
    L.create_log(base, root)
    first = batch(spark, tmp_path, [create(1, 30, by="a"), create(2, 31, by="a"), edit(3, 5, by="a")])
    second = batch(spark, tmp_path, [create(4, 31, by="b"), create(5, 32, by="b"), edit(6, 5, by="b"), edit(7, 30, by="b")])
    a, b = L.stage(root, first), L.stage(root, second)  # both read version 0
    assert L.publish(root, a)
    assert not L.publish(root, b)
    assert L.rebase(root, b) is None
    done = L.commit_batch(root, second, staged=b)
    assert done.version == 2
    rows, _ = apply_decisions(base, first)
    rows, outcomes = apply_decisions(rows, second)
    same(L.read_log(spark, root), rows)
    same(L.outcomes(spark, root, done), outcomes)
    assert {r.seq: r.status for r in L.outcomes(spark, root, done).collect()} == {4: "conflict", 5: "saved", 6: "edited", 7: "edited"}
    fs, p = _fs(spark, f"{root}/data/{b.entry.data}")
    assert not fs.exists(p)  # the delta decided on version 0 is gone


def test_a_loser_without_shared_cases_keeps_its_delta(spark, tmp_path):
    root, base = str(tmp_path / "log"), reviews(spark, range(20))
    L.create_log(base, root)
    first = batch(spark, tmp_path, [create(1, 30), edit(2, 3)])
    second = batch(spark, tmp_path, [create(3, 40), edit(4, 4), edit(5, 77)])
    a, b = L.stage(root, first), L.stage(root, second)
    assert L.publish(root, b)
    done = L.commit_batch(root, first, staged=a)
    assert done.data == a.entry.data and done.version == 2
    rows, _ = apply_decisions(base, second)
    rows, _ = apply_decisions(rows, first)
    same(L.read_log(spark, root), rows)


def test_a_named_missing_case_that_the_winner_created_is_decided_again(spark, tmp_path):
    """An edit that found nothing on the old version finds the winner's case."""
    root = str(tmp_path / "log")
    L.create_log(reviews(spark, range(3)), root)
    late = L.stage(root, batch(spark, tmp_path, [edit(9, 50, by="late")]))
    L.commit_batch(root, batch(spark, tmp_path, [create(1, 50)]))
    done = L.commit_batch(root, late.decisions, staged=late)
    assert L.outcomes(spark, root, done).first().status == "edited"
    assert L.read_log(spark, root).where("case_key = '50|n|s'").first().auditor == "late"


def test_many_writers_at_once(spark, tmp_path):
    root = str(tmp_path / "log")
    L.create_log(reviews(spark, range(5)), root)
    batches = [batch(spark, tmp_path, [create(100 * w + k, k, by=f"w{w}") for k in range(3 * w, 3 * w + 6)]) for w in range(4)]
    done, errors = {}, []

    def run(w):
        try:
            done[w] = L.commit_batch(root, batches[w], batch=f"batch {w}")
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=run, args=(w,)) for w in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors
    assert sorted(e.version for e in done.values()) == [1, 2, 3, 4] == L.versions(spark, root)[1:]
    rows = L.read_log(spark, root)
    assert rows.count() == rows.select(*KEYS).distinct().count() == 15
    found = [L.outcomes(spark, root, e) for e in done.values()]
    saved = sum(o.where("status = 'saved'").count() for o in found)
    conflicts = sum(o.where("status = 'conflict'").count() for o in found)
    assert (saved, saved + conflicts) == (10, 24)  # every decision has its outcome, every case is saved once


def test_one_of_many_creates_the_file(spark, tmp_path):
    path, wins = str(tmp_path / "x" / "0.json"), []
    os.makedirs(tmp_path / "x")
    threads = [threading.Thread(target=lambda k=k: wins.append((L.create_if_absent(spark, path, f"text {k}"), k))) for k in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    winner = [k for won, k in wins if won]
    assert len(winner) == 1 and L.read_text(spark, path) == f"text {winner[0]}"
    assert [n for n in os.listdir(tmp_path / "x") if n.endswith(".draft")] == []


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_batches_and_compactions(spark, tmp_path, seed):
    rng, root = random.Random(seed), str(tmp_path / "log")
    whole = reviews(spark, range(10))
    L.create_log(whole, root)
    at = {0: whole}
    for step in range(6):
        if rng.random() < 0.35:
            e = L.compact(spark, root)
            if e:
                at[e.version] = whole
            continue
        rows = [(create if rng.random() < 0.6 else edit)(100 * step + n, rng.randrange(25), by=f"s{step}") for n in range(rng.randrange(0, 6))]
        b = batch(spark, tmp_path, rows, f"{seed}-{step}")
        done = L.commit_batch(root, b)
        whole = apply_decisions(whole, b)[0]
        at[done.version] = whole
    for version, rows in at.items():
        same(L.read_log(spark, root, version), rows)
    assert L.versions(spark, root) == sorted(at)


def test_compaction_does_not_hide_a_batch_committed_meanwhile(spark, tmp_path, monkeypatch):
    root, base = str(tmp_path / "log"), reviews(spark, range(10))
    L.create_log(base, root)
    first, second, third = (batch(spark, tmp_path, [create(k, 20 + k), edit(10 + k, 2, by=f"b{k}")]) for k in (1, 2, 3))
    L.commit_batch(root, first)
    written = L._write

    def slow(df, path, by_rule):
        schema = written(df, path, by_rule)
        if by_rule:
            monkeypatch.setattr(L, "_write", written)
            L.commit_batch(root, second)  # commits while the base is being written
        return schema

    monkeypatch.setattr(L, "_write", slow)
    e = L.compact(spark, root)
    assert (e.version, e.as_of) == (3, 1)
    L.commit_batch(root, third)
    rows = base
    for b in (first, second, third):
        rows = apply_decisions(rows, b)[0]
    same(L.read_log(spark, root), rows)
    L.compact(spark, root)
    same(L.read_log(spark, root), rows)
    assert L.compact(spark, root) is None


def test_written_bytes_follow_the_batch(spark, tmp_path):
    root = str(tmp_path / "log")
    L.create_log(spark.range(60_000).selectExpr("'3' as rule_id", "id || '|n|s' as case_key", "uuid() as comments", "string(id) as auditor", "'x' as decision_types", "'' as decided_sales_person", "'u' as created_by", "timestamp'2026-01-01' as created_at", "'u' as updated_by", "timestamp'2026-01-01' as updated_at"), root)
    done = L.commit_batch(root, batch(spark, tmp_path, [edit(k, 100 * k) for k in range(5)]))

    def size(kind, name):
        fs, p = _fs(spark, f"{root}/{kind}/{name}")
        return fs.getContentSummary(p).getLength()

    small = size("data", done.data) + size("outcomes", done.outcomes)
    assert small * 50 < size("data", L.entry(spark, root, 0).data)
    assert L.read_log(spark, root).where("comments = 'edit x'").count() == 5


def test_columns_that_batches_add(spark, tmp_path):
    root = str(tmp_path / "log")
    L.create_log(reviews(spark, range(3)), root)
    wider = batch(spark, tmp_path, [create(1, 40)]).withColumn("extra", F.lit("e"))
    L.commit_batch(root, wider)
    L.commit_batch(root, batch(spark, tmp_path, [create(2, 41), edit(3, 40)]))
    got = {r.case_key: r.extra for r in L.read_log(spark, root).collect()}
    assert got["40|n|s"] == "e" and got["41|n|s"] is None and got["0|n|s"] is None
    # a column of another type on both sides: decided again on the winner's table
    number = batch(spark, tmp_path, [create(4, 42)]).withColumn("other", F.lit(7))
    text = batch(spark, tmp_path, [create(5, 43)]).withColumn("other", F.lit("8"))
    a, b = L.stage(root, number), L.stage(root, text)
    assert L.publish(root, a) and L.rebase(root, b) is None
    L.commit_batch(root, text, staged=b)
    assert {r.other for r in L.read_log(spark, root).collect()} == {None, 7, 8}


def test_rules_with_other_keys_and_reading_one_rule(spark, tmp_path):
    root = str(tmp_path / "log")
    assert "lead_id" in find_rule("L1").key_cols
    L.create_log(reviews(spark, range(5)).union(reviews(spark, range(5), rule="14")), root)
    lead = batch(spark, tmp_path, [create(1, 9, rule="L1"), create(2, 9, rule="14")]).withColumns({"lead_id": F.lit("D1"), "closed_at": F.lit("2026-02-03 10:00:00")})
    L.commit_batch(root, lead)
    assert [r.case_key for r in L.read_log(spark, root, rule_ids=["L1"]).collect()] == ["D1|2026-02-03"]
    assert L.read_log(spark, root, rule_ids=["14"]).count() == 6
    assert "PartitionFilters" in L.read_log(spark, root, rule_ids=["14"])._jdf.queryExecution().toString()


def test_named_batches_commit_once(spark, tmp_path):
    root = str(tmp_path / "log")
    L.create_log(reviews(spark, range(3)), root)
    b = batch(spark, tmp_path, [create(1, 60)])
    first = L.commit_batch(root, b, batch="epoch 7")
    assert L.commit_batch(root, b, batch="epoch 7") == first
    assert L.versions(spark, root) == [0, 1]
    assert L.outcomes(spark, root, first).first().status == "saved"


def test_vacuum_keeps_what_versions_need(spark, tmp_path):
    root = str(tmp_path / "log")
    L.create_log(reviews(spark, range(5)), root)
    for k in range(3):
        L.commit_batch(root, batch(spark, tmp_path, [create(k, 70 + k)]))
    waiting = L.stage(root, batch(spark, tmp_path, [create(9, 90)]))
    L.compact(spark, root)
    before = sorted(map(str, L.read_log(spark, root).collect()))
    assert L.vacuum(spark, root, keep=10) == []
    assert len(L.vacuum(spark, root, keep=1)) == 4
    assert sorted(map(str, L.read_log(spark, root).collect())) == before
    assert L.commit_batch(root, waiting.decisions, staged=waiting).version == 5
    assert L.vacuum(spark, root, keep=1, orphans_after=dt.timedelta(0)) == []


def test_empty_batch_and_no_log(spark, tmp_path):
    root = str(tmp_path / "log")
    with pytest.raises(FileNotFoundError):
        L.read_log(spark, root)
    base = reviews(spark, range(3))
    L.create_log(base, root)
    done = L.commit_batch(root, batch(spark, tmp_path, []))
    assert L.outcomes(spark, root, done).count() == 0
    same(L.read_log(spark, root), base)
    with pytest.raises(FileNotFoundError):
        L.read_log(spark, root, version=9)
