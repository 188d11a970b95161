"""Refresh of changed partitions only."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from flagstone.sources import manifest as M
from tests.conftest import rows


def orders(spark, months=("2026-01", "2026-02", "2026-03"), per_month=20, change=None):
    out = []
    for m, month in enumerate(months):
        for k in range(per_month):
            when = dt.datetime.strptime(month, "%Y-%m") + dt.timedelta(hours=k)
            out.append((100 * m + k, when, 1.0 * k + (0.5 if month == change else 0), None if k % 3 else "x"))
    return spark.createDataFrame(out, "id int, order_date_time timestamp_ntz, total_amount double, note string").repartition(3)


def files(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{root}/parts") for f in fs if f.endswith(".parquet")}


def test_one_changed_month_is_written_alone(spark, tmp_path):
    root = str(tmp_path / "s")
    M.refresh_changed(orders(spark), root)
    before = files(root)
    changed = orders(spark, change="2026-02")
    m = M.refresh_changed(changed, root)
    assert {v: p.version for v, p in m.parts.items()} == {"2026-01": 0, "2026-02": 1, "2026-03": 0}
    new = {f: t for f, t in files(root).items() if f not in before}
    assert new and all("order_month=2026-02" in f for f in new)
    assert {f: t for f, t in files(root).items() if f in before} == before
    assert rows(M.read_manifest(spark, root), *changed.columns) == rows(changed)
    assert rows(M.read_manifest(spark, root, 0), *changed.columns) == rows(orders(spark))
    assert rows(M.manifest_parts(spark, root)) == [("2026-01", 20, 0), ("2026-02", 20, 1), ("2026-03", 20, 0)]


def test_nothing_changed_new_and_vanished_months_and_order(spark, tmp_path):
    root = str(tmp_path / "s")
    M.refresh_changed(orders(spark), root)
    before = files(root)
    M.refresh_changed(orders(spark).orderBy(F.desc("id")).repartition(7), root)
    assert files(root) == before  # other order and split, same rows
    longer = orders(spark, months=("2026-01", "2026-02", "2026-03", "2026-04"))
    m = M.refresh_changed(longer, root)
    assert {v: p.version for v, p in m.parts.items()} == {"2026-01": 0, "2026-02": 0, "2026-03": 0, "2026-04": 2}
    shorter = orders(spark, months=("2026-01", "2026-02"))
    m = M.refresh_changed(shorter, root)
    assert set(m.parts) == {"2026-01", "2026-02"}
    assert rows(M.read_manifest(spark, root), *shorter.columns) == rows(shorter)


def test_a_repeated_row_and_a_null_count(spark, tmp_path):
    """Digests see how often a row comes, and null apart from blank."""
    root, base = str(tmp_path / "s"), orders(spark)
    M.refresh_changed(base, root)
    twice = base.union(base.where("id = 205"))
    assert {v: p.version for v, p in M.refresh_changed(twice, root).parts.items()}["2026-03"] == 1
    blank = twice.withColumn("note", F.when(F.col("id") == 1, "").otherwise(F.col("note")))
    assert {v: p.version for v, p in M.refresh_changed(blank, root).parts.items()} == {"2026-01": 2, "2026-02": 0, "2026-03": 1}
    nulls = blank.union(spark.createDataFrame([(999, None, 1.0, "n")], blank.schema))
    m = M.refresh_changed(nulls, root)
    assert m.parts[None].version == 3 and m.parts["2026-03"].version == 1
    assert rows(M.read_manifest(spark, root).where("order_month is null"), "id") == [(999,)]


def test_another_schema_writes_everything(spark, tmp_path):
    root = str(tmp_path / "s")
    M.refresh_changed(orders(spark), root)
    wider = orders(spark).withColumn("added", F.lit(1))
    m = M.refresh_changed(wider, root)
    assert {p.version for p in m.parts.values()} == {1}
    assert rows(M.read_manifest(spark, root), *wider.columns) == rows(wider)
    assert "added" not in M.read_manifest(spark, root, 0).columns


def test_two_refreshes_at_once(spark, tmp_path, monkeypatch):
    """The slower one finds the number taken, compares again and writes what the winner changed."""
    root = str(tmp_path / "s")
    M.refresh_changed(orders(spark), root)
    create, slow = M.create_if_absent, orders(spark, change="2026-01")

    def raced(spark_, path, text):
        monkeypatch.setattr(M, "create_if_absent", create)
        M.refresh_changed(orders(spark, change="2026-03"), root)  # wins
        return create(spark_, path, text)

    monkeypatch.setattr(M, "create_if_absent", raced)
    m = M.refresh_changed(slow, root)
    assert m.version == 2 and m.parts["2026-03"].version == 2
    assert rows(M.read_manifest(spark, root), *slow.columns) == rows(slow)
    assert rows(M.read_manifest(spark, root, 1), *slow.columns) == rows(orders(spark, change="2026-03"))


def test_open_readers_and_pruning(spark, tmp_path):
    root = str(tmp_path / "s")
    M.refresh_changed(orders(spark), root)
    for month in ("2026-01", "2026-02", "2026-03"):
        M.refresh_changed(orders(spark, change=month), root)
    open_reader = M.read_manifest(spark, root, 2)
    assert M.prune_manifests(spark, root, keep=2) == [0, 1]
    assert open_reader.count() == 60
    assert rows(M.read_manifest(spark, root), "id", "total_amount") == rows(orders(spark, change="2026-03"), "id", "total_amount")
    assert M.manifest_versions(spark, root) == [2, 3]
    with pytest.raises(FileNotFoundError):
        M.read_manifest(spark, root, 0)
    assert M.prune_manifests(spark, root, keep=2) == []


def test_partition_filter_and_empty_source(spark, tmp_path):
    root = str(tmp_path / "s")
    empty = orders(spark).where("id < 0")
    m = M.refresh_changed(empty, root)
    assert m.parts == {} and M.read_manifest(spark, root).count() == 0
    M.refresh_changed(orders(spark), root)
    one = M.read_manifest(spark, root).where("order_month = '2026-02'")
    assert "PartitionFilters: [isnotnull(order_month" in one._jdf.queryExecution().toString() and one.count() == 20
