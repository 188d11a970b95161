"""Search by postings and pages by directory against the whole scan and the whole sort."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from flagstone.operators import explore as X
from flagstone.sources import search_index as S
from flagstone.sources.page_store import kept_directory


def orders(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [
        (f"O{k:06d}", rng.choice(["Åsa Öl", "ann", "BOB", None, ""]), float(rng.choice([10, 10, 2500, 50.5, 123456])) if k % 9 else None, dt.datetime(2026, 1, 1) + dt.timedelta(hours=k % 50))
        for k in range(n)
    ]
    return spark.createDataFrame(rows, "oldest_order_number string, sales_person string, total_amount double, order_date_time timestamp_ntz").repartition(3)


def listed(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("index") / "i")
    df = orders(spark)
    S.build_search_index(df, root)
    return root, df


@pytest.mark.parametrize("text", ["O000123", "o00012", "öl", "ÅSA", "ann 10", "bob  1", "2,500", "jan 2026", "10", "x", "", None, "  bob ", "nothing like it", "000"])
def test_same_rows_as_without_an_index(spark, index, text):
    root, df = index
    assert listed(S.search_indexed(spark, root, text)) == listed(X.search_rows(df, text))


def test_a_match_across_cells_and_many_blocks(spark, index, monkeypatch):
    root, df = index
    hay = df.select(X.haystack(df).alias("h")).where("h like 'o000123%'").first().h
    for at in (0, 3, 8, 12):  # stretches that begin in one cell and end in another
        text = hay[at : at + 14]
        assert listed(S.search_indexed(spark, root, text)) == listed(X.search_rows(df, text)) != []
    monkeypatch.setattr(S, "LISTED_BLOCKS", 1)
    assert listed(S.search_indexed(spark, root, "ann")) == listed(X.search_rows(df, "ann"))


def test_fewer_rows_are_read(spark, index):
    root, df = index
    blocks = S.candidate_blocks(spark, root, "o000123").count()
    every = spark.read.parquet(f"{root}/rows").select("_block").distinct().count()
    assert 1 <= blocks and 2 * blocks < every
    plan = S.search_indexed(spark, root, "O000123")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "_block" in plan.split("PushedFilters")[1]


def test_empty_table(spark, tmp_path):
    S.build_search_index(orders(spark).limit(0), str(tmp_path / "e"))
    assert S.search_indexed(spark, str(tmp_path / "e"), "abc").collect() == []
    assert S.search_indexed(spark, str(tmp_path / "e"), "").collect() == []


@pytest.mark.parametrize(("column", "descending"), [("total_amount", False), ("total_amount", True), ("sales_person", False), ("oldest_order_number", True)])
def test_pages_by_directory_are_the_sorted_list(spark, tmp_path, column, descending):
    """Many ties and NULLs; a third of the rows is one and the same."""
    df = orders(spark, 200).union(spark.createDataFrame([("same", "ann", 10.0, dt.datetime(2026, 1, 1))] * 100, orders(spark).schema))
    keys = X.sort_keys(df, column, descending)
    kept = kept_directory(df, keys, str(tmp_path), "v1", column, max_task_rows=20)
    assert kept_directory(df.limit(0), keys, str(tmp_path), "v1", column) == kept  # read, not made again
    pages = [list(map(str, X.page(df, keys, k, page_size=25, max_task_rows=20, directory=kept).collect())) for k in range(0, 12, 3)]
    whole = list(map(str, df.orderBy(*X._order(X._total(df, keys))).collect()))
    assert kept.rows == 300
    for k, got in zip(range(0, 12, 3), pages, strict=True):
        assert got == whole[25 * k : 25 * k + 25]


def test_a_page_needs_no_shuffle_of_all_rows(spark):
    df = orders(spark, 400)
    keys = X.sort_keys(df, "oldest_order_number")
    kept = X.page_directory(df, keys, max_task_rows=100)
    plan = X.page(df, keys, 5, page_size=20, max_task_rows=100, directory=kept)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
    assert X.PageDirectory.parsed(kept.text()) == kept


def test_pages_without_rows_and_beyond_the_end(spark):
    df = orders(spark, 30)
    keys = X.sort_keys(df, "total_amount")
    kept = X.page_directory(df, keys, max_task_rows=10)
    last = X.page(df, keys, 99, page_size=20, max_task_rows=10, directory=kept)
    assert last.count() == 10
    none = df.where(F.lit(False))
    assert X.page(none, keys, 0, directory=X.page_directory(none, keys)).collect() == []


def test_grams_are_all_stretches_in_one_pass(spark):
    texts = ["", "ab", "abc", "a\nb\r c d", "äöü₹12", "\U0001f600\U0001f601a\U0001f602b", "aaaaaa", "(..)[x]", None]
    wanted = [sorted({t[i : i + 3] for i in range(len(t) - 2)}) if t is not None else [] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    found = [r.g or [] for r in df.select("n", S.grams_of(F.col("t")).alias("g")).orderBy("n").collect()]
    assert [sorted(g) for g in found] == wanted and all(len(g) == len(set(g)) for g in found)
    started = time.monotonic()
    long = spark.range(1).select(F.lpad(F.lit(""), 400_000, "äbcd").alias("t"))
    assert long.select(F.size(S.grams_of(F.col("t"))).alias("n")).first().n == 4
    assert time.monotonic() - started < 15  # counting to each place from the start took minutes
