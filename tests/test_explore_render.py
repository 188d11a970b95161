import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.functions.text import display_text, group_digits
from flagstone.operators import explore, render


def test_indian_grouping_and_money(spark):
    df = spark.createDataFrame([(1234567.5,), (-5.0,), (1.005,), (100.0,), (99999.999,), (0.1,)], "x double")
    got = [r[0] for r in df.select(display_text(F.col("x"), "money", T.DoubleType())).collect()]
    assert got == ["₹12,34,567.5", "₹-5", "₹1.01", "₹100", "₹1,00,000", "₹0.1"]


def test_dates_and_instants(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 9, 1, 10, 5), dt.date(2026, 9, 1))],
                               T.StructType([T.StructField("t", T.TimestampNTZType()), T.StructField("d", T.DateType())]))
    r = df.select(display_text(F.col("t"), "datetime", T.TimestampNTZType()),
                  display_text(F.col("t"), "instant", T.TimestampNTZType()),
                  display_text(F.col("d"), "date", T.DateType())).first()
    assert tuple(r) == ("01 Sep 2026, 10:05", "01 Sep 2026, 15:35", "01 Sep 2026")


def _table(spark):
    return spark.createDataFrame(
        [(1, "A10"), (2, "A9"), (3, None), (4, ""), (5, "a2"), (6, "A9")], "pos int, code string")


def test_blanks_last_ascending_first_descending_ties_keep_base_order(spark):
    df = _table(spark)
    asc = explore.sort_keys(df, "code", False, "text", base_order=[("pos", False)])
    desc = explore.sort_keys(df, "code", True, "text", base_order=[("pos", False)])
    assert [r.pos for r in explore.sort_rows(df, asc).collect()] == [5, 2, 6, 1, 3, 4]  # a2 by its letter, whatever its case
    assert [r.pos for r in explore.sort_rows(df, desc).collect()] == [3, 4, 1, 2, 6, 5]


def test_page_is_clamped_and_reverse_path_matches(spark):
    df = spark.range(0, 237).withColumnRenamed("id", "v")
    keys = [(F.col("v"), False)]
    assert [r.v for r in explore.page(df, keys, 0, 50).collect()] == list(range(0, 50))
    assert [r.v for r in explore.page(df, keys, 3, 50).collect()] == list(range(150, 200))
    assert [r.v for r in explore.page(df, keys, 999, 50).collect()] == list(range(200, 237))


def test_search_spans_cells_and_blank_query_keeps_all(spark):
    df = spark.createDataFrame([("ab", "cd"), ("x", "y")], "a string, b string")
    assert explore.search_rows(df, "  ").count() == 2
    assert [tuple(r) for r in explore.search_rows(df, "B C").collect()] == [("ab", "cd")]


def test_resolve_columns_known_storage_and_humanised():
    schema = T.StructType([T.StructField("total_amount", T.DoubleType()), T.StructField("new_col_x", T.LongType())])
    cols = render.resolve_columns(schema)
    assert (cols[0].label, cols[0].type) == ("Total amount", "money")
    assert (cols[1].label, cols[1].type) == ("New col x", "int")


def test_summary_and_review_order():
    assert render.summary_columns(["x", "y", "lead_id", "z"]) == ["lead_id", "x", "y", "z"]
    assert render.summary_columns(["oldest_order_number", "sales_person", "total_amount", "tickets_id", "amount"]) == [
        "oldest_order_number", "sales_person", "total_amount", "amount"]


def test_group_digits_negative_zero(spark):
    df = spark.createDataFrame([(-0.001,)], "x double")
    assert df.select(group_digits(F.col("x"))).first()[0] == "-0"


def _ranged_pages_equal_topk(df, keys, n, page_size, max_task_rows):
    pages = -(-n // page_size)
    for number in range(pages):
        small = explore.page(df, keys, number, page_size, total_rows=n)
        ranged = explore.page(df, keys, number, page_size, total_rows=n, max_task_rows=max_task_rows)
        assert [tuple(r) for r in ranged.collect()] == [tuple(r) for r in small.collect()], number


def test_ranged_page_matches_topk_with_nulls_descending_and_text(spark):
    rows = [(i, None if i % 9 == 0 else f"A{(i * 7) % 23}", None if i % 5 == 0 else float(i % 11)) for i in range(230)]
    df = spark.createDataFrame(rows, "pos int, code string, amt double")
    asc = explore.sort_keys(df, "code", False, "text", base_order=[("pos", False)])
    desc = explore.sort_keys(df, "amt", True, "num", base_order=[("pos", True)])
    _ranged_pages_equal_topk(df, asc, 230, 25, 40)
    _ranged_pages_equal_topk(df, desc, 230, 25, 40)


def test_ranged_page_with_timestamps_and_ties(spark):
    base = dt.datetime(2026, 1, 1)
    rows = [(i, base + dt.timedelta(minutes=(i * 13) % 37)) for i in range(150)]
    df = spark.createDataFrame(rows, "pos int, t timestamp")
    keys = [(F.col("t"), False), (F.col("pos"), False)]
    _ranged_pages_equal_topk(df, keys, 150, 20, 30)


def test_ranged_page_inside_one_tie_group(spark):
    df = spark.createDataFrame([(1, "x")] * 120 + [(2, "y")] * 5, "v int, s string")
    keys = [(F.col("v"), False)]
    got = explore.page(df, keys, 1, 50, max_task_rows=30).collect()
    assert len(got) == 50 and all(tuple(r) == (1, "x") for r in got)
    tail = explore.page(df, keys, 2, 50, max_task_rows=30).collect()
    assert sorted(tuple(r) for r in tail) == [(1, "x")] * 20 + [(2, "y")] * 5


def test_ranged_page_with_dotted_column_names(spark):
    df = spark.createDataFrame([(i, f"x{i % 7}") for i in range(90)], "`a.b` int, `c` string")
    keys = [(F.col("c"), False), (F.col("`a.b`"), True)]
    _ranged_pages_equal_topk(df, keys, 90, 20, 25)
