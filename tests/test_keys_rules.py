import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.functions.keys import blank_trim, case_key, is_blank_key
from flagstone.operators import flagging
from flagstone.operators.rules import ORDER_KEY, RuleParams, find_rule

NTZ = T.TimestampNTZType()


def test_case_key_keeps_separators_and_is_never_null(spark):
    df = spark.createDataFrame(
        [("a", None, "b"), (None, "a", "b"), (None, None, None)],
        "oldest_order_number string, newest_order_no string, sales_person string",
    )
    keys = [r[0] for r in df.select(case_key(ORDER_KEY)).collect()]
    assert keys == ["a||b", "|a|b", "||"]
    assert [r[0] for r in df.select(is_blank_key(case_key(ORDER_KEY))).collect()] == [False, False, True]


def test_case_key_date_variant(spark):
    df = spark.createDataFrame([("L1", dt.datetime(2026, 3, 4, 23, 59))], T.StructType(
        [T.StructField("lead_id", T.StringType()), T.StructField("closed_at", NTZ)]))
    assert df.select(case_key(("lead_id", "closed_at:date"))).first()[0] == "L1|2026-03-04"


def test_blank_trim_strips_unicode_blanks(spark):
    df = spark.createDataFrame([("  x  ",), ("  ",)], "v string")
    assert [r[0] for r in df.select(blank_trim("v")).collect()] == ["x", ""]


def _orders(spark, rows):
    """Minimal order rows; unspecified columns are NULL."""
    schema = T.StructType([
        T.StructField("k", T.LongType()),
        T.StructField("payment_method", T.StringType()),
        T.StructField("username_frontend", T.StringType()),
        T.StructField("order_type_in_mtd_form", T.StringType()),
        T.StructField("first_connect_time_true_false", T.BooleanType()),
        T.StructField("pending_approval_02_step_timestamp", NTZ),
        T.StructField("diff_min_ticket_created_vs_02_pending_approval", T.LongType()),
        T.StructField("order_date_time", NTZ),
        T.StructField("invoice_status", T.StringType()),
        T.StructField("tickets_id", T.StringType()),
        T.StructField("current_order_status", T.StringType()),
        T.StructField("approval_timestamp", NTZ),
    ])
    full = []
    for r in rows:
        d = {f.name: None for f in schema.fields}
        d.update(r)
        full.append(tuple(d[f.name] for f in schema.fields))
    return spark.createDataFrame(full, schema)


def _ids(df, rule_id, params=RuleParams()):
    return sorted(r.k for r in flagging.rule_filter(find_rule(rule_id), df, params).select("k").collect())


def test_thirty_minute_band(spark):
    when = dt.datetime(2026, 2, 1, 10, 0)
    base = dict(payment_method="cashondelivery", order_type_in_mtd_form="COD-0", first_connect_time_true_false=False,
                pending_approval_02_step_timestamp=when, order_date_time=when)
    diffs = {1: 29, 2: 30, 3: 31, 4: -5, 5: None}
    df = _orders(spark, [dict(base, k=k, diff_min_ticket_created_vs_02_pending_approval=v) for k, v in diffs.items()])
    assert _ids(df, "1.2.1") == [1, 4]  # < 30, negatives included, NULL and 30 excluded
    assert _ids(df, "1.3") == [3]  # > 30 only: exactly 30 is in neither
    assert _ids(df, "1.2") == [1, 4]


def test_null_drops_rows_in_not_equal_and_not_in(spark):
    when = dt.datetime(2026, 2, 1, 10, 0)
    base = dict(payment_method="cashondelivery", order_type_in_mtd_form=None, first_connect_time_true_false=False,
                pending_approval_02_step_timestamp=when, order_date_time=when,
                diff_min_ticket_created_vs_02_pending_approval=1)
    old = dt.datetime(2026, 1, 5)
    seven = dict(invoice_status="Pending", tickets_id="CHQ-9", current_order_status="Processing",
                 approval_timestamp=old, order_date_time=old)
    df = _orders(spark, [
        dict(base, k=1),  # NULL order type: dropped by <> 'COD-30'
        dict(seven, k=2),
        dict(seven, k=3, invoice_status=None),  # NULL invoice: dropped by <> 'Paid'
        dict(seven, k=4, current_order_status=None),  # NULL status: dropped by NOT IN
    ])
    p = RuleParams(as_of_date=dt.date(2026, 10, 3))
    assert _ids(df, "1.2.1") == []
    assert _ids(df, "7", p) == [2]


def test_closed_status_hits_both_6_and_7(spark):
    old = dt.datetime(2026, 1, 5)
    df = _orders(spark, [dict(k=1, invoice_status="Pending", tickets_id="x CHQ-1", current_order_status="Closed",
                              approval_timestamp=old, order_date_time=old)])
    p = RuleParams(as_of_date=dt.date(2026, 10, 3))
    assert _ids(df, "6", p) == [1] and _ids(df, "7", p) == [1]


def test_cutoff_is_inclusive_local_midnight(spark):
    as_of = dt.date(2026, 10, 3)
    cutoff = dt.datetime(2026, 8, 4)  # as_of - 60 days, 00:00:00
    base = dict(invoice_status="Pending", tickets_id="CHQ-1", current_order_status="Processing",
                order_date_time=dt.datetime(2026, 1, 5))
    df = _orders(spark, [dict(base, k=1, approval_timestamp=cutoff),
                         dict(base, k=2, approval_timestamp=cutoff + dt.timedelta(seconds=1))])
    assert _ids(df, "7", RuleParams(as_of_date=as_of)) == [1]


def test_name_pattern_is_unanchored_and_case_sensitive(spark):
    names = {1: "Latest Shop", 2: "TEST CAPS", 3: "Ankita R", 4: None, 5: "test user"}
    df = spark.createDataFrame([(k, n, dt.date(2026, 2, 1)) for k, n in names.items()],
                               "k long, customer_name string, purchase_date date")
    assert _ids(df, "11") == [1, 3, 5]


def test_flag_all_equals_per_rule_flags(spark):
    from flagstone.operators.rules import rules_on
    from flagstone.sources.fixtures import fixture
    from tests.conftest import SF001

    base = fixture(spark, SF001, "assisted_orders")
    p = RuleParams(as_of_date=dt.date(2026, 10, 3))
    together = flagging.flag_all(base, params=p).groupBy("rule_id").count()
    got = {r.rule_id: r["count"] for r in together.collect()}
    for spec in rules_on("assisted_orders"):
        assert got.get(spec.id, 0) == flagging.rule_filter(spec, base, p).count(), spec.id


def test_unknown_rule_is_refused():
    import pytest

    with pytest.raises(KeyError):
        find_rule("4")
