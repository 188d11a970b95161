"""Inputs that were once wrong: each test holds one of them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone import schemas
from flagstone.functions.text import group_digits, number_text
from flagstone.operators import explore, flagging, leads, ranges
from flagstone.operators import reviews as R
from flagstone.operators.rules import RULES, find_rule
from flagstone.plans import catalog as C
from flagstone.session import checkpoint_dir
from flagstone.sources import snapshot as S
from flagstone.sources.fixtures import fixture
from tests.conftest import SF001

UTC = dt.timezone.utc


def test_listing_goes_by_date_alone(spark):
    rows = [(1, dt.date(2026, 3, 5), "2026-03"), (2, dt.date(2026, 3, 6), "2026-02"), (3, dt.date(2026, 3, 7), None), (4, dt.date(2026, 4, 1), "2026-03")]
    df = spark.createDataFrame(rows, "id int, date date, order_month string")
    assert [r.id for r in ranges.orders_in_range(df, "2026-03-01", "2026-03-31").collect()] == [3, 2, 1]


def test_listing_prunes_a_snapshot_by_the_month_of_its_date(spark, tmp_path):
    df = spark.createDataFrame([(i, dt.date(2026, 1 + i % 4, 3)) for i in range(20)], "id int, date date")
    S.refresh_snapshot(S.with_month(df, "date", ranges.DATE_MONTH), str(tmp_path / "s"), partition_col=ranges.DATE_MONTH)
    got = ranges.orders_in_range(S.read_snapshot(spark, str(tmp_path / "s")), "2026-02-01", "2026-02-28")
    assert {r.id for r in got.collect()} == {i for i in range(20) if i % 4 == 1}
    assert "PartitionFilters: [isnotnull(date_month" in got._jdf.queryExecution().executedPlan().toString()


def test_versions_are_ordered_by_commit_then_by_number(spark, tmp_path):
    root = str(tmp_path / "s")
    for v in ("v9", "v10"):
        S.refresh_snapshot(spark.createDataFrame([(v,)], "x string"), root, version=v, partition_col=None)
    assert S.committed_versions(spark, root) == ["v9", "v10"]
    assert S.read_snapshot(spark, root).first().x == "v10"
    assert S.prune_versions(spark, root, keep=1) == ["v9"]
    assert S.read_snapshot(spark, root).first().x == "v10"
    assert [p.name for p in (tmp_path / "s" / "_schemas").iterdir() if p.suffix == ".json"] == ["v10.json"]
    assert S._natural("v9") < S._natural("v10") < S._natural("v10a")
    refreshed = S.snapshot_info(spark, root).first().refreshed_at
    assert abs((dt.datetime.now(UTC).replace(tzinfo=None) - refreshed).total_seconds()) < 600


def test_pages_over_ties_hold_every_row_once(spark):
    df = spark.range(200).select(F.col("id"), (F.col("id") % 3).alias("v")).repartition(7)
    for limit in (50, explore.MAX_TASK_ROWS):
        pages = [explore.page(df, [(F.col("v"), False)], k, 20, total_rows=200, max_task_rows=limit).collect() for k in range(10)]
        assert sorted(r.id for p in pages for r in p) == list(range(200))
        assert [r.v for p in pages for r in p] == sorted(i % 3 for i in range(200))


def test_natural_sort_of_long_runs_and_by_letters(spark):
    codes = ["B1", "a1", "9" * 41, "1" + "0" * 41, "8" * 40, "007", "7a", None, ""]
    df = spark.createDataFrame([(c,) for c in codes], "c string")
    got = [r.c for r in explore.sort_rows(df, explore.sort_keys(df, "c", False, "text")).collect()]
    assert got[:-2] == ["007", "7a", "8" * 40, "9" * 41, "1" + "0" * 41, "a1", "B1"]


def test_numbers_of_any_size(spark):
    df = spark.createDataFrame([(1e30,), (-12345678.905,), (0.004,), (0.0,), (1e-9,), (1e-5,)], "x double")
    got = [tuple(r) for r in df.select(group_digits(F.col("x")), number_text(F.col("x"))).collect()]
    assert got[0] == ("10," + ",".join(["00"] * 13) + ",000", "1e30")
    assert got[1][0] == "-1,23,45,678.91" and got[2] == ("0", "0.004") and got[3] == ("0", "0")
    assert got[4] == ("0", "1e-9") and got[5] == ("0", "0.00001")


DECISION = (
    "seq long, action string, rule_id string, case_key string, has_record boolean, oldest_order_number string, newest_order_no string,"
    " sales_person string, auditor string, decision_types string, decided_sales_person string, comments string, user_email string,"
    " submitted_at timestamp, brand_new string, lead_id string, closed_at string"
)


def decision(seq, action="create", rule="3", key=None, record=True, order="O1", new="N1", person="S1", auditor="A", lead=None, closed=None, brand=None):
    return (seq, action, rule, key, record, order, new, person, auditor, "Fraud", None, "", "u@x", dt.datetime(2026, 1, 1), brand, lead, closed)


def reviews_table(spark, *rows):
    fields = "rule_id string, case_key string, oldest_order_number string, auditor string, decision_types string, decided_sales_person string, comments string, created_by string, created_at timestamp, updated_by string, updated_at timestamp"
    return spark.createDataFrame(list(rows), fields)


def test_every_decision_of_every_rule_has_an_outcome(spark):
    batch = [
        decision(1), decision(2, rule=None), decision(3, action="delete"), decision(4, action=None), decision(5, rule="L2", order=None),
        decision(6, rule="L1", lead="L7", closed="2026-03-04 10:00:00"), decision(7, rule="L2", lead="L7"), decision(8, rule="11", new=None, order=None),
        decision(9, rule="11", order="O9"), decision(10, action="edit", key="O1|N1|S1"), decision(11, rule="nope"),
    ]
    new, outcomes = R.apply_decisions(reviews_table(spark), spark.createDataFrame(batch, DECISION))
    got = {r.seq: (r.status, r.reason, r.case_key) for r in outcomes.collect()}
    assert len(got) == len(batch)
    assert got[1] == ("saved", None, "O1|N1|S1") and got[10][0] == "edited"
    assert got[2][:2] == got[11][:2] == ("not_found", R.UNKNOWN_RULE)
    assert got[3][:2] == got[4][:2] == ("invalid", R.UNKNOWN_ACTION)
    assert got[5][:2] == got[8][:2] == ("invalid", R.NO_ORDER_NUMBER)
    assert got[6] == ("saved", None, "L7|2026-03-04") and got[7] == ("saved", None, "L7")
    # the batch has no column newest_order_number: that part of the key is ''
    assert got[9] == ("saved", None, "O9|")
    assert {r.case_key for r in new.collect()} == {"O1|N1|S1", "L7|2026-03-04", "L7", "O9|"}


def test_new_record_columns_are_saved(spark):
    new, _ = R.apply_decisions(reviews_table(spark), spark.createDataFrame([decision(1, brand="kept")], DECISION))
    assert new.first().brand_new == "kept" and new.first().newest_order_no == "N1"


def test_lengths_are_utf16_units_and_form_blanks_are_stripped(spark):
    batch = [decision(1, auditor="😀" * 100), decision(2, auditor="😀" * 101), decision(3, auditor="﻿  a 　﻿"), decision(4, auditor="\u0085")]
    got = {r.seq: r for r in R.validate_decisions(spark.createDataFrame(batch, DECISION)).collect()}
    assert got[1].valid and got[2].reason == R.FIELDS_TOO_LONG and got[3].auditor == "a" and got[4].auditor == "\u0085"


def history(spark, rows):
    schema = "event_id long, lead_id string, state string, updatedAt timestamp, assignedTo string, category string, final_order_value double"
    return spark.createDataFrame(rows, schema)


def test_events_without_a_lead_are_no_misrouted_lead(spark):
    day = dt.datetime(2026, 1, 1, tzinfo=UTC)
    rows = [(i, lead, "New", day + dt.timedelta(days=i), f"a{i % 2}", ["Gold", "Silver"][i % 2], 15000.0) for i, lead in enumerate([None, None, "L1", "L1"])]
    bands = spark.createDataFrame([("Gold", 10000.0, 30000.0)], "category string, min_value double, max_value double")
    assert [r.lead_id for r in leads.lead_misrouted_cases(history(spark, rows), bands).collect()] == ["L1"]


def test_events_without_a_lead_are_split_like_a_heavy_lead(spark):
    day = dt.datetime(2026, 1, 1, tzinfo=UTC)
    states = ["New", "Closed", None, "closed", "Won"]
    rows = [(i, None if i % 2 else f"L{i % 3}", states[i * 7 % 5], day + dt.timedelta(minutes=i // 3), "a", "c", None) for i in range(120)]
    df = history(spark, rows)
    plain = leads.lead_transitions(df, max_events_per_task=0)
    split = leads.lead_transitions(df, max_events_per_task=5)
    assert "_seg" in split._jdf.queryExecution().analyzed().toString()
    key = lambda d: sorted(map(str, d.select("event_id", "prev_state", "next_state", "next_state_updatedAt").collect()))
    assert key(split) == key(plain)


def test_reopened_key_and_gap_are_of_utc_days(spark):
    rows = [
        (1, "L1", "Closed", dt.datetime(2026, 3, 5, 2, tzinfo=UTC), "a", "c", None),
        (2, "L1", "New", dt.datetime(2026, 5, 5, 1, tzinfo=UTC), "a", "c", None),
    ]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        df = history(spark, rows)
        for name in ("UTC", "America/New_York", "Asia/Kolkata"):
            spark.conf.set("spark.sql.session.timeZone", name)
            got = leads.lead_reopened_cases(df).first()
            assert (got.case_key, got.day_gap) == ("L1|2026-03-05", 61)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_declared_review_tables_take_the_views(spark):
    """All 18 review tables: key, the view's columns with the declared types, audit fields."""
    bands = fixture(spark, SF001, "team_budget")
    events = fixture(spark, SF001, "lead_history")
    empty = {}
    for spec in RULES:
        if spec.id == "L1":
            view = leads.lead_reopened_cases(events)
            assert view.schema["day_gap"].dataType == T.LongType()
        elif spec.id == "L2":
            view = leads.lead_misrouted_cases(events, bands)
        else:
            declared = schemas.ASSISTED_ORDERS if spec.base == "assisted_orders" else schemas.UNASSISTED_ORDERS
            view = spark.createDataFrame([], declared)
        view = view.select(*spec.columns)
        table = R.review_schema(spec, view.schema)
        assert table.names == ["rule_id", "case_key", *spec.columns, *R.AUDIT_FIELDS, "created_by", "created_at", "updated_by", "updated_at"]
        assert [table[c].dataType for c in spec.columns] == [view.schema[c].dataType for c in spec.columns]
        assert R.evolve_schema(spark.createDataFrame([], table), view.schema).columns == table.names
        empty[spec.id] = table
    assert len(empty) == 18


def test_tables_have_their_declared_types(spark):
    for name, schema in (("assisted_orders", schemas.ASSISTED_ORDERS), ("unassisted_orders", schemas.UNASSISTED_ORDERS), ("lead_history", schemas.LEAD_HISTORY)):
        got = {f.name: f.dataType for f in fixture(spark, SF001, name).schema.fields}
        assert {f.name: f.dataType for f in schema.fields}.items() <= got.items()


def test_results_come_in_their_order(spark):
    got = C.build_queries()["flagged_14"](spark, SF001).select("order_date_time").collect()
    assert got == sorted(got, reverse=True) and len(got) > 1
    times = [r.updated_at for r in C.reviews_list(spark, SF001).collect()]
    assert times == sorted(times, reverse=True) and len(times) > 1


def test_substring_rules_are_pushed_down_and_the_generator_is_compiled(spark):
    base = fixture(spark, SF001, "assisted_orders")
    plan = flagging.hits(find_rule("10"), base, C.PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(tickets_id" in plan
    once = flagging.flag_all(base, params=C.PARAMS)._jdf.queryExecution().executedPlan().toString()
    assert "*(1) Generate" in once


def test_unset_checkpoint_folder_is_refused(spark):
    class Unset:
        conf = {}
        sparkContext = type("Context", (), {"getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError):
        checkpoint_dir(Unset)
    assert checkpoint_dir(spark)
