"""Round 3: what goes over the network for the order table and a batch, and digests summed in longs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF001
from tests.test_regressions import DECISION, decision, reviews_table

from flagstone.operators import leads
from flagstone.operators import reviews as R
from flagstone.sources import fixtures, manifest


def plan_nodes(df, kind):
    """Nodes of a kind in the optimised plan."""
    found, todo = [], [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName() == kind:
            found.append(node)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_order_rows_are_dealt_by_month_before_their_columns_are_derived(spark):
    df = fixtures.derive_by_month(spark, SF001)
    whole = fixtures.derive(spark, SF001, "assisted_orders")
    assert df.schema == whole.schema
    assert df.exceptAll(whole).isEmpty() and whole.exceptAll(df).isEmpty()
    dealt = [n for n in plan_nodes(df, "RepartitionByExpression") if n.partitionExpressions().size() == 2]
    assert len(dealt) == 1 and dealt[0].output().size() <= 9  # of 48 derived columns
    tables = [fixtures.fixture(spark, SF001, "assisted_orders").drop("order_month"), whole]
    assert tables[0].exceptAll(tables[1]).isEmpty() and tables[1].exceptAll(tables[0]).isEmpty()


def test_records_of_a_batch_go_through_one_join(spark):
    batch = [decision(1, brand="first"), decision(2, brand="second")]
    new, _ = R.apply_decisions(reviews_table(spark), spark.createDataFrame(batch, DECISION))
    assert len(plan_nodes(new, "Join")) == 1
    assert [r.brand_new for r in new.collect()] == ["first"]


@pytest.mark.parametrize("parts", [1, 7])
def test_digest_is_the_exact_sum_of_the_hashes(spark, parts):
    df = spark.range(0, 20000, 1, parts).select((F.col("id") % 3).alias("m"), "id", F.lit(dt.date(2026, 1, 1)).alias("d"))
    row = F.struct("id", "d")
    plain = [F.sum(F.xxhash64(F.lit(seed), row).cast("decimal(38,0)")).cast("string") for seed in (1, 2)]
    want = df.groupBy("m").agg(F.concat_ws("/", *plain).alias("x"))
    got = df.groupBy("m").agg(*manifest._digest(["id", "d"]))
    assert {r.m: r.x for r in want.collect()} == {r.m: r.digest for r in got.collect()}
    aggregated = plan_nodes(got, "Aggregate")[0].toString()
    assert "decimal" not in aggregated.split("sum(")[1].split(")")[0]


def test_keys_of_misrouted_leads_read_the_history_once(spark):
    history = fixtures.fixture(spark, SF001, "lead_history")
    cases = leads.lead_misrouted_cases(history, fixtures.fixture(spark, SF001, "team_budget"))
    keys = cases.select("rule_id", "case_key")
    assert len(plan_nodes(keys, "LogicalRelation")) == 1
    assert sorted(keys.collect()) == sorted(r[:2] for r in cases.collect()) != []


def test_first_agent_alone_in_its_category_among_nulls_and_blanks(spark):
    rows = [
        ("A", 1, "p", "gold"), ("A", 2, "q", "iron"),  # flagged
        ("B", 1, "p", "gold"), ("B", 2, "q", " GOLD "),  # a later agent fits as well
        ("C", 1, None, "gold"), ("C", 2, " ", "gold"), ("C", 3, "p", "gold"), ("C", 4, "q", None),  # flagged: nobody else counts
        ("D", 1, "p", "gold"),  # alone
        ("E", 1, "p", None), ("E", 2, "q", "gold"),  # the first has no category
        (None, 1, "p", "gold"), (None, 2, "q", "iron"),
    ]
    rows = [(n, lead, dt.datetime(2026, 1, day), who, what, 5.0) for n, (lead, day, who, what) in enumerate(rows)] * 2
    history = spark.createDataFrame(rows, "event_id long, lead_id string, updatedAt timestamp, assignedTo string, category string, final_order_value double")
    bands = spark.createDataFrame([("Gold", 0.0, None), ("gold ", 1.0, 9.0), ("iron", 0.0, None)], "category string, min_value double, max_value double")
    got = leads.lead_misrouted_cases(history, bands)
    want = [("A", "Gold", "q (iron)"), ("A", "gold ", "q (iron)"), ("C", "Gold", "q (NA)"), ("C", "gold ", "q (NA)")]
    assert sorted((r.lead_id, r.expected_category, r.other_assignees) for r in got.collect()) == want
