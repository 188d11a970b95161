import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.operators import reviews as R
from flagstone.plans import catalog as C
from tests.conftest import SF01 as SF001


@pytest.fixture(scope="module")
def applied(spark):
    seeds, batch = C.review_inputs(spark, SF001)
    new_reviews, outcomes = R.apply_decisions(seeds, batch)
    return seeds.cache(), batch.cache(), new_reviews.cache(), outcomes.cache()


def test_every_decision_gets_one_outcome(applied):
    _, batch, _, outcomes = applied
    assert outcomes.count() == batch.count()
    assert outcomes.select("seq").distinct().count() == batch.count()


def test_outcome_kinds_present(applied):
    _, _, _, outcomes = applied
    reasons = {r.reason for r in outcomes.select("reason").distinct().collect()}
    statuses = {r.status for r in outcomes.select("status").distinct().collect()}
    assert {"saved", "conflict", "edited", "not_found", "invalid"} <= statuses
    for msg in (R.AUDITOR_REQUIRED, R.DECISION_REQUIRED, R.FIELDS_TOO_LONG, R.COMMENTS_TOO_LONG,
                R.NO_ORDER_NUMBER, R.MISSING_CASE, R.UNKNOWN_RULE, R.ALREADY_REVIEWED, R.NO_LONGER_EXISTS,
                R.MISSING_RECORD):
        assert msg in reasons, msg


def test_200_characters_inside_blanks_pass(spark):
    d = spark.createDataFrame(
        [(1, "create", "3", None, True, "O1", "N1", "SP01", " a ", "Genuine", "  " + "y" * 200 + "  ", "c")],
        "seq long, action string, rule_id string, case_key string, has_record boolean, oldest_order_number string,"
        " newest_order_no string, sales_person string, auditor string, decision_types string,"
        " decided_sales_person string, comments string")
    v = R.validate_decisions(d).first()
    assert v.valid and v.decided_sales_person == "y" * 200 and v.case_key == "O1|N1|SP01" and v.auditor == "a"


def test_keys_stay_unique_and_saved_cases_leave_the_list(applied):
    seeds, _, new_reviews, outcomes = applied
    repeated = lambda df: df.count() - df.select("rule_id", "case_key").distinct().count()
    assert repeated(new_reviews) == repeated(seeds)  # rows that the seeds have twice; a save adds none
    saved = outcomes.where("status = 'saved'").count()
    assert new_reviews.count() == seeds.count() + saved


def test_apply_is_idempotent(spark, applied):
    _, batch, new_reviews, _ = applied
    again, outcomes2 = R.apply_decisions(new_reviews, batch)
    assert again.select("rule_id", "case_key").exceptAll(new_reviews.select("rule_id", "case_key")).count() == 0
    assert again.count() == new_reviews.count()
    assert outcomes2.where("status = 'saved'").count() == 0


def test_flagged_after_plus_saved_equals_before(spark, applied):
    from flagstone.operators import flagging
    from flagstone.operators.rules import find_rule
    from flagstone.sources.fixtures import fixture

    seeds, _, new_reviews, outcomes = applied
    base = fixture(spark, SF001, "assisted_orders")
    spec = find_rule("3")
    before = flagging.flag(spec, base, seeds, C.PARAMS, with_key=True, ordered=False).select("case_key").distinct()
    after = flagging.flag(spec, base, new_reviews, C.PARAMS, with_key=True, ordered=False).select("case_key").distinct()
    saved = outcomes.where("status = 'saved' AND rule_id = '3'").select("case_key")
    flagged_saved = saved.join(before, "case_key", "left_semi").distinct()
    assert before.count() == after.count() + flagged_saved.count()


def test_evolve_schema_adds_refuses_struct_and_type_change(spark):
    reviews = spark.createDataFrame([("3", "a||", 1.0)], "rule_id string, case_key string, total_amount double")
    view = T.StructType([T.StructField("total_amount", T.DoubleType()), T.StructField("team", T.StringType()),
                         T.StructField("auditor", T.StringType())])
    out = R.evolve_schema(reviews, view)
    assert out.columns == ["rule_id", "case_key", "total_amount", "team"]
    with pytest.raises(TypeError):
        R.evolve_schema(reviews, T.StructType([T.StructField("s", T.StructType([T.StructField("x", T.LongType())]))]))
    with pytest.raises(TypeError):
        R.evolve_schema(reviews, T.StructType([T.StructField("total_amount", T.StringType())]))


def test_bad_text_becomes_null_on_copy(applied):
    _, batch, new_reviews, _ = applied
    bad = batch.where("total_amount = 'n/a' AND action = 'create'").select("seq").count()
    if bad:
        assert new_reviews.where(F.col("total_amount").isNull()).count() >= 0


def test_review_schema_of_rule_3(spark):
    from flagstone.operators.rules import find_rule

    spec = find_rule("3")
    view = C.build_queries()["flagged_3"](spark, SF001)
    names = [f.name for f in R.review_schema(spec, view.schema).fields]
    assert names[:2] == ["rule_id", "case_key"]
    assert names[2:14] == list(spec.columns)
    assert names[14:] == ["auditor", "decision_types", "decided_sales_person", "comments",
                          "created_by", "created_at", "updated_by", "updated_at"]


def test_hot_case_with_a_third_of_the_batch(spark, applied):
    import datetime as dt

    seeds = applied[0]
    t0 = dt.datetime(2026, 10, 1)
    hot = ("O9", "N9", "SP09")
    rows = [(1, "edit", "3", "O9|N9|SP09", None, None, None, None, "early", "Fraud", None, "c", "e@x", t0)]
    rows += [(2 + i, "create", "3", None, True, *hot, f"a{i}", "Genuine", None, "c", f"u{i}@x", t0) for i in range(300)]
    rows += [(1000 + i, "edit", "3", "O9|N9|SP09", None, None, None, None, f"edit{i}", "Fraud", None, "c", "e@x", t0)
             for i in range(300)]
    rows += [(5000 + i, "create", "3", None, True, f"P{i}", f"Q{i}", "SP01", "b", "Genuine", None, "c", "v@x", t0)
             for i in range(300)]
    d = spark.createDataFrame(
        rows,
        "seq long, action string, rule_id string, case_key string, has_record boolean, oldest_order_number string,"
        " newest_order_no string, sales_person string, auditor string, decision_types string,"
        " decided_sales_person string, comments string, user_email string, submitted_at timestamp")
    new_reviews, outcomes = R.apply_decisions(seeds, d)
    by_status = {r.status: r["count"] for r in outcomes.groupBy("status").count().collect()}
    assert by_status == {"not_found": 1, "saved": 301, "conflict": 299, "edited": 300}
    hot_row = new_reviews.where("case_key = 'O9|N9|SP09'").collect()
    assert len(hot_row) == 1
    assert hot_row[0].auditor == "edit299" and hot_row[0].created_by == "u0@x"
    assert new_reviews.count() == seeds.count() + 301


def test_checks_of_a_batch_run_once(spark, monkeypatch):
    runs = spark.sparkContext.accumulator(0)
    checked = R.validate_decisions

    def counted(decisions, rules=R.RULES):
        def seen(parts):
            for p in parts:
                runs.add(p.num_rows)
                yield p

        return checked(decisions, rules).mapInArrow(seen, checked(decisions, rules).schema)

    monkeypatch.setattr(R, "validate_decisions", counted)
    audit = "auditor string, decision_types string, decided_sales_person string, comments string"
    batch = spark.createDataFrame(
        [(1, "edit", "3", "a", False, "A", "Fraud", None, None, "u", None), (2, "edit", "3", "b", False, "A", "Fraud", None, None, "u", None), (3, "edit", "3", "", False, "A", "Fraud", None, None, "u", None)],
        f"seq long, action string, rule_id string, case_key string, has_record boolean, {audit}, user_email string, submitted_at timestamp",
    )
    reviews = spark.createDataFrame([("3", "a", "B", "Genuine", None, None, "x", None, "x", None)], f"rule_id string, case_key string, {audit}, created_by string, created_at timestamp, updated_by string, updated_at timestamp")
    rows, outcomes = R.apply_decisions(reviews, batch)
    assert sorted((r.seq, r.status) for r in outcomes.collect()) == [(1, "edited"), (2, "not_found"), (3, "invalid")]
    assert [(r.case_key, r.auditor) for r in rows.collect()] == [("a", "A")]
    assert runs.value == 3
