"""Round 4: what a batch of decisions costs: trims, compiled methods, the join of a delta, reads of the log."""

import pytest
from pyspark.sql import functions as F
from tests.conftest import SF001
from tests.test_review_log import batch, create, edit, reviews, same
from tests.test_round03 import plan_nodes

from flagstone.functions.keys import blank_trim, form_trim, longer_in_utf16, utf16_length
from flagstone.operators.reviews import KEYS, apply_decisions, validate_decisions
from flagstone.operators.rules import RULES
from flagstone.plans.catalog import PARAMS
from flagstone.sources import decision_batch
from flagstone.sources import review_log as L
from flagstone.sources.seeds import flagged_rows

#: Bytes of a method above which the JVM never compiles it.
NOT_COMPILED = 8000


@pytest.mark.parametrize("end", ["\t\n\x0b\x0c\r ", "     ", "   　"])
def test_trims_strip_the_blanks_of_both_ends(spark, end):
    df = spark.createDataFrame([(f"{end}a{end}b{end}",), (end,), ("",), (None,), ("​a᠎",)], "v string")
    for trim in (form_trim, blank_trim):
        assert [r[0] for r in df.select(trim("v")).collect()] == [f"a{end}b", "", "", None, "​a᠎"]


def test_trims_differ_in_two_blanks(spark):
    df = spark.createDataFrame([("﻿a﻿",), ("\u0085a \u0085",)], "v string")
    # a form field keeps U+0085, also the blank before it at the very end
    assert [tuple(r) for r in df.select(form_trim("v"), blank_trim("v")).collect()] == [("a", "﻿a﻿"), ("\u0085a \u0085", "a")]


def test_lengths_are_in_utf16_units(spark):
    df = spark.createDataFrame([(t,) for t in ("x" * 4, "x" * 5, "é" * 4, "é" * 5, "€" * 4, "😀" * 2, "😀😀x", "", None)], "v string")
    assert [r[0] for r in df.select(longer_in_utf16(F.col("v"), 4)).collect()] == [False, True, False, True, False, False, True, False, None]
    assert df.where(longer_in_utf16(F.col("v"), 4) != (utf16_length(F.col("v")) > 4)).isEmpty()


def largest_methods(spark, df):
    """Bytes of the largest method of each compiled stage."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        stages = df.select("*")._jdf.queryExecution().debug().codegenToSeq()
        return [stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_methods_of_a_batch_are_small_enough_to_be_compiled(spark):
    decisions = decision_batch.decisions(spark, SF001, PARAMS)
    for df in (validate_decisions(decisions), decision_batch._derived(spark, SF001, PARAMS)):
        sizes = largest_methods(spark, df)
        assert sizes and max(sizes) < NOT_COMPILED


def test_batch_by_parts_is_the_text_over_all_rows(spark):
    rows = flagged_rows(spark, SF001, [r.id for r in RULES], True, PARAMS)
    text = decision_batch.DECISIONS_SQL.format(NTZ="TIMESTAMP_NTZ", TICK="INTERVAL '0.000001' SECOND", VARIANTS="explode(sequence(0, 7))", flagged_rows="{flagged_rows}")
    whole, got = spark.sql(text, flagged_rows=rows), decision_batch._derived(spark, SF001, PARAMS)
    assert whole.dtypes == got.dtypes
    same(whole, got)


def test_changed_reviews_are_those_of_saved_and_edited_cases(spark, tmp_path):
    base = reviews(spark, range(20))
    rows = [create(1, 5), create(2, 100), create(2, 100), edit(3, 100), edit(4, 200), create(5, 200), edit(6, 7), edit(7, 999), create(8, 101), create(9, 101)]
    b = batch(spark, tmp_path, [*rows, (None, *edit(10, 8)[1:]), (None, *create(11, 300)[1:])])
    whole, outcomes = apply_decisions(base, b)
    done = outcomes.where(F.col("status").isin("saved", "edited")).select(*KEYS).distinct()
    changed, outcomes2 = apply_decisions(base, b, changed_only=True)
    same(changed, whole.join(done, KEYS, "left_semi").select(*whole.columns))
    same(outcomes, outcomes2)
    assert len(plan_nodes(changed, "Join")) == 1


def test_reads_of_up_to_two_deltas_sum_up_nothing(spark, tmp_path):
    root, base = str(tmp_path / "log"), reviews(spark, range(30))
    L.create_log(base, root)
    want = base
    for n, rows in enumerate([[create(1, 50), edit(2, 3), edit(3, 4)], [edit(4, 4), edit(5, 50), create(6, 60)], [edit(7, 3), edit(8, 60), edit(9, 9)]], 1):
        b = batch(spark, tmp_path, rows)
        L.commit_batch(root, b)
        want, _ = apply_decisions(want, b)
        got = L.read_log(spark, root)
        same(got, want)
        assert (len(plan_nodes(got, "Aggregate")) == 0) == (n < 3)
