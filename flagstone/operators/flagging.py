"""Flagging: rule specs -> flagged cases, minus the cases auditors already reviewed.

* ``flag``      one rule: filter -> key -> anti join reviews -> project -> order.
* ``flag_all``  every predicate rule of one base table in a single scan: each row carries the
                array of rule ids it hits, exploded into (rule_id, case_key, ...) rows.
* ``counts``    cases per rule with zero rows kept.

The anti join is a plain ``left_anti`` on (rule_id, case_key): Catalyst/AQE choose a broadcast
hash join when the reviewed keys are measured small and a sort-merge join otherwise, and AQE
splits skewed key partitions on the flagged side. Nothing is broadcast by hint here: the
review table grows with use, so its size is left to the runtime statistics.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.functions.keys import case_key
from flagstone.operators.rules import RULES, RuleParams, RuleSpec, find_rule, rules_on

# Partition column of a snapshot written by ``sources.snapshot.refresh_snapshot``.
MONTH_PARTITION = "order_month"


_EXPRESSIONS: dict[tuple, object] = {}


def _built_once(key: tuple, build):
    """A Column expression tree depends only on the rule specs and parameters, not on any
    DataFrame, but building one costs many JVM round trips; each is built once per application."""
    sc = SparkContext._active_spark_context
    k = (sc.applicationId if sc is not None else None,) + key
    if k not in _EXPRESSIONS:
        _EXPRESSIONS[k] = build()
    return _EXPRESSIONS[k]


def _spec_key(spec: RuleSpec) -> tuple:
    return (spec, id(spec.predicate))


def _pruning_hint(spec: RuleSpec, base: DataFrame) -> Column | None:
    """Derived predicate on the month partition implied by the rule's date floor (or None)."""
    if spec.floor_column == "order_date_time" and MONTH_PARTITION in base.columns and spec.floor_value:
        return F.col(MONTH_PARTITION) >= F.lit(spec.floor_value[:7])
    return None


def rule_filter(spec: RuleSpec, base: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Rows of ``base`` matched by the rule's predicate (no review exclusion)."""
    if spec.predicate is None:
        raise ValueError(f"rule {spec.id} is a pipeline, not a predicate rule")
    cond = _built_once(("predicate", _spec_key(spec), params), lambda: spec.predicate(params))
    hint = _pruning_hint(spec, base)
    if hint is not None:
        cond = hint & cond
    return base.where(cond)


def hits(spec: RuleSpec, base: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Flagged rows before review exclusion, with ``rule_id`` and ``case_key``."""
    key = _built_once(("key", spec.key_cols), lambda: case_key(spec.key_cols))
    return rule_filter(spec, base, params).select(F.lit(spec.id).alias("rule_id"), key.alias("case_key"), "*")


def reviewed_keys(reviews: DataFrame, rule_ids: Iterable[str] | None = None) -> DataFrame:
    """(rule_id, case_key) of reviewed cases, optionally restricted to some rules
    (a partition filter when the review dataset is partitioned by rule_id)."""
    r = reviews.select("rule_id", "case_key")
    if rule_ids is not None:
        r = r.where(F.col("rule_id").isin(list(rule_ids)))
    return r


def unreviewed(flagged: DataFrame, reviews: DataFrame, rule_ids: Iterable[str] | None = None) -> DataFrame:
    """Flagged rows whose (rule_id, case_key) has no review. NULL-safe because keys are never NULL."""
    return flagged.join(reviewed_keys(reviews, rule_ids), ["rule_id", "case_key"], "left_anti")


def order_columns(spec: RuleSpec, tie_break: tuple[str, ...] = ()) -> list[Column]:
    cols = [F.col(c).desc() if desc else F.col(c).asc() for c, desc in spec.order_by]
    return cols + [F.col(c).asc() for c in tie_break]


def finish(spec: RuleSpec, df: DataFrame, with_key: bool = False, ordered: bool = True) -> DataFrame:
    """Project the view columns and order them (case key as tie-break)."""
    if ordered:
        df = df.orderBy(*order_columns(spec, ("case_key",)))
    cols = (["case_key"] if with_key else []) + list(spec.columns)
    return df.select(*cols)


def flag(
    spec: RuleSpec | str,
    base: DataFrame,
    reviews: DataFrame,
    params: RuleParams = RuleParams(),
    with_key: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """One predicate rule end to end."""
    spec = find_rule(spec) if isinstance(spec, str) else spec
    flagged = unreviewed(hits(spec, base, params), reviews, [spec.id])
    return finish(spec, flagged, with_key=with_key, ordered=ordered)


def flag_all(
    base: DataFrame,
    specs: list[RuleSpec] | None = None,
    params: RuleParams = RuleParams(),
    base_name: str = "assisted_orders",
) -> DataFrame:
    """All predicate rules over one base table in one scan -> (rule_id, case_key, base columns...).

    Each predicate runs once per row. Rules sharing a key share one key expression. The array holds the
    rules that hit, so a row is copied once per hit and not at all without one.
    """
    specs = specs if specs is not None else rules_on(base_name)
    if not specs:
        raise ValueError("no predicate rules for this base table")
    key_cols = {s.key_cols for s in specs}
    if len(key_cols) != 1:
        raise ValueError("flag_all needs rules with one shared key")
    ids, key = _built_once(
        ("flag_all", tuple(_spec_key(s) for s in specs), params), lambda: _flag_all_columns(specs, params)
    )
    hit = base.select(F.explode(ids).alias("rule_id"), "*")
    return hit.select("rule_id", key.alias("case_key"), *[F.col(f"`{c}`") for c in base.columns])


def _flag_all_columns(specs: list[RuleSpec], params: RuleParams) -> tuple[Column, Column]:
    """(array of the ids of the rules hit; case key) of ``flag_all``."""
    none = F.array().cast("array<string>")
    # concat is compiled with the scan; filtering an array of all ids would be interpreted
    ids = F.concat(*[F.when(s.predicate(params), F.array(F.lit(s.id))).otherwise(none) for s in specs])
    return ids, case_key(specs[0].key_cols)


def counts(flagged_keys: DataFrame, spark: SparkSession, rule_ids: list[str] | None = None) -> DataFrame:
    """Cases per rule, registry order, zero rows kept -> (rule_id, title, flagged)."""
    rule_ids = rule_ids or [r.id for r in RULES]
    registry = spark.createDataFrame(
        [(i, find_rule(i).title, n) for n, i in enumerate(rule_ids)],
        T.StructType(
            [
                T.StructField("rule_id", T.StringType(), False),
                T.StructField("title", T.StringType(), False),
                T.StructField("position", T.IntegerType(), False),
            ]
        ),
    )
    per_rule = flagged_keys.groupBy("rule_id").agg(F.count(F.lit(1)).alias("flagged"))
    # per_rule holds one row per rule id that has hits, and rule ids come from the registry (18
    # rules): broadcasting it is bounded by construction, so the registry joins without a shuffle
    return (
        registry.join(F.broadcast(per_rule), "rule_id", "left")
        .select("rule_id", "title", F.coalesce("flagged", F.lit(0)).cast("long").alias("flagged"), "position")
        .orderBy("position")
        .drop("position")
    )
