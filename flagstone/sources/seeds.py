"""Seed review dataset for tests and the query catalogue (FIXTURES.md §6).

For each rule, every flagged row whose helper satisfies ``h % 7 = 3`` is already reviewed:
``h`` is the order key ``k`` (order rules), the closing event id (L1) or the numeric part of the
lead id (L2). The audit fields are deterministic expressions of ``h`` written once as SQL text
so the DuckDB oracle builds the same rows.
"""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone.operators.flagging import flag_all, hits
from flagstone.operators.leads import lead_misrouted_cases, lead_reopened_cases
from flagstone.operators.rules import RULES, RuleParams, find_rule, rules_on
from flagstone.sources.fixtures import fixture

SEED_AUDIT_SQL = {
    "auditor": "'Auditor ' || CAST(h%5 AS STRING)",
    "decision_types": "CASE h%3 WHEN 0 THEN 'Genuine' WHEN 1 THEN 'Fraud' ELSE '' END",
    "decided_sales_person": "CASE WHEN h%4=0 THEN NULL ELSE 'SP' || LPAD(CAST(h%25 AS STRING),2,'0') END",
    "comments": "'seed review ' || CAST(h AS STRING)",
    "created_by": "'auditor' || CAST(h%5 AS STRING) || '@example.com'",
    "created_at": "CAST({NTZ} '2026-06-01 00:00:00' + INTERVAL '1' MINUTE * h AS TIMESTAMP)",
    "updated_by": "'auditor' || CAST((h+h%2)%5 AS STRING) || '@example.com'",
    "updated_at": "CAST({NTZ} '2026-06-01 00:00:00' + INTERVAL '1' MINUTE * h + INTERVAL '1' DAY * (h%3) AS TIMESTAMP)",
}
AUDIT_FIELDS = ("auditor", "decision_types", "decided_sales_person", "comments")
AUDIT_META = ("created_by", "created_at", "updated_by", "updated_at")

L2_HELPER_SQL = "CAST(SUBSTR(lead_id,2) AS BIGINT)"


def seed_audit_sql(dialect_ntz: str) -> dict[str, str]:
    return {k: v.replace("{NTZ}", dialect_ntz) for k, v in SEED_AUDIT_SQL.items()}


def _with_audit(df: DataFrame) -> DataFrame:
    audit = seed_audit_sql("TIMESTAMP_NTZ")
    return df.select("*", *[F.expr(audit[c]).alias(c) for c in AUDIT_FIELDS + AUDIT_META]).drop("h")


_CODE_FILES = ("functions/keys.py", "operators/rules.py", "operators/flagging.py", "operators/leads.py",
               "sources/seeds.py", "sources/fixtures.py", "sources/snapshot.py")
_RESOLVED: dict[tuple, DataFrame] = {}


def _code_hash() -> str:
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for rel in _CODE_FILES:
        with open(os.path.join(root, rel), "rb") as f:
            h.update(f.read())
    return h.hexdigest()[:12]


def seed_reviews(
    spark: SparkSession,
    sf_dir: str,
    rule_ids: list[str] | None = None,
    with_record: bool = False,
    params: RuleParams = RuleParams(),
    materialize: bool | None = None,
) -> DataFrame:
    """Reviewed cases of the given rules (all by default): rule_id, case_key, [record], audit fields.

    Like the fixtures, the seed dataset is written once under ``spark.checkpoint.dir``
    (partitioned by rule_id, keyed by its sources, parameters and the code deriving it) and read
    back, as a stored review table would be. A relative cutoff (no ``as_of_date``) is never
    materialised."""
    from flagstone.session import checkpoint_dir
    from flagstone.sources.fixtures import FIXTURE_SQL, _fingerprint
    from flagstone.sources.snapshot import committed_versions, read_snapshot, refresh_snapshot

    ids = sorted(set(rule_ids or [r.id for r in RULES]))
    if materialize is None:
        materialize = spark.conf.get("flagstone.fixtures.materialize", "true").lower() == "true"
    if not materialize or params.as_of_date is None:
        return _build_seed_reviews(spark, sf_dir, ids, with_record, params)
    # audit instants come from wall-clock literals read in the session zone
    zone = spark.conf.get("spark.sql.session.timeZone")
    h = hashlib.sha1(repr((ids, with_record, params, _code_hash(), zone)).encode())
    for name in ("assisted_orders", "unassisted_orders", "lead_history"):
        h.update(_fingerprint(spark, sf_dir, name).encode())
    h.update(FIXTURE_SQL["team_budget"][0].encode())
    fp = h.hexdigest()[:16]
    key = (spark.sparkContext.applicationId, sf_dir, fp)
    if key in _RESOLVED:
        return _RESOLVED[key]
    root = f"{checkpoint_dir(spark)}/flagstone/seed_reviews/{fp}"
    if not committed_versions(spark, root):
        built = _build_seed_reviews(spark, sf_dir, ids, with_record, params)
        refresh_snapshot(built, root, version=uuid.uuid4().hex, partition_col="rule_id")
    out = read_snapshot(spark, root, version=committed_versions(spark, root)[0])
    _RESOLVED[key] = out
    return out


def flagged_parts(
    spark: SparkSession, sf_dir: str, rule_ids: list[str], with_record: bool, params: RuleParams
) -> list[DataFrame]:
    """:func:`flagged_rows` in parts, by what the rules read; each has the columns of its own rules' views alone."""
    ids = set(rule_ids)
    parts: list[DataFrame] = []
    none = F.lit(0).alias("s")
    order_specs = [r for r in rules_on("assisted_orders") if r.id in ids]
    if order_specs:
        hit = flag_all(fixture(spark, sf_dir, "assisted_orders"), order_specs, params)
        record = []
        if with_record:
            every = frozenset(s.id for s in order_specs)
            owners = {c: frozenset(s.id for s in order_specs if c in s.columns) for c in sorted({c for s in order_specs for c in s.columns})}
            # one test of the rule for all columns that the same rules show: with one a column, the JVM leaves the method uncompiled
            tests = {shown: f"_shown_{n}" for n, shown in enumerate(sorted({*owners.values()} - {every}, key=sorted))}
            hit = hit.select("*", *[F.col("rule_id").isin(*sorted(shown)).alias(name) for shown, name in tests.items()])
            record = [F.col(c) if shown == every else F.when(F.col(tests[shown]), F.col(c)).alias(c) for c, shown in owners.items()]
        parts.append(hit.select("rule_id", "case_key", *record, F.col("k").alias("h"), F.col("s").cast("int").alias("s")))
    if "11" in ids:
        spec = find_rule("11")
        rec = list(spec.columns) if with_record else []
        hit = hits(spec, fixture(spark, sf_dir, "unassisted_orders"), params)
        parts.append(hit.select("rule_id", "case_key", *rec, F.col("k").alias("h"), none))
    if ids & {"L1", "L2"}:
        history = fixture(spark, sf_dir, "lead_history")
        if "L1" in ids:
            rec = list(find_rule("L1").columns) if with_record else []
            l1 = lead_reopened_cases(history, params.reopen_min_gap_days)
            parts.append(l1.select("rule_id", "case_key", *rec, F.col("event_id").alias("h"), none))
        if "L2" in ids:
            bands = fixture(spark, sf_dir, "team_budget")
            rec = list(find_rule("L2").columns) if with_record else []
            parts.append(lead_misrouted_cases(history, bands).select("rule_id", "case_key", *rec, F.expr(L2_HELPER_SQL).alias("h"), none))
    return parts


def united(parts: list[DataFrame]) -> DataFrame:
    """All rows of ``parts``; columns that a part lacks are NULL."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def flagged_rows(
    spark: SparkSession, sf_dir: str, rule_ids: list[str], with_record: bool, params: RuleParams
) -> DataFrame:
    """Flagged rows of the given rules before review exclusion: rule_id, case_key, [record], h, s.

    (h, s) tells the rows of a rule apart. Columns that a rule's view lacks are NULL."""
    return united(flagged_parts(spark, sf_dir, rule_ids, with_record, params))


def _build_seed_reviews(
    spark: SparkSession, sf_dir: str, rule_ids: list[str], with_record: bool, params: RuleParams
) -> DataFrame:
    reviewed = flagged_rows(spark, sf_dir, rule_ids, with_record, params).where(F.col("h") % 7 == 3)
    # the record first, then the audit fields
    return _with_audit(reviewed.drop("s"))
