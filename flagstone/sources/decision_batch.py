"""The batch of review decisions that tests and queries apply (FIXTURES.md §7).

It covers the flagged rows of all 18 rules. Each row makes the variants that its own values call for:
``day``, the day of the month of its order, purchase or closing time (leads without one: a step of
their order value), decides about variants and about faulty fields, the person about the auditor.

Variants: 0 edit ahead of any create; 1 create; 2 second create of the same case; 3 edit; 4 create
whose key columns are all NULL; 5 edit with an empty key; 6 create without a record; 7 edit of a case
that nobody has. Faulty fields: blank auditor, missing decision, 201 characters, 200 characters inside
blanks, a comment of 4,001 characters, an unknown rule, numbers that are none.

One text is run by Spark and by DuckDB; what differs between them is in braces.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone.operators.rules import RULES, RuleParams
from flagstone.sources.fixtures import _RESOLVED, _fingerprint
from flagstone.sources.seeds import _code_hash, flagged_parts, united

#: All columns that a rule's view shows, as the batch carries them: text.
RECORD_COLUMNS = sorted({c for r in RULES for c in r.columns})
#: Columns that make case keys; variant 4 leaves them out.
KEY_COLUMNS = sorted({k.partition(":")[0] for r in RULES for k in r.key_cols})
#: Columns of numbers; on some days the batch has words there.
NUMBER_COLUMNS = ("amount", "final_order_value", "total_amount")

_POSITION = "CASE rule_id " + " ".join(f"WHEN '{r.id}' THEN {n}" for n, r in enumerate(RULES)) + " END"


def _record_column(c: str) -> str:
    text = f"CAST({c} AS STRING)"
    if c in NUMBER_COLUMNS:
        text = f"CASE WHEN {c} IS NOT NULL AND day = 16 THEN 'n/a' ELSE {text} END"
    return f"CASE WHEN v IN ({'1,2' if c in KEY_COLUMNS else '1,2,4'}) THEN {text} END AS {c}"


DECISIONS_SQL = f"""
SELECT ((h*2+s)*{len(RULES)} + {_POSITION})*8 + v AS seq,
  CASE WHEN v IN (0,3,5,7) THEN 'edit' ELSE 'create' END AS action,
  CASE WHEN day = 13 THEN '4' ELSE rule_id END AS rule_id,
  CASE WHEN v = 5 THEN '' WHEN v IN (0,3) THEN case_key WHEN v = 7 THEN case_key || '?' END AS case_key,
  v <> 6 AS has_record,
  {",".join(_record_column(c) for c in RECORD_COLUMNS)},
  CASE WHEN day = 2 THEN '   ' ELSE 'Auditor ' || COALESCE(RIGHT(person, 1), '?') || CAST(v AS STRING) END AS auditor,
  CASE WHEN day = 3 THEN NULL WHEN day <= 9 THEN 'Genuine' WHEN day <= 17 THEN 'Fraud' ELSE ' Needs follow-up ' END AS decision_types,
  CASE WHEN day = 6 THEN REPEAT('x', 201) WHEN day = 9 THEN '  ' || REPEAT('y', 200) || '  ' ELSE person END AS decided_sales_person,
  CASE WHEN day = 11 THEN REPEAT('c', 4001) ELSE ' note ' || case_key || '/' || CAST(v AS STRING) || ' ' END AS comments,
  'auditor' || CAST(v AS STRING) || '@example.com' AS user_email,
  CAST({{NTZ}} '2026-10-01 00:00:00' + {{TICK}} * (((h*2+s)*{len(RULES)} + {_POSITION})*8 + v) AS TIMESTAMP) AS submitted_at
FROM (
  SELECT *, {{VARIANTS}} AS v,
    COALESCE(sales_person, assignedTo, first_assignee, customer_name) AS person,
    COALESCE(DAY(order_date_time), DAY(purchase_date), DAY(closed_at), LEAST(28, 1 + CAST(FLOOR(final_order_value/1500) AS INT)), 0) AS day
  FROM {{flagged_rows}}
) a
WHERE (v = 0 AND day = 10) OR (v = 1 AND day <= 18) OR (v = 2 AND day BETWEEN 4 AND 7) OR (v = 3 AND day BETWEEN 8 AND 26)
   OR (v = 4 AND day = 20) OR (v = 5 AND day = 22) OR (v = 6 AND day = 24) OR (v = 7 AND day = 27)
"""


def decisions(spark: SparkSession, sf_dir: str, params: RuleParams, materialize: bool | None = None) -> DataFrame:
    """The decision batch. Like the other derived inputs it is written once under
    ``spark.checkpoint.dir`` (keyed by its SQL, the code and tables it comes from and the session
    zone of its instants) and read back, as a submitted batch would be a stored file."""
    from flagstone.session import checkpoint_dir
    from flagstone.sources.snapshot import committed_versions, read_snapshot, refresh_snapshot

    if materialize is None:
        materialize = spark.conf.get("flagstone.fixtures.materialize", "true").lower() == "true"
    if not materialize or params.as_of_date is None:
        return _derived(spark, sf_dir, params)
    h = hashlib.sha1(repr((DECISIONS_SQL, params, _code_hash(), spark.conf.get("spark.sql.session.timeZone"))).encode())
    for name in ("assisted_orders", "unassisted_orders", "lead_history"):
        h.update(_fingerprint(spark, sf_dir, name).encode())
    fp = h.hexdigest()[:16]
    cache_key = (spark.sparkContext.applicationId, sf_dir, "decisions", fp)
    if cache_key not in _RESOLVED:
        root = f"{checkpoint_dir(spark)}/flagstone/fixtures/decisions-{fp}"
        if not committed_versions(spark, root):
            refresh_snapshot(_derived(spark, sf_dir, params), root, version=uuid.uuid4().hex, partition_col=None)
        _RESOLVED[cache_key] = read_snapshot(spark, root, version=committed_versions(spark, root)[0])
    return _RESOLVED[cache_key]


def _derived(spark: SparkSession, sf_dir: str, params: RuleParams) -> DataFrame:
    """The text over each part of the flagged rows: where columns are known to be NULL little is left of it."""
    text = DECISIONS_SQL.format(NTZ="TIMESTAMP_NTZ", TICK="INTERVAL '0.000001' SECOND", VARIANTS="explode(sequence(0, 7))", flagged_rows="{flagged_rows}")
    parts = flagged_parts(spark, sf_dir, [r.id for r in RULES], True, params)
    whole = united(parts).schema
    filled = [p.select(*[(F.col(f.name) if f.name in p.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in whole]) for p in parts]
    return united([spark.sql(text, flagged_rows=p) for p in filled])


def duckdb_decisions() -> str:
    """The batch as DuckDB text over a table ``flagged_rows`` (rule_id, case_key, h, s and all record columns)."""
    text = DECISIONS_SQL.format(NTZ="TIMESTAMP", TICK="INTERVAL '1 microsecond'", VARIANTS="unnest(range(0, 8))", flagged_rows="flagged_rows")
    return text.replace("STRING", "VARCHAR")
