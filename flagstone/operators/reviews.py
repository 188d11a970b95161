"""Review decisions as one batch job (the reference runs one MERGE / UPDATE per HTTP call).

``apply_decisions(reviews, decisions)`` validates every decision, inserts the first valid create
of each unreviewed case, refuses later creates of a reviewed case, applies edits in sequence
order and reports one outcome per decision. All steps are joins and aggregations keyed by
(rule_id, case_key): one shuffle on that key, partial aggregation for the "first create wins"
and "last edit wins" choices, so a case with many decisions costs one row per map task.

Parquet has no MERGE / UPDATE: the result is the next version of the review dataset, written
beside the old one by ``write_reviews_version`` (single writer assumed).

Decision rows: seq (total order), action ('create' | 'edit'), rule_id, case_key (edits),
has_record, record columns as text (creates), auditor, decision_types, decided_sales_person,
comments, user_email, submitted_at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.functions.keys import form_trim, is_blank_key, longer_in_utf16
from flagstone.operators.rules import RULES, RuleSpec
from flagstone.session import checkpoint_dir

# ---------------------------------------------------------------------------------------
# Messages, limits and reserved names of the reference's review writes.
# ---------------------------------------------------------------------------------------
AUDITOR_REQUIRED = "Auditor is required."
DECISION_REQUIRED = "Decision type is required."
FIELDS_TOO_LONG = "Auditor, decision type and decided sales person must be 200 characters or fewer."
COMMENTS_TOO_LONG = "Comments must be 4000 characters or fewer."
MISSING_RECORD = "Missing record."
NO_ORDER_NUMBER = "Record has no order number."
MISSING_CASE = "Missing case."
UNKNOWN_RULE = "Unknown investigation"
UNKNOWN_ACTION = "Unknown action."  # own message: only creates and edits can be asked for
ALREADY_REVIEWED = "This case has already been reviewed by someone else."
NO_LONGER_EXISTS = "That case no longer exists."
FIELD_MAX = 200
COMMENTS_MAX = 4000
RESERVED = (
    "case_key",
    "auditor",
    "decision_types",
    "decided_sales_person",
    "comments",
    "created_by",
    "created_at",
    "updated_by",
    "updated_at",
)
AUDIT_FIELDS = ("auditor", "decision_types", "decided_sales_person", "comments")
KEYS = ["rule_id", "case_key"]

#: Columns of a decision that are not part of its record.
DECISION_COLUMNS = ("seq", "action", "rule_id", "has_record", "user_email", "submitted_at", *RESERVED)

OUTCOME_COLUMNS = ("seq", "action", "rule_id", "case_key", "status", "reason")


def _record_key(spec: RuleSpec, columns: list[str]) -> Column:
    """Case key from a text record: NULL or a missing column -> '', ``:date`` keeps the first 10
    characters."""
    parts = []
    for k in spec.key_cols:
        name, _, kind = k.partition(":")
        c = F.col(name).cast("string") if name in columns else F.lit(None).cast("string")
        parts.append(F.coalesce(F.substring(c, 1, 10) if kind == "date" else c, F.lit("")))
    return F.concat_ws("|", *parts)


def _create_key(decisions: DataFrame, rules: tuple[RuleSpec, ...]) -> Column:
    """Key of a create, by the key columns of its rule (one branch per key shape)."""
    shapes: dict[tuple[str, ...], list[str]] = {}
    for spec in rules:
        shapes.setdefault(spec.key_cols, []).append(spec.id)
    expr = None
    for key_cols, ids in shapes.items():
        spec = next(r for r in rules if r.key_cols == key_cols)
        cond = F.col("rule_id").isin(ids)
        key = _record_key(spec, decisions.columns)
        expr = F.when(cond, key) if expr is None else expr.when(cond, key)
    return F.lit("") if expr is None else expr.otherwise(F.lit(""))


def validate_decisions(decisions: DataFrame, rules: tuple[RuleSpec, ...] = RULES) -> DataFrame:
    """Trim the four fields, compute the create key, and give the first failing check.

    Order: rule known -> action known -> fields (auditor, decision, lengths, comments) -> record present ->
    key not blank (creates) / key present (edits). Adds ``reason`` (NULL when valid), ``valid``.
    """
    known = F.coalesce(F.col("rule_id").isin([r.id for r in rules]), F.lit(False))
    trimmed = {f: F.coalesce(form_trim(F.col(f)), F.lit("")) for f in AUDIT_FIELDS}
    d = decisions.select(
        *[c for c in decisions.columns if c not in AUDIT_FIELDS and c != "case_key"],
        *[trimmed[f].alias(f) for f in AUDIT_FIELDS],
        F.when(F.col("action") == "create", _create_key(decisions, rules))
        .otherwise(F.col("case_key"))
        .alias("case_key"),
    )
    create = F.col("action") == "create"
    acts = F.coalesce(F.col("action").isin("create", "edit"), F.lit(False))
    too_long = (
        longer_in_utf16(F.col("auditor"), FIELD_MAX)
        | longer_in_utf16(F.col("decision_types"), FIELD_MAX)
        | longer_in_utf16(F.col("decided_sales_person"), FIELD_MAX)
    )
    reason = (
        F.when(~known, F.lit(UNKNOWN_RULE))
        .when(~acts, F.lit(UNKNOWN_ACTION))
        .when(F.col("auditor") == "", F.lit(AUDITOR_REQUIRED))
        .when(F.col("decision_types") == "", F.lit(DECISION_REQUIRED))
        .when(too_long, F.lit(FIELDS_TOO_LONG))
        .when(longer_in_utf16(F.col("comments"), COMMENTS_MAX), F.lit(COMMENTS_TOO_LONG))
        .when(create & ~F.coalesce(F.col("has_record"), F.lit(False)), F.lit(MISSING_RECORD))
        .when(create & is_blank_key(F.col("case_key")), F.lit(NO_ORDER_NUMBER))
        .when(~create & F.coalesce(F.col("case_key") == "", F.lit(True)), F.lit(MISSING_CASE))
    )
    return d.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())


def _typed_record(creates: DataFrame, target: T.StructType) -> list[Column]:
    """Record text -> the review table's column types; text that does not parse becomes NULL."""
    cols = []
    for f in target.fields:
        if f.name in RESERVED or f.name == "rule_id":
            continue
        if f.name in creates.columns:
            src = F.col(f.name)
            if isinstance(f.dataType, T.StringType):
                cols.append(src.cast("string").alias(f.name))
            else:
                cols.append(src.cast("string").try_cast(f.dataType).alias(f.name))
        else:
            cols.append(F.lit(None).cast(f.dataType).alias(f.name))
    return cols


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read back: what several steps read is worked out once."""
    path = f"{checkpoint_dir(df.sparkSession)}/flagstone/scratch/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def validated_decisions(decisions: DataFrame, rules: tuple[RuleSpec, ...] = RULES) -> DataFrame:
    """:func:`validate_decisions`, stored: the checks of a batch's texts cost more than all that follows."""
    return stored(validate_decisions(decisions, rules), "decisions")


def apply_decisions(reviews: DataFrame, decisions: DataFrame, rules: tuple[RuleSpec, ...] = RULES, validated: DataFrame | None = None, changed_only: bool = False):
    """-> (new_reviews, outcomes). Record columns of the batch that the review table lacks are
    appended to it first (as text, NULL for old rows), so no column of a saved record is lost.
    Every decision has one outcome.

    One aggregation per case named by the batch (partial before the shuffle) gives the first
    create and the last edit; the review keys say whether the case existed before the batch.
    Each decision is joined back to its case's row once for its outcome. The validated batch
    (``validated``, if the caller has it stored) and its cases are stored, as both results and
    several joins of each read them. With ``changed_only`` the reviews come without those of cases
    that the batch neither saved nor edited."""
    reviews = evolve_schema(reviews, T.StructType([f for f in decisions.schema.fields if f.name not in DECISION_COLUMNS]), retype=False)
    v = validated_decisions(decisions, rules) if validated is None else validated
    create = F.col("action") == "create"
    edit = F.col("action") == "edit"
    valid = v.where(F.col("valid"))
    last_edit_of = F.struct(*AUDIT_FIELDS, "user_email", "submitted_at", F.col("seq").alias("_seq"))
    cases = valid.groupBy(*KEYS).agg(
        F.min(F.when(create, F.col("seq"))).alias("win_seq"),
        F.max_by(last_edit_of, F.when(edit, F.col("seq"))).alias("_e"),
        F.max(edit).alias("_asked"),
    )
    # Only review keys named by the batch matter: the semi join with the batch's cases (one row
    # each, however many decisions a case has) filters the review table before its keys are made
    # distinct, so a batch never shuffles every key of a large review table.
    existing = reviews.select(*KEYS).join(cases.select(*KEYS), KEYS, "left_semi").distinct().withColumn("_old", F.lit(True))
    per_case = stored(cases.join(existing, KEYS, "left"), "cases")
    old = F.col("_old").isNotNull()
    d = valid.join(per_case, KEYS, "left")
    # a create wins when the case is new and it is the case's first create; an edit finds its
    # case when it existed before the batch or a create of the batch came first
    won = create & ~old & (F.col("seq") == F.col("win_seq"))
    found = old | F.coalesce(F.col("win_seq") < F.col("seq"), F.lit(False))
    decided_out = d.select(
        "seq", "action", *KEYS,
        F.when(won, F.lit("saved"))
        .when(create, F.lit("conflict"))
        .when(found, F.lit("edited"))
        .otherwise(F.lit("not_found"))
        .alias("status"),
        F.when(won | (edit & found), F.lit(None).cast("string"))
        .when(create, F.lit(ALREADY_REVIEWED))
        .otherwise(F.lit(NO_LONGER_EXISTS))
        .alias("reason"),
    )
    # The records of the creates go with the reviews through one join with the cases, which says both
    # which creates were saved and which edit a review ends with, so a record is shuffled once.
    creates = valid.where(create)
    new_rows = creates.select(
        "rule_id",
        "case_key",
        *_typed_record(creates, reviews.schema),
        *AUDIT_FIELDS,
        F.col("user_email").alias("created_by"),
        F.col("submitted_at").alias("created_at"),
        F.col("user_email").alias("updated_by"),
        F.col("submitted_at").alias("updated_at"),
        F.col("seq").alias("_create"),
        F.lit(True).alias("_new"),
    )
    kept = reviews.select("*", F.lit(None).cast(v.schema["seq"].dataType).alias("_create"), F.lit(False).alias("_new"))
    # the case's last edit applies when it found the case (the last edit overall is the last
    # found one whenever any edit found it: found edits are those after the first create)
    edits = F.col("_e").isNotNull() & (old | F.coalesce(F.col("_e._seq") > F.col("win_seq"), F.lit(False)))
    decided = per_case.select(
        *KEYS, F.when(~old, F.col("win_seq")).alias("_win"), F.when(edits, F.col("_e")).alias("_e"), (old & F.col("_asked")).alias("_found")
    )
    some = "_win is not null or _e is not null" + (" or _found" if changed_only else "")
    merged = kept.unionByName(new_rows.select(*kept.columns)).join(decided.where(some).drop("_found"), KEYS, "inner" if changed_only else "left")
    edited = merged.where(~F.col("_new") | (F.col("_create") == F.col("_win")))
    out_cols = []
    for name in reviews.columns:
        if name in AUDIT_FIELDS:
            out_cols.append(F.coalesce(F.col("_e")[name], F.col(name)).alias(name))
        elif name == "updated_by":
            out_cols.append(F.when(F.col("_e").isNotNull(), F.col("_e.user_email")).otherwise(F.col(name)).alias(name))
        elif name == "updated_at":
            out_cols.append(
                F.when(F.col("_e").isNotNull(), F.col("_e.submitted_at")).otherwise(F.col(name)).alias(name)
            )
        else:
            out_cols.append(F.col(name))
    new_reviews = edited.select(*out_cols)

    invalid_out = v.where(~F.col("valid")).select(
        "seq", "action", *KEYS,
        F.when(F.col("reason") == UNKNOWN_RULE, F.lit("not_found")).otherwise(F.lit("invalid")).alias("status"),
        "reason",
    )
    outcomes = invalid_out.unionByName(decided_out)
    return new_reviews, outcomes


def evolve_schema(reviews: DataFrame, view_schema: T.StructType, retype: bool = True) -> DataFrame:
    """Additive schema evolution: view columns missing from the review table are appended
    (typed, NULL for old rows). Reserved names are never copied; struct columns and a changed
    type of an existing column are refused (the latter not if ``retype`` is false, for records that
    come as text)."""
    have = {f.name: f.dataType for f in reviews.schema.fields}
    adds = []
    for f in view_schema.fields:
        if f.name in RESERVED:
            continue
        if isinstance(f.dataType, (T.StructType, T.MapType)):
            raise TypeError(f"Unsupported column type {f.dataType.simpleString()} for {f.name}")
        if f.name in have:
            if retype and have[f.name] != f.dataType:
                raise TypeError(
                    f"column {f.name} is {have[f.name].simpleString()} in the review table "
                    f"but {f.dataType.simpleString()} in the view"
                )
            continue
        adds.append(F.lit(None).cast(f.dataType).alias(f.name))
    return reviews.select("*", *adds) if adds else reviews


def review_schema(spec: RuleSpec, view_schema: T.StructType) -> T.StructType:
    """Declared review-table schema of a rule: rule_id + case_key + record columns + audit fields."""
    ts = T.TimestampType()
    fields = [T.StructField("rule_id", T.StringType(), False), T.StructField("case_key", T.StringType(), False)]
    fields += [f for f in view_schema.fields if f.name not in RESERVED and f.name in spec.columns]
    fields += [T.StructField(n, T.StringType(), True) for n in AUDIT_FIELDS]
    fields += [
        T.StructField("created_by", T.StringType(), True),
        T.StructField("created_at", ts, True),
        T.StructField("updated_by", T.StringType(), True),
        T.StructField("updated_at", ts, True),
    ]
    return T.StructType(fields)


def reviews_of(reviews: DataFrame, rule_id: str) -> DataFrame:
    """Reviewed cases of one rule, last edited first, case key kept out of the shown columns
    (A7). On a dataset partitioned by ``rule_id`` the filter prunes partitions."""
    return reviews.where(F.col("rule_id") == rule_id).orderBy(F.col("updated_at").desc_nulls_last(), "case_key")


def reviewed_counts(reviews: DataFrame) -> DataFrame:
    """Reviewed cases per rule."""
    return reviews.groupBy("rule_id").agg(F.count(F.lit(1)).alias("reviewed"))
