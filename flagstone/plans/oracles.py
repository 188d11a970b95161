"""DuckDB oracle SQL, one statement per catalogue key.

Written independently of the Spark operators: rule predicates, keys, windows and joins are
plain SQL here. Only the inputs (fixture SQL of ``sources.fixtures`` and the seed audit
expressions) are shared text. Pinned as-of date: 2026-10-03.
"""

from __future__ import annotations

from flagstone.schemas import ASSISTED_ORDERS, UNASSISTED_ORDERS
from flagstone.sources.decision_batch import duckdb_decisions
from flagstone.sources.fixtures import duckdb_with
from flagstone.sources.seeds import AUDIT_FIELDS, AUDIT_META, L2_HELPER_SQL, seed_audit_sql

ORDER_KEY_SQL = "COALESCE(oldest_order_number,'') || '|' || COALESCE(newest_order_no,'') || '|' || COALESCE(sales_person,'')"
UNASSISTED_KEY_SQL = "COALESCE(oldest_order_number,'') || '|' || COALESCE(newest_order_number,'')"
L1_KEY_SQL = "COALESCE(lead_id,'') || '|' || COALESCE(CAST(CAST(closed_at AS DATE) AS VARCHAR),'')"
L2_KEY_SQL = "COALESCE(lead_id,'')"

_D26 = "order_date_time >= TIMESTAMP '2026-01-01 00:00:00'"
_M26 = "order_date_time >= TIMESTAMP '2026-05-01 00:00:00'"
_CANCEL8 = (
    "'Canceled - Follow Up not Required','Canceled - Support to Review','Canceled (Pending)',"
    "'Canceled - Sales to Review - Initiated','Canceled - Support to Handle - Initiated',"
    "'Canceled - Sales to Review','Canceled','Closed'"
)
_ENDED16 = (
    "'Canceled - Follow Up not Required','Canceled - Support to Review','Canceled (Pending)',"
    "'Canceled - Sales to Review - Initiated','Canceled - Support to Handle - Initiated',"
    "'Canceled - Sales to Review','Canceled','94.1 - RTO Received - Order To Be Cancelled',"
    "'96 - Replaced with New Accurate Order','9900 - Create Credit Memo (Processing) [Processing]',"
    "'9901 - Processing Refund [Processing]','9909 - Fully Refunded','9920 - Cancelled - Full Amount Forfeit',"
    "'9921 - Cancelled - Partial Amount Forfeit','9930 - Shipment lost by Logistic Partner',"
    "'961 - Cancelled Before Shipment (but invoice had been created)'"
)

# rule id -> (base table, predicate, key sql, view columns, ORDER BY)
ORACLE_RULES: dict[str, tuple[str, str, str, str, str]] = {}


def _cols(*names: str) -> str:
    return ", ".join(names)


_B12 = _cols(
    "approval_timestamp", "sales_person", "oldest_order_number", "order_date_time", "total_amount",
    "newest_order_no", "tickets_id", "ticket_created_at", "first_connected_time", "mtd_form_filled_timestamp",
    "username_frontend", "lead_sources",
)
_C11 = _cols(
    "approval_timestamp", "sales_person", "oldest_order_number", "order_date_time", "total_amount",
    "newest_order_no", "tickets_id", "ticket_id_text", "first_connected_time", "mtd_form_filled_timestamp",
    "username_frontend", "lead_sources", "payment_method", "order_type_in_mtd_form",
    "pending_approval_02_step_timestamp",
)
_C12 = _C11 + ", diff_min_ticket_created_vs_02_pending_approval"
_C121 = _B12 + ", payment_method, order_type_in_mtd_form, pending_approval_02_step_timestamp, diff_min_ticket_created_vs_02_pending_approval"
_C16 = _B12 + (
    ", payment_method, order_type_in_mtd_form, pending_approval_02_step_timestamp, current_order_status,"
    " lead_created_at, final_assigned_to_name"
)
_C14 = _C16 + ", helper_budget, assigned_team_acc_to_budget"

_A = "assisted_orders"
ORACLE_RULES.update(
    {
        "1.1": (_A, "payment_method = 'cashondelivery' AND username_frontend IS NULL AND order_type_in_mtd_form <> 'COD-30'"
                f" AND true_false_02_vs_ticket_created_date = TRUE AND {_D26}", ORDER_KEY_SQL, _C11, "order_date_time ASC"),
        "1.2": (_A, "payment_method = 'cashondelivery' AND username_frontend IS NULL AND order_type_in_mtd_form <> 'COD-30'"
                " AND diff_min_ticket_created_vs_02_pending_approval IS NOT NULL"
                " AND diff_min_ticket_created_vs_02_pending_approval < 30", ORDER_KEY_SQL, _C12, "order_date_time ASC"),
        "1.2.1": (_A, "payment_method = 'cashondelivery' AND order_type_in_mtd_form <> 'COD-30'"
                  " AND first_connect_time_true_false = FALSE AND pending_approval_02_step_timestamp IS NOT NULL"
                  " AND diff_min_ticket_created_vs_02_pending_approval IS NOT NULL"
                  f" AND diff_min_ticket_created_vs_02_pending_approval < 30 AND {_D26}", ORDER_KEY_SQL, _C121,
                  "order_date_time ASC"),
        "1.3": (_A, "payment_method = 'cashondelivery' AND order_type_in_mtd_form <> 'COD-30'"
                " AND first_connect_time_true_false = FALSE"
                f" AND diff_min_ticket_created_vs_02_pending_approval > 30 AND {_D26}", ORDER_KEY_SQL, _C121,
                "order_date_time ASC"),
        "1.4": (_A, "payment_method = 'cashondelivery' AND username_frontend IS NULL AND order_type_in_mtd_form = 'COD-30'"
                f" AND total_amount < 100000 AND {_D26}", ORDER_KEY_SQL, _C121, "order_date_time ASC"),
        "1.41": (_A, "payment_method = 'cashondelivery' AND username_frontend IS NULL AND total_amount < 50000",
                 ORDER_KEY_SQL, _C12, "order_date_time ASC"),
        "2": (_A, "strpos(ticket_id_text, 'CHQ-') > 0 AND username_frontend IS NULL"
              f" AND first_connect_time_true_false = TRUE AND {_D26}", ORDER_KEY_SQL,
              _B12 + ", diff_min_1st_connect_vs_10_order_approved", "order_date_time ASC"),
        "3": (_A, f"order_limit_team_wise_investigate = 'Investigate' AND {_D26}", ORDER_KEY_SQL, _B12,
              "order_date_time ASC"),
        "6": (_A, "invoice_status <> 'Paid' AND strpos(tickets_id, 'CHQ-') > 0"
              f" AND current_order_status IN ({_CANCEL8}) AND {_D26}", ORDER_KEY_SQL, _B12 + ", payment_method",
              "order_date_time ASC"),
        "7": (_A, "invoice_status <> 'Paid' AND strpos(tickets_id, 'CHQ-') > 0"
              f" AND current_order_status NOT IN ({_ENDED16})"
              " AND approval_timestamp <= CAST(DATE '2026-10-03' - INTERVAL 60 DAY AS TIMESTAMP)"
              f" AND {_D26}", ORDER_KEY_SQL, _B12 + ", payment_method, current_order_status", "order_date_time ASC"),
        "9": (_A, "strpos(tickets_id, 'CHQ-') > 0 AND username_frontend IS NULL AND order_phone_ne_lead_phone = FALSE"
              f" AND {_D26}", ORDER_KEY_SQL,
              _cols("approval_timestamp", "sales_person", "oldest_order_number", "order_date_time", "customer_name",
                    "total_amount", "newest_order_no", "tickets_id", "ticket_created_at", "first_connected_time",
                    "mtd_form_filled_timestamp", "username_frontend", "lead_sources", "order_phone_number_1",
                    "lead_phone_number"), "order_date_time ASC"),
        "10": (_A, "ticket_created_at IS NULL AND tickets_id IS NOT NULL AND strpos(tickets_id, 'CHQ-') > 0",
               ORDER_KEY_SQL,
               _cols("approval_timestamp", "sales_person", "oldest_order_number", "order_date_time", "total_amount",
                     "newest_order_no", "tickets_id", "ticket_created_at", "first_connected_time",
                     "mtd_form_filled_timestamp", "first_connect_time_true_false", "lead_sources"),
               "order_date_time ASC"),
        "11": ("unassisted_orders", "regexp_matches(customer_name, 'test|Test|Pawan|Ankit')"
               " AND purchase_date >= DATE '2026-01-01'", UNASSISTED_KEY_SQL,
               "purchase_date, oldest_order_number, customer_name, amount, newest_order_number", "purchase_date ASC"),
        "14": (_A, "team <> assigned_to_team AND name_as_per_lead_budget IS NOT NULL"
               f" AND {_M26} AND tickets_id IS NOT NULL AND strpos(tickets_id, 'CHQ-') > 0", ORDER_KEY_SQL, _C14,
               "order_date_time DESC"),
        "15": (_A, "invalid_sales_team_flag IS NOT NULL AND helper_budget IS NOT NULL"
               f" AND {_M26} AND tickets_id IS NOT NULL AND strpos(tickets_id, 'CHQ-') > 0", ORDER_KEY_SQL, _C14,
               "order_date_time DESC"),
        "16": (_A, "ticket_id_beyond_90_days IS NOT NULL AND date >= DATE '2026-01-01'"
               " AND tickets_id IS NOT NULL AND strpos(tickets_id, 'CHQ-') > 0", ORDER_KEY_SQL, _C16,
               "order_date_time DESC"),
    }
)

ORDER_RULE_IDS = [i for i, v in ORACLE_RULES.items() if v[0] == _A]

# --- lead pipelines --------------------------------------------------------------------

# A lead is re-opened when an entry into 'closed' (the event before it, if any, was not closed) is
# followed by any other state, and the first such event lies over 60 days later.
L1_CASES_SQL = """
WITH events AS (
  SELECT *, row_number() OVER (PARTITION BY lead_id ORDER BY updatedAt NULLS FIRST, event_id) AS n FROM lead_history
), entered AS (
  SELECT c.* FROM events c LEFT JOIN events b ON b.lead_id IS NOT DISTINCT FROM c.lead_id AND b.n = c.n - 1
  WHERE c.state ILIKE 'closed' AND (b.state IS NULL OR b.state NOT ILIKE 'closed')
), reopened AS (
  SELECT c.event_id, min_by(e.state, e.n) AS next_state, min_by(e.updatedAt, e.n) AS next_state_updatedAt
  FROM entered c JOIN events e ON e.lead_id IS NOT DISTINCT FROM c.lead_id AND e.n > c.n AND e.state NOT ILIKE 'closed'
  GROUP BY c.event_id
)
SELECT c.lead_id, c.state AS closed_state, c.updatedAt AS closed_at, r.next_state, r.next_state_updatedAt,
  CAST(r.next_state_updatedAt AS DATE) - CAST(c.updatedAt AS DATE) AS day_gap, c.assignedTo, c.event_id
FROM entered c JOIN reopened r ON r.event_id = c.event_id
WHERE CAST(r.next_state_updatedAt AS DATE) - CAST(c.updatedAt AS DATE) > 60
"""

_TRIM = "regexp_replace({x}, '^[\\s\\p{{Z}}\\x{{{more}}}]+|[\\s\\p{{Z}}\\x{{{more}}}]+$', '', 'g')"


def _utrim(x: str) -> str:
    """Without the warehouse's blanks at both ends."""
    return _TRIM.format(x=x, more="85")


def _ftrim(x: str) -> str:
    """Without a form's blanks at both ends."""
    return _TRIM.format(x=x, more="FEFF")


def _units(x: str) -> str:
    """Length in UTF-16 units."""
    return f"(length({x}) + length(regexp_replace({x}, '[^\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')))"


# A lead is misrouted when, of two agents or more, the earliest has the category that the lead's
# latest value calls for, and none of the others has.
L2_CASES_SQL = f"""
WITH agents AS (
  SELECT lead_id, assignedTo AS agent, min(updatedAt) AS since,
    first(category ORDER BY updatedAt NULLS FIRST, event_id) AS category
  FROM lead_history WHERE lead_id IS NOT NULL AND {_utrim('assignedTo')} <> '' GROUP BY ALL
), leads AS (
  SELECT lead_id, last(final_order_value ORDER BY updatedAt NULLS FIRST, event_id) AS worth
  FROM lead_history WHERE final_order_value IS NOT NULL AND lead_id IS NOT NULL GROUP BY lead_id
), wanted AS (
  SELECT DISTINCT l.lead_id, l.worth, b.category AS want
  FROM leads l JOIN team_budget b ON l.worth >= b.min_value AND l.worth < coalesce(b.max_value, 'infinity'::DOUBLE)
), teams AS (
  SELECT w.lead_id, w.worth, w.want, list(a ORDER BY a.since NULLS FIRST, a.agent) AS team
  FROM wanted w JOIN agents a ON a.lead_id = w.lead_id GROUP BY ALL
)
SELECT lead_id, worth AS final_order_value, want AS expected_category, CAST(len(team) AS BIGINT) AS agent_count,
  team[1].agent AS first_assignee, team[1].category AS first_assignee_category,
  array_to_string(list_transform(team[2:], lambda x: x.agent || ' (' || coalesce(x.category, 'NA') || ')'), ', ') AS other_assignees,
  'First Right, Others Wrong' AS Assignment_Flag
FROM teams
WHERE len(team) > 1 AND upper({_utrim('team[1].category')}) = upper({_utrim('want')})
  AND NOT list_contains(list_transform(team[2:], lambda x: upper({_utrim("coalesce(x.category, '')")})), upper({_utrim('want')}))
"""

L1_COLS = "lead_id, closed_state, closed_at, next_state, next_state_updatedAt, day_gap, assignedTo"
L2_COLS = (
    "lead_id, final_order_value, expected_category, agent_count, first_assignee, first_assignee_category,"
    " other_assignees, Assignment_Flag"
)


def _audit_select() -> str:
    audit = seed_audit_sql("TIMESTAMP").items()
    audit = [(k, v.replace("STRING", "VARCHAR")) for k, v in audit]
    return ", ".join(f"{v} AS {k}" for k, v in audit if k in AUDIT_FIELDS + AUDIT_META)


def seed_sql(rule_ids: list[str]) -> str:
    """Seed reviews (rule_id, case_key, h) of the given rules as one UNION ALL."""
    parts = []
    for rid in rule_ids:
        if rid in ORACLE_RULES:
            base, pred, key, _, _ = ORACLE_RULES[rid]
            parts.append(f"SELECT '{rid}' AS rule_id, {key} AS case_key, k AS h FROM {base} WHERE ({pred}) AND k%7=3")
        elif rid == "L1":
            parts.append(f"SELECT 'L1' AS rule_id, {L1_KEY_SQL} AS case_key, event_id AS h FROM l1_cases WHERE event_id%7=3")
        elif rid == "L2":
            parts.append(
                f"SELECT 'L2' AS rule_id, {L2_KEY_SQL} AS case_key, {L2_HELPER_SQL} AS h FROM l2_cases"
                f" WHERE {L2_HELPER_SQL}%7=3"
            )
    return "\nUNION ALL\n".join(parts)


def reviews_cte(rule_ids: list[str]) -> str:
    return f"SELECT rule_id, case_key, {_audit_select()} FROM (\n{seed_sql(rule_ids)}\n) s"


def _needs(rule_ids: list[str]) -> list[str]:
    need = []
    if any(ORACLE_RULES.get(r, ("",))[0] == _A for r in rule_ids):
        need.append("assisted_orders")
    if "11" in rule_ids:
        need.append("unassisted_orders")
    if "L1" in rule_ids or "L2" in rule_ids:
        need.append("lead_history")
    if "L2" in rule_ids:
        need.append("team_budget")
    return need


def with_reviews(rule_ids: list[str], extra_fixtures: tuple[str, ...] = ()) -> str:
    fx = _needs(rule_ids)
    fx += [f for f in extra_fixtures if f not in fx]
    extra = {}
    if "L1" in rule_ids:
        extra["l1_cases"] = L1_CASES_SQL
    if "L2" in rule_ids:
        extra["l2_cases"] = L2_CASES_SQL
    extra["reviews"] = reviews_cte(rule_ids)
    return duckdb_with(*fx, extra=extra)


def flagged_sql(rule_id: str) -> str:
    base, pred, key, cols, order = ORACLE_RULES[rule_id]
    return (
        with_reviews([rule_id])
        + f"SELECT {cols} FROM {base} o WHERE ({pred}) AND NOT EXISTS ("
        f"SELECT 1 FROM reviews r WHERE r.rule_id = '{rule_id}' AND r.case_key = {key.replace('COALESCE(', 'COALESCE(o.')})"
        f" ORDER BY {order}"
    )


def lead_reopened_sql() -> str:
    return (
        with_reviews(["L1"])
        + f"SELECT {L1_COLS} FROM l1_cases o WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.rule_id = 'L1'"
        " AND r.case_key = COALESCE(o.lead_id,'') || '|' || COALESCE(CAST(CAST(o.closed_at AS DATE) AS VARCHAR),''))"
        " ORDER BY next_state_updatedAt DESC"
    )


def lead_misrouted_sql() -> str:
    return (
        with_reviews(["L2"])
        + f"SELECT {L2_COLS} FROM l2_cases o WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.rule_id = 'L2'"
        f" AND r.case_key = COALESCE(o.lead_id,'')) ORDER BY lead_id"
    )


ALL_RULE_IDS = list(ORACLE_RULES) + ["L1", "L2"]
TITLES = {rid: ("#" + rid if rid[0] != "L" else "Lead #" + rid[1:]) for rid in ALL_RULE_IDS}
REGISTRY_ORDER = ["1.1", "1.2", "1.2.1", "1.3", "1.4", "1.41", "2", "3", "6", "7", "9", "10", "11", "14", "15", "16", "L1", "L2"]


def flagged_keys_sql() -> str:
    """UNION ALL of (rule_id, case_key) of every flagged case, before review exclusion."""
    parts = []
    for rid in REGISTRY_ORDER:
        if rid in ORACLE_RULES:
            base, pred, key, _, _ = ORACLE_RULES[rid]
            parts.append(f"SELECT '{rid}' AS rule_id, {key} AS case_key FROM {base} WHERE {pred}")
        elif rid == "L1":
            parts.append(f"SELECT 'L1' AS rule_id, {L1_KEY_SQL} AS case_key FROM l1_cases")
        else:
            parts.append(f"SELECT 'L2' AS rule_id, {L2_KEY_SQL} AS case_key FROM l2_cases")
    return "\nUNION ALL\n".join(parts)


def flagged_counts_sql() -> str:
    registry = " UNION ALL ".join(
        f"SELECT '{rid}' AS rule_id, '{TITLES[rid]}' AS title, {n} AS position" for n, rid in enumerate(REGISTRY_ORDER)
    )
    return (
        with_reviews(REGISTRY_ORDER, extra_fixtures=())
        + ", flagged AS (\n" + flagged_keys_sql() + "\n)"
        + ", registry AS (" + registry + ")\n"
        "SELECT g.rule_id, g.title, CAST(COUNT(f.case_key) AS BIGINT) AS flagged FROM registry g"
        " LEFT JOIN (SELECT * FROM flagged f WHERE NOT EXISTS (SELECT 1 FROM reviews r"
        " WHERE r.rule_id = f.rule_id AND r.case_key = f.case_key)) f ON f.rule_id = g.rule_id"
        " GROUP BY g.rule_id, g.title, g.position ORDER BY g.position"
    )


def build_oracles() -> dict[str, str]:
    o: dict[str, str] = {}
    for rid in ORACLE_RULES:
        o["flagged_" + rid.replace(".", "_")] = flagged_sql(rid)
    o["lead_reopened"] = lead_reopened_sql()
    o["lead_misrouted"] = lead_misrouted_sql()
    o["flagged_counts"] = flagged_counts_sql()
    for group in (REVIEW_ORACLES, SCAN_ORACLES, LISTING_ORACLES, EXPLORE_ORACLES):
        o.update({k: f() for k, f in group.items()})
    return o


# --- reviews (2.J) ---------------------------------------------------------------------

R3_COLS = [
    "approval_timestamp", "first_connected_time", "lead_sources", "mtd_form_filled_timestamp", "newest_order_no",
    "oldest_order_number", "order_date_time", "sales_person", "ticket_created_at", "tickets_id", "total_amount",
    "username_frontend",
]  # rule 3 view columns, sorted (the seed dataset's column order)
R3_TYPES = {
    "approval_timestamp": "TIMESTAMP", "first_connected_time": "TIMESTAMP", "mtd_form_filled_timestamp": "TIMESTAMP",
    "order_date_time": "TIMESTAMP", "ticket_created_at": "TIMESTAMP", "total_amount": "DOUBLE",
}
AUDIT4 = ["auditor", "decision_types", "decided_sales_person", "comments"]


def seeded_reviews_r3_sql() -> str:
    pred = ORACLE_RULES["3"][1]
    return (
        f"SELECT '3' AS rule_id, {ORDER_KEY_SQL} AS case_key, {', '.join(R3_COLS)}, {_audit_select()}"
        f" FROM (SELECT *, k AS h FROM assisted_orders WHERE ({pred}) AND k%7=3) s"
    )


_DUCK_TYPES = {"timestamp_ntz": "TIMESTAMP", "date": "DATE", "double": "DOUBLE", "bigint": "BIGINT", "boolean": "BOOLEAN"}
#: Columns of the views of all rules, and the types of those that are no text.
REC_COLS = sorted({c.strip() for *_, cols, _ in ORACLE_RULES.values() for c in cols.split(",")} | {c.strip() for c in (L1_COLS + ", " + L2_COLS).split(",")})
REC_TYPES = {f.name: _DUCK_TYPES[f.dataType.simpleString()] for t in (ASSISTED_ORDERS, UNASSISTED_ORDERS) for f in t.fields if f.dataType.simpleString() in _DUCK_TYPES} | {
    "closed_at": "TIMESTAMP", "next_state_updatedAt": "TIMESTAMP", "day_gap": "BIGINT", "final_order_value": "DOUBLE", "agent_count": "BIGINT",
}


def flagged_rows_sql() -> str:
    """Flagged rows of all rules with the columns of their views, NULL where a view lacks one."""
    parts = [
        f"SELECT '{rid}' AS rule_id, {key} AS case_key, k AS h, {'s' if base == _A else '0'} AS s, {cols} FROM {base} WHERE {pred}"
        for rid, (base, pred, key, cols, _) in ORACLE_RULES.items()
    ]
    parts.append(f"SELECT 'L1' AS rule_id, {L1_KEY_SQL} AS case_key, event_id AS h, 0 AS s, {L1_COLS} FROM l1_cases")
    parts.append(f"SELECT 'L2' AS rule_id, {L2_KEY_SQL} AS case_key, {L2_HELPER_SQL} AS h, 0 AS s, {L2_COLS} FROM l2_cases")
    return "\nUNION ALL BY NAME\n".join(parts)


def _validated_sql() -> str:
    order_ids = ", ".join(f"'{r}'" for r in ORDER_RULE_IDS)
    known = ", ".join(f"'{r}'" for r in REGISTRY_ORDER)
    t = {f: f"COALESCE({_ftrim(f)}, '')" for f in AUDIT4}
    key = (
        f"CASE WHEN action <> 'create' THEN case_key WHEN rule_id IN ({order_ids}) THEN {ORDER_KEY_SQL}"
        f" WHEN rule_id = '11' THEN {UNASSISTED_KEY_SQL} WHEN rule_id = 'L1' THEN COALESCE(lead_id,'') || '|' || COALESCE(substr(closed_at, 1, 10),'')"
        f" WHEN rule_id = 'L2' THEN {L2_KEY_SQL} ELSE '' END"
    )
    return f"""
SELECT d.*, CASE
    WHEN NOT COALESCE(rule_id IN ({known}), FALSE) THEN 'Unknown investigation'
    WHEN NOT COALESCE(action IN ('create', 'edit'), FALSE) THEN 'Unknown action.'
    WHEN auditor = '' THEN 'Auditor is required.'
    WHEN decision_types = '' THEN 'Decision type is required.'
    WHEN {_units('auditor')} > 200 OR {_units('decision_types')} > 200 OR {_units('decided_sales_person')} > 200
      THEN 'Auditor, decision type and decided sales person must be 200 characters or fewer.'
    WHEN {_units('comments')} > 4000 THEN 'Comments must be 4000 characters or fewer.'
    WHEN action = 'create' AND NOT COALESCE(has_record, FALSE) THEN 'Missing record.'
    WHEN action = 'create' AND replace(case_key, '|', '') = '' THEN 'Record has no order number.'
    WHEN action <> 'create' AND COALESCE(case_key = '', TRUE) THEN 'Missing case.'
  END AS reason
FROM (
  SELECT seq, action, rule_id, has_record, {', '.join(REC_COLS)}, user_email, submitted_at,
    {', '.join(f'{t[f]} AS {f}' for f in AUDIT4)},
    {key} AS case_key
  FROM decisions
) d
"""


def review_ctes(edits_only: bool = False) -> str:
    batch = duckdb_decisions()
    if edits_only:
        batch = f"SELECT * FROM ({batch}) x WHERE action = 'edit'"
    typed = ", ".join(f"TRY_CAST({c} AS {REC_TYPES[c]}) AS {c}" if c in REC_TYPES else c for c in REC_COLS)
    extra = {
        "l1_cases": L1_CASES_SQL,
        "l2_cases": L2_CASES_SQL,
        "flagged_rows": flagged_rows_sql(),
        "decisions": batch,
        "reviews": f"SELECT rule_id, case_key, {', '.join(REC_COLS)}, {_audit_select()} FROM flagged_rows WHERE h%7=3",
        "v": _validated_sql(),
        "existing": "SELECT DISTINCT rule_id, case_key FROM reviews",
        "creates": "SELECT * FROM v WHERE reason IS NULL AND action = 'create'",
        "firsts": "SELECT rule_id, case_key, MIN(seq) AS win_seq FROM creates GROUP BY rule_id, case_key",
        "fresh": "SELECT * FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM existing x"
                 " WHERE x.rule_id = f.rule_id AND x.case_key = f.case_key)",
        "saved": "SELECT c.* FROM creates c JOIN fresh f ON c.rule_id = f.rule_id AND c.case_key = f.case_key"
                 " AND c.seq = f.win_seq",
        "edits": "SELECT e.*, (x.case_key IS NOT NULL OR (f.win_seq IS NOT NULL AND f.win_seq < e.seq)) AS found"
                 " FROM v e LEFT JOIN existing x ON x.rule_id = e.rule_id AND x.case_key = e.case_key"
                 " LEFT JOIN fresh f ON f.rule_id = e.rule_id AND f.case_key = e.case_key"
                 " WHERE e.reason IS NULL AND e.action = 'edit'",
        "last_edit": "SELECT rule_id, case_key, " + ", ".join(
            f"arg_max({c}, seq) AS {c}" for c in AUDIT4 + ["user_email", "submitted_at"]
        ) + " FROM edits WHERE found GROUP BY rule_id, case_key",
        "merged": "SELECT * FROM reviews UNION ALL SELECT rule_id, case_key, " + typed + ", "
                  + ", ".join(AUDIT4) + ", user_email AS created_by, submitted_at AS created_at,"
                  " user_email AS updated_by, submitted_at AS updated_at FROM saved",
        "new_reviews": "SELECT m.rule_id, m.case_key, " + ", ".join(f"m.{c}" for c in REC_COLS) + ", "
                       + ", ".join(f"CASE WHEN l.case_key IS NOT NULL THEN l.{c} ELSE m.{c} END AS {c}" for c in AUDIT4)
                       + ", m.created_by, m.created_at,"
                       " CASE WHEN l.case_key IS NOT NULL THEN l.user_email ELSE m.updated_by END AS updated_by,"
                       " CASE WHEN l.case_key IS NOT NULL THEN l.submitted_at ELSE m.updated_at END AS updated_at"
                       " FROM merged m LEFT JOIN last_edit l ON l.rule_id = m.rule_id AND l.case_key = m.case_key",
    }
    return duckdb_with("assisted_orders", "unassisted_orders", "lead_history", "team_budget", extra=extra)


def review_validate_sql() -> str:
    return review_ctes() + "SELECT seq, action, rule_id, case_key, " + ", ".join(AUDIT4) + \
        ", reason IS NULL AS valid, reason FROM v"


def review_apply_sql() -> str:
    return review_ctes() + "SELECT * FROM new_reviews"


def review_edit_sql() -> str:
    return review_ctes(edits_only=True) + "SELECT * FROM new_reviews"


def review_outcomes_sql() -> str:
    return review_ctes() + """
SELECT seq, action, rule_id, case_key,
  CASE WHEN reason = 'Unknown investigation' THEN 'not_found' ELSE 'invalid' END AS status, reason
FROM v WHERE reason IS NOT NULL
UNION ALL
SELECT c.seq, c.action, c.rule_id, c.case_key,
  CASE WHEN c.seq = f.win_seq THEN 'saved' ELSE 'conflict' END AS status,
  CASE WHEN c.seq = f.win_seq THEN NULL ELSE 'This case has already been reviewed by someone else.' END AS reason
FROM creates c LEFT JOIN fresh f ON f.rule_id = c.rule_id AND f.case_key = c.case_key
UNION ALL
SELECT seq, action, rule_id, case_key,
  CASE WHEN found THEN 'edited' ELSE 'not_found' END AS status,
  CASE WHEN found THEN NULL ELSE 'That case no longer exists.' END AS reason
FROM edits
"""


def flagged_after_review_sql() -> str:
    return (
        review_ctes()
        + "SELECT f.rule_id, f.case_key FROM flagged_rows f WHERE NOT EXISTS"
        " (SELECT 1 FROM new_reviews r WHERE r.rule_id = f.rule_id AND r.case_key = f.case_key)"
    )


def open_case_counts_sql() -> str:
    registry = " UNION ALL ".join(f"SELECT '{rid}' AS rule_id, '{TITLES[rid]}' AS title" for rid in REGISTRY_ORDER)
    return (
        review_ctes()
        + f"SELECT g.rule_id, g.title, CAST(COUNT(f.case_key) AS BIGINT) AS flagged FROM ({registry}) g LEFT JOIN flagged_rows f ON f.rule_id = g.rule_id"
        " AND NOT EXISTS (SELECT 1 FROM new_reviews r WHERE r.rule_id = f.rule_id AND r.case_key = f.case_key) GROUP BY g.rule_id, g.title"
    )


def reviews_list_of_sql(rule_id: str) -> str:
    if rule_id == "11":
        table, key, cols, h = f"unassisted_orders WHERE ({ORACLE_RULES['11'][1]})", UNASSISTED_KEY_SQL, ORACLE_RULES["11"][3], "k"
    elif rule_id == "L1":
        table, key, cols, h = "l1_cases WHERE TRUE", L1_KEY_SQL, L1_COLS, "event_id"
    else:
        table, key, cols, h = "l2_cases WHERE TRUE", L2_KEY_SQL, L2_COLS, L2_HELPER_SQL
    rows = f"SELECT {key} AS case_key, {h} AS h, {cols} FROM {table} AND {h}%7=3"
    lead = {"L1": {"l1_cases": L1_CASES_SQL}, "L2": {"l2_cases": L2_CASES_SQL}}.get(rule_id, {})
    return duckdb_with(*_needs([rule_id]), extra={**lead, "s": rows}) + f"SELECT {cols}, {_audit_select()} FROM s ORDER BY updated_at DESC NULLS LAST, case_key"


def reviews_list_sql() -> str:
    return (
        duckdb_with("assisted_orders", extra={"reviews": seeded_reviews_r3_sql()})
        + "SELECT * EXCLUDE (case_key, rule_id) FROM reviews ORDER BY updated_at DESC NULLS LAST, case_key"
    )


def reviewed_counts_sql() -> str:
    return with_reviews(REGISTRY_ORDER) + "SELECT rule_id, COUNT(*) AS reviewed FROM reviews GROUP BY rule_id"


def distinct_decision_types_sql() -> str:
    return (
        with_reviews(REGISTRY_ORDER)
        + "SELECT DISTINCT decision_types FROM reviews WHERE decision_types IS NOT NULL AND decision_types <> ''"
        " ORDER BY decision_types"
    )


def person_suggestions_sql() -> str:
    base, pred, key, cols, order = ORACLE_RULES["3"]
    return (
        duckdb_with("assisted_orders", extra={"reviews": seeded_reviews_r3_sql()})
        + ", flagged AS (SELECT * FROM assisted_orders o WHERE (" + pred + ") AND NOT EXISTS (SELECT 1 FROM reviews r"
        f" WHERE r.case_key = {key.replace('COALESCE(', 'COALESCE(o.')}))\n"
        "SELECT DISTINCT suggestion FROM (SELECT sales_person AS suggestion FROM flagged"
        " UNION ALL SELECT decided_sales_person FROM reviews) u"
        " WHERE suggestion IS NOT NULL AND suggestion <> '' ORDER BY suggestion"
    )


REVIEW_ORACLES = {
    "review_validate": review_validate_sql,
    "review_apply": review_apply_sql,
    "review_outcomes": review_outcomes_sql,
    "review_edit": review_edit_sql,
    "flagged_after_review": flagged_after_review_sql,
    "review_commit": review_apply_sql,
    "review_commit_outcomes": review_outcomes_sql,
    "open_case_counts": open_case_counts_sql,
    "reviews_list": reviews_list_sql,
    "reviews_list_11": lambda: reviews_list_of_sql("11"),
    "reviews_list_L1": lambda: reviews_list_of_sql("L1"),
    "reviews_list_L2": lambda: reviews_list_of_sql("L2"),
    "reviewed_counts": reviewed_counts_sql,
    "distinct_decision_types": distinct_decision_types_sql,
    "person_suggestions": person_suggestions_sql,
}


# --- scans, keys, lead stages ----------------------------------------------------------


def lead_stage_ctes() -> str:
    return duckdb_with("lead_history", "team_budget", extra={
        "first_per_agent": f"""
SELECT lead_id, assignedTo, MIN(updatedAt) AS first_assigned_at,
  (array_agg(category ORDER BY updatedAt ASC NULLS FIRST, event_id))[1] AS agent_category
FROM lead_history WHERE assignedTo IS NOT NULL AND {_utrim('assignedTo')} <> ''
GROUP BY lead_id, assignedTo""",
        "latest_value": """
SELECT lead_id, (array_agg(final_order_value ORDER BY updatedAt DESC NULLS LAST, event_id DESC)
  FILTER (WHERE final_order_value IS NOT NULL))[1] AS final_order_value
FROM lead_history GROUP BY lead_id""",
    })


SCAN_ORACLES = {
    "scan_assisted_orders": lambda: duckdb_with("assisted_orders") + "SELECT * EXCLUDE (k, s) FROM assisted_orders",
    "scan_unassisted_orders": lambda: duckdb_with("unassisted_orders") + "SELECT * EXCLUDE (k) FROM unassisted_orders",
    "scan_lead_history": lambda: duckdb_with("lead_history") + "SELECT * FROM lead_history",
    "case_keys": lambda: with_reviews(REGISTRY_ORDER) + ", flagged AS (\n" + flagged_keys_sql() + "\n)\n"
    "SELECT rule_id, case_key FROM flagged",
    "unreviewed_cases": lambda: with_reviews(REGISTRY_ORDER) + ", flagged AS (\n" + flagged_keys_sql() + "\n)\n"
    "SELECT rule_id, case_key FROM flagged f WHERE NOT EXISTS (SELECT 1 FROM reviews r"
    " WHERE r.rule_id = f.rule_id AND r.case_key = f.case_key)",
    "lead_transitions": lambda: duckdb_with("lead_history") + """
SELECT event_id, lead_id, state, updatedAt,
  LAG(state) OVER w AS prev_state,
  FIRST_VALUE(CASE WHEN lower(state) <> 'closed' THEN state END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_state,
  FIRST_VALUE(CASE WHEN lower(state) <> 'closed' THEN updatedAt END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_state_updatedAt
FROM lead_history
WINDOW w AS (PARTITION BY lead_id ORDER BY updatedAt ASC NULLS FIRST, event_id)""",
    "lead_first_per_agent": lambda: lead_stage_ctes() + "SELECT * FROM first_per_agent",
    "lead_agent_rank": lambda: lead_stage_ctes() + """
SELECT *, ROW_NUMBER() OVER (PARTITION BY lead_id ORDER BY first_assigned_at ASC NULLS FIRST, assignedTo) AS assign_rank,
  COUNT(*) OVER (PARTITION BY lead_id) AS agent_count
FROM first_per_agent""",
    "lead_latest_value": lambda: lead_stage_ctes() + "SELECT * FROM latest_value",
    "lead_expected_category": lambda: lead_stage_ctes() + """
SELECT v.lead_id, v.final_order_value, b.category AS expected_category
FROM latest_value v LEFT JOIN team_budget b
  ON v.final_order_value >= b.min_value AND (b.max_value IS NULL OR v.final_order_value < b.max_value)""",
}

# --- order listing, roster ------------------------------------------------------------

DEFAULT_COLS = [
    "date", "sales_person", "oldest_order_number", "customer_name", "current_order_status", "total_amount",
    "newest_order_no", "tickets_id", "invoice_status", "lead_sources", "team", "order_limit_team_wise_investigate",
    "final_assigned_to_name", "budget_team_mismatch_flag", "invalid_sales_team_flag",
]

LISTING_ORACLES = {
    "orders_in_range": lambda: duckdb_with("assisted_orders") + "SELECT * EXCLUDE (k, s) FROM assisted_orders"
    " WHERE date BETWEEN DATE '2026-03-01' AND DATE '2026-03-31' ORDER BY date DESC",
    "orders_last_30_days": lambda: duckdb_with("assisted_orders") + "SELECT * EXCLUDE (k, s) FROM assisted_orders"
    " WHERE date BETWEEN DATE '2026-09-03' AND DATE '2026-10-03' ORDER BY date DESC",
    "orders_default_columns": lambda: duckdb_with("assisted_orders") + "SELECT " + ", ".join(DEFAULT_COLS)
    + ", 'x' AS added_later FROM assisted_orders WHERE date BETWEEN DATE '2026-03-01' AND DATE '2026-03-31'",
    "roster_members": lambda: duckdb_with("employees") + "SELECT work_email, lower(work_email) AS email_key,"
    " COALESCE(display_name, work_email) AS name FROM employees"
    f" WHERE len(list_filter(string_split(Project_id, ','), lambda p: lower({_utrim('p')}) = 'audit_app')) > 0",
    "snapshot_refresh": lambda: duckdb_with("assisted_orders") + "SELECT * EXCLUDE (k, s),"
    " strftime(order_date_time, '%Y-%m') AS order_month FROM assisted_orders",
}

# --- exploration and reports -----------------------------------------------------------

R3_VIEW = [c.strip() for c in _B12.split(",")]
R3_DISPLAY = {
    "approval_timestamp": "datetime", "order_date_time": "datetime", "ticket_created_at": "datetime",
    "first_connected_time": "datetime", "mtd_form_filled_timestamp": "datetime", "total_amount": "money",
}


def indian_sql(x: str) -> str:
    """Indian digit grouping, at most 2 decimals, written without look-ahead (reversed digits)."""
    s = f"ltrim(CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 2) AS VARCHAR), '-')"
    ip = f"split_part({s}, '.', 1)"
    frac = f"rtrim(split_part({s}, '.', 2), '0')"
    r = f"reverse({ip})"
    grouped = (
        f"reverse(substr({r}, 1, 3) || CASE WHEN substr({r}, 4) = '' THEN '' ELSE ',' || "
        f"rtrim(regexp_replace(substr({r}, 4), '(\\d\\d)', '\\1,', 'g'), ',') END)"
    )
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || {grouped} || "
            f"CASE WHEN {frac} = '' THEN '' ELSE '.' || {frac} END)")


def display_sql(c: str, kind: str) -> str:
    if kind == "datetime":
        body = f"strftime({c}, '%d %b %Y, %H:%M')"
    elif kind == "instant":
        body = f"strftime({c} + INTERVAL 330 MINUTE, '%d %b %Y, %H:%M')"
    elif kind == "money":
        body = "'₹' || " + indian_sql(c)
    elif kind == "int":
        body = indian_sql(c)
    else:
        return f"COALESCE(CAST({c} AS VARCHAR), '')"
    return f"CASE WHEN {c} IS NULL THEN '' ELSE {body} END"


def raw_sql(c: str, kind: str) -> str:
    if kind in ("datetime", "timestamp"):
        return f"COALESCE(strftime({c}, '%Y-%m-%dT%H:%M:%S'), '')"
    if kind == "money":
        s = f"CAST(CAST({c} AS DECIMAL(38,10)) AS VARCHAR)"
        return f"COALESCE(regexp_replace(regexp_replace({s}, '(\\.\\d*?)0+$', '\\1'), '\\.$', ''), '')"
    return f"COALESCE(CAST({c} AS VARCHAR), '')"


def flagged3_ctes() -> str:
    base, pred, key, cols, order = ORACLE_RULES["3"]
    flagged = (
        f"SELECT {cols}, {key} AS case_key FROM assisted_orders o WHERE ({pred}) AND NOT EXISTS ("
        f"SELECT 1 FROM reviews r WHERE r.rule_id = '3' AND r.case_key = {key.replace('COALESCE(', 'COALESCE(o.')})"
    )
    return with_reviews(["3"]) + ", flagged3 AS (" + flagged + ")\n"


def search_sql(text: str) -> str:
    parts = []
    for c in R3_VIEW:
        kind = R3_DISPLAY.get(c, "text")
        parts += [display_sql(c, kind), raw_sql(c, kind)]
    q = text.strip().lower().replace("'", "''")
    hay = "lower(concat_ws(' ', " + ", ".join(parts) + "))"
    return flagged3_ctes() + f"SELECT {', '.join(R3_VIEW)} FROM flagged3 WHERE strpos({hay}, '{q}') > 0"


NATKEY = ("array_to_string(list_transform(regexp_extract_all({c}, '([0-9]+|[^0-9]+)', 1), "
          "lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(CAST(length(ltrim(x, '0')) AS VARCHAR), 10, '0') || ltrim(x, '0') ELSE x END), '')")


def sort_natural_sql() -> str:
    nk = NATKEY.format(c="tickets_id")
    return flagged3_ctes() + (
        f"SELECT {', '.join(R3_VIEW)} FROM flagged3 ORDER BY (tickets_id IS NULL OR tickets_id = '') DESC,"
        f" {nk} DESC NULLS LAST, order_date_time ASC NULLS FIRST, case_key ASC LIMIT 50"
    )


def page_sql() -> str:
    return flagged3_ctes() + (
        f"SELECT {', '.join(R3_VIEW)} FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY total_amount IS NULL,"
        " total_amount ASC NULLS FIRST, order_date_time ASC NULLS FIRST, case_key) AS rn FROM flagged3) t"
        " WHERE rn > (SELECT (CAST(ceil(COUNT(*) / 50.0) AS BIGINT) - 1) * 50 FROM flagged3)"
    )


def page_middle_sql() -> str:
    return flagged3_ctes() + (
        f"SELECT {', '.join(R3_VIEW)} FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY total_amount IS NULL,"
        " total_amount ASC NULLS FIRST, order_date_time ASC NULLS FIRST, case_key) AS rn FROM flagged3) t"
        " WHERE rn > (SELECT ((CAST(ceil(COUNT(*) / 50.0) AS BIGINT) - 1) // 2) * 50 FROM flagged3)"
        " AND rn <= (SELECT ((CAST(ceil(COUNT(*) / 50.0) AS BIGINT) - 1) // 2) * 50 + 50 FROM flagged3)"
    )


def render_sql() -> str:
    cols = ", ".join(f"{display_sql(c, R3_DISPLAY.get(c, 'text'))} AS {c}" for c in R3_VIEW)
    return flagged3_ctes() + f"SELECT {cols} FROM flagged3"


def render_leads_sql() -> str:
    kinds = {"closed_at": "instant", "next_state_updatedAt": "instant", "day_gap": "int"}
    cols = ", ".join(f"{display_sql(c.strip(), kinds.get(c.strip(), 'text'))} AS {c.strip()}" for c in L1_COLS.split(","))
    return (
        with_reviews(["L1"])
        + f"SELECT {cols} FROM l1_cases o WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.rule_id = 'L1'"
        " AND r.case_key = COALESCE(o.lead_id,'') || '|' || COALESCE(CAST(CAST(o.closed_at AS DATE) AS VARCHAR),''))"
    )


def case_summary_sql() -> str:
    cols = ["oldest_order_number", "sales_person", "total_amount", "tickets_id"]
    sel = ", ".join(f"{display_sql(c, R3_DISPLAY.get(c, 'text'))} AS {c}" for c in cols)
    return flagged3_ctes() + f"SELECT {sel} FROM flagged3"


def filled_sql(columns: list[str], table: str, position: str) -> str:
    """One row per column: its position, its name and how many rows of the table hold a value."""
    return " UNION ALL ".join(
        f"SELECT {i} AS {position}, '{c}' AS \"column\", count({c}) AS filled FROM {table}" for i, c in enumerate(columns)
    )


def _look_back_sql(first: str) -> str:
    return duckdb_with("assisted_orders") + (
        f"SELECT * EXCLUDE (k, s) FROM assisted_orders WHERE date BETWEEN DATE '{first}' AND DATE '2026-10-03'"
    )


# Label and display type of rule 3's columns.
R3_LABELS = [
    ("approval_timestamp", "Approval time", "datetime"),
    ("sales_person", "Sales person", "text"),
    ("oldest_order_number", "Oldest order no.", "text"),
    ("order_date_time", "Order date & time", "timestamp"),
    ("total_amount", "Total amount", "money"),
    ("newest_order_no", "Newest order no.", "text"),
    ("tickets_id", "Ticket ID", "text"),
    ("ticket_created_at", "Ticket created", "datetime"),
    ("first_connected_time", "First connected", "datetime"),
    ("mtd_form_filled_timestamp", "MTD form filled", "datetime"),
    ("username_frontend", "Frontend username", "text"),
    ("lead_sources", "Lead source", "text"),
]
# the declared order table, and the partition column at its end
SNAPSHOT_TYPES = [(f.name, f.dataType.simpleString()) for f in ASSISTED_ORDERS.fields] + [("order_month", "string")]

_WITH_MONTH = "SELECT * EXCLUDE (k, s), strftime(order_date_time, '%Y-%m') AS order_month FROM assisted_orders"

EXPLORE_ORACLES = {
    "snapshot_refresh_changed": lambda: duckdb_with("assisted_orders") + _WITH_MONTH,
    "snapshot_parts": lambda: duckdb_with("assisted_orders")
    + f"SELECT order_month, CASE WHEN order_month IN ('2026-06', '2026-03') THEN 1 ELSE 0 END AS written_by, count(*) AS rows FROM ({_WITH_MONTH}) GROUP BY order_month",
    "lead_expected_category_tree": lambda: duckdb_with("assisted_orders")
    + """SELECT v.oldest_order_number, v.final_order_value, count(c_name) AS n_bands, min(c_name) AS first_band, max(c_name) AS last_band
FROM (SELECT oldest_order_number, max(total_amount) AS final_order_value FROM assisted_orders GROUP BY oldest_order_number) v
LEFT JOIN (SELECT c_name, c_acctbal::DOUBLE AS balance FROM customer) c
  ON v.final_order_value >= balance * 40 AND (balance > 9900 OR v.final_order_value < balance * 41)
GROUP BY v.oldest_order_number, v.final_order_value""",
    "table_search": lambda: search_sql("  Jan 2026, 1"),
    "table_search_amount": lambda: search_sql(",50,"),
    "table_search_indexed": lambda: search_sql("  Jan 2026, 1"),
    "table_search_amount_indexed": lambda: search_sql(",50,"),
    "table_page_directory": page_middle_sql,
    "table_sort_natural": sort_natural_sql,
    "table_page": page_sql,
    "table_page_middle": page_middle_sql,
    "report_render": render_sql,
    "report_render_leads": render_leads_sql,
    "reviews_report": reviews_list_sql,
    "report_columns": lambda: flagged3_ctes() + "SELECT f.position, f.\"column\", f.filled, l.label, l.display_type FROM ("
    + filled_sql(R3_VIEW, "flagged3", "position") + ") f JOIN (VALUES "
    + ", ".join(f"('{c}', '{label}', '{kind}')" for c, label, kind in R3_LABELS)
    + ") AS l(name, label, display_type) ON l.name = f.\"column\"",
    "snapshot_info": lambda: duckdb_with("assisted_orders") + ", snapshot AS (SELECT * EXCLUDE (k, s),"
    " strftime(order_date_time, '%Y-%m') AS order_month FROM assisted_orders)\n"
    + "SELECT f.position, f.\"column\", f.filled, t.type, TRUE AS refresh_known FROM ("
    + filled_sql([c for c, _ in SNAPSHOT_TYPES], "snapshot", "position") + ") f JOIN (VALUES "
    + ", ".join(f"('{c}', '{t}')" for c, t in SNAPSHOT_TYPES) + ") AS t(name, type) ON t.name = f.\"column\"",
    "review_save": lambda: review_apply_sql(),
    "orders_last_7_days": lambda: _look_back_sql("2026-09-26"),
    "orders_last_90_days": lambda: _look_back_sql("2026-07-05"),
    "orders_since_start": lambda: _look_back_sql("2025-07-01"),
    "case_summary": case_summary_sql,
}


_EVOLVE_ADDED = {
    "payment_method": "VARCHAR", "order_type_in_mtd_form": "VARCHAR", "pending_approval_02_step_timestamp": "TIMESTAMP",
    "current_order_status": "VARCHAR", "lead_created_at": "DATE", "final_assigned_to_name": "VARCHAR",
    "helper_budget": "BIGINT", "assigned_team_acc_to_budget": "VARCHAR",
}


def review_evolve_sql() -> str:
    added = ", ".join(f"CAST(NULL AS {t}) AS {c}" for c, t in _EVOLVE_ADDED.items())
    return duckdb_with("assisted_orders", extra={"reviews": seeded_reviews_r3_sql()}) + f"SELECT *, {added} FROM reviews"


def roster_lookup_sql() -> str:
    return duckdb_with("employees") + (
        "SELECT COALESCE(COALESCE(display_name, work_email), 'User5@Example.com') AS name FROM employees"
        " WHERE lower(work_email) = 'user5@example.com'"
        f" AND len(list_filter(string_split(Project_id, ','), lambda p: lower({_utrim('p')}) = 'audit_app')) > 0"
        " ORDER BY work_email LIMIT 1"
    )


EXPLORE_ORACLES.update({"review_evolve": review_evolve_sql, "roster_lookup": roster_lookup_sql})
