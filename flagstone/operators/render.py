"""Reports: column labels / display types, rendered text tables, column orders and summaries."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.functions.text import display_text


@dataclass(frozen=True)
class Col:
    key: str
    label: str
    type: str
    default: bool = False


# ---------------------------------------------------------------------------------------
# Labels and display types of the known columns, in the reference's order
# (key, label, display type, shown by default).
# ---------------------------------------------------------------------------------------
KNOWN_COLUMNS = (
    Col("order_date_time", "Order date & time", "timestamp"),
    Col("date", "Date", "date", True),
    Col("sales_person", "Sales person", "text", True),
    Col("sharing_percentage", "Sharing %", "num"),
    Col("amount_toward_sales_person", "Amount to sales person", "money"),
    Col("customer_type", "Customer type", "text"),
    Col("oldest_order_number", "Oldest order no.", "text", True),
    Col("customer_name", "Customer name", "text", True),
    Col("status", "Status", "text"),
    Col("current_order_status", "Current order status", "text", True),
    Col("total_amount", "Total amount", "money", True),
    Col("order_type_in_mtd_form", "Order type (MTD form)", "text"),
    Col("newest_order_no", "Newest order no.", "text", True),
    Col("payment_method", "Payment method", "text"),
    Col("tickets_id", "Ticket ID", "text", True),
    Col("approval_timestamp", "Approval time", "datetime"),
    Col("mtd_form_filled_timestamp", "MTD form filled", "datetime"),
    Col("total_metal_amt", "Total metal amt", "money"),
    Col("ticket_id_text", "Ticket ID (text)", "text"),
    Col("ticket_created_at", "Ticket created", "datetime"),
    Col("invoice_status", "Invoice status", "text", True),
    Col("lead_sources", "Lead source", "text", True),
    Col("first_connected_time", "First connected", "datetime"),
    Col("true_false", "Ticket after approval", "bool"),
    Col("first_connect_time_true_false", "First connect after approval", "bool"),
    Col("username_frontend", "Frontend username", "text"),
    Col("team", "Team", "text", True),
    Col("order_limit_team_wise_investigate", "Order limit (team-wise)", "flag", True),
    Col("pending_approval_02_step_timestamp", "02 Pending approval", "datetime"),
    Col("diff_min_ticket_created_vs_02_pending_approval", "Ticket → 02 pending (min)", "int"),
    Col("true_false_02_vs_ticket_created_date", "Ticket after 02 pending", "bool"),
    Col("diff_min_1st_connect_vs_10_order_approved", "1st connect → approved (min)", "int"),
    Col("true_false_02_vs_1st_time_connect", "1st connect after 02 pending", "bool"),
    Col("order_phone_number_1", "Order phone", "text"),
    Col("lead_phone_number", "Lead phone", "text"),
    Col("order_phone_ne_lead_phone", "Order phone = lead phone", "bool"),
    Col("ticket_date_more_than_1_month_older_than_order_date", "Ticket >1 month older (days)", "int"),
    Col("lead_source_for_sales_report_data_category_1", "Lead source cat. 1", "text"),
    Col("lead_source_for_sales_report_data_category_2", "Lead source cat. 2", "text"),
    Col("process_key", "Process key", "text"),
    Col("assigned_to", "Assigned to", "text"),
    Col("email_id", "Email", "text"),
    Col("lead_created_at", "Lead created", "date"),
    Col("budget", "Budget", "text"),
    Col("helper_budget", "Helper budget", "int"),
    Col("name_as_per_lead_budget", "Name as per lead budget", "text"),
    Col("assigned_team_acc_to_budget", "Assigned team (budget)", "text"),
    Col("final_assigned_to_name", "Final assigned to", "text", True),
    Col("assigned_to_team", "Assigned to team", "text"),
    Col("ticket_id_beyond_90_days", "Ticket beyond 90 days", "flag"),
    Col("budget_team_mismatch_flag", "Budget / team mismatch", "flag", True),
    Col("invalid_sales_team_flag", "Invalid sales team", "flag", True),
)
VIEW_ONLY_COLUMNS = (
    Col("purchase_date", "Purchase date", "date"),
    Col("amount", "Amount", "money"),
    Col("current_status", "Current status", "text"),
    Col("newest_order_number", "Newest order no.", "text"),
    Col("lead_id", "Lead ID", "text"),
    Col("closed_state", "Closed state", "text"),
    Col("closed_at", "Closed at", "instant"),
    Col("next_state", "Next state", "text"),
    Col("next_state_updatedAt", "Next state updated at", "instant"),
    Col("day_gap", "Day gap", "int"),
    Col("assignedTo", "Assigned to", "text"),
    Col("final_order_value", "Final order value", "money"),
    Col("expected_category", "Expected category", "text"),
    Col("agent_count", "Agent count", "int"),
    Col("first_assignee", "First assignee", "text"),
    Col("first_assignee_category", "First assignee category", "text"),
    Col("other_assignees", "Other assignees", "text"),
    Col("Assignment_Flag", "Assignment flag", "flag"),
    Col("auditor", "Auditor", "text"),
    Col("decision_types", "Decision type", "text"),
    Col("decided_sales_person", "Decided sales person", "text"),
    Col("comments", "Comments", "text"),
    Col("created_by", "Reviewed by", "text"),
    Col("created_at", "Reviewed at", "instant"),
    Col("updated_by", "Last edited by", "text"),
    Col("updated_at", "Last edited at", "instant"),
)
SUMMARY_KEYS = (
    "lead_id", "oldest_order_number", "sales_person", "customer_name", "total_amount", "amount",
    "tickets_id", "assignedTo", "first_assignee", "expected_category",
)
REVIEW_AUDIT = ("auditor", "decision_types", "decided_sales_person", "comments")
REVIEW_META = ("created_by", "created_at", "updated_by", "updated_at")

_KNOWN = {c.key: c for c in KNOWN_COLUMNS}
_VIEW_ONLY = {c.key: c for c in VIEW_ONLY_COLUMNS}


def storage_display_type(dtype: T.DataType) -> str:
    """Display type from the storage type of an unknown column."""
    if isinstance(dtype, T.TimestampType):
        return "timestamp"
    if isinstance(dtype, T.TimestampNTZType):
        return "datetime"
    if isinstance(dtype, T.DateType):
        return "date"
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return "num"
    if isinstance(dtype, (T.LongType, T.IntegerType, T.ShortType, T.ByteType)):
        return "int"
    if isinstance(dtype, T.BooleanType):
        return "bool"
    return "text"


def humanise(key: str) -> str:
    label = key.replace("_", " ")
    return label[:1].upper() + label[1:]


def resolve_column(key: str, dtype: T.DataType) -> Col:
    """Known label first, then the storage type with a humanised name."""
    known = _KNOWN.get(key) or _VIEW_ONLY.get(key)
    if known:
        return known
    return Col(key, humanise(key), storage_display_type(dtype))


def resolve_columns(schema: T.StructType) -> list[Col]:
    return [resolve_column(f.name, f.dataType) for f in schema.fields]


def render_report(df: DataFrame) -> DataFrame:
    """Every cell as display text by its display type (N2), one select of expressions."""
    cols = resolve_columns(df.schema)
    return df.select(
        *[display_text(F.col(f.name), c.type, f.dataType).alias(f.name) for f, c in zip(df.schema.fields, cols)]
    )


def report_columns(df: DataFrame) -> list[Col]:
    return resolve_columns(df.schema)


def default_columns(df: DataFrame) -> DataFrame:
    """Known columns marked default, plus any column the registry does not know."""
    keep = [f.name for f in df.schema.fields if (f.name in _KNOWN and _KNOWN[f.name].default) or f.name not in _KNOWN]
    return df.select(*keep)


def order_review_columns(df: DataFrame) -> DataFrame:
    """Order number, sales person, the four audit fields, the rest, then who / when."""
    head = ["oldest_order_number", "sales_person", *REVIEW_AUDIT]
    body = [c for c in df.columns if c not in head and c not in REVIEW_META]
    return df.select(*[c for c in (*head, *body, *REVIEW_META) if c in df.columns])


def summary_columns(columns: list[str]) -> list[str]:
    """First 4 well-known columns; with fewer than 3, padded with the leading columns to 4."""
    keys = [k for k in SUMMARY_KEYS if k in columns][:4]
    if len(keys) >= 3:
        return keys
    rest = [c for c in columns if c not in keys]
    return (keys + rest)[:4]


def case_summary(df: DataFrame) -> DataFrame:
    """Summary cells of each case as display text."""
    return render_report(df.select(*summary_columns(df.columns)))
