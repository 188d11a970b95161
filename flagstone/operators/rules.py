"""Rule registry: every investigation as a declarative spec holding a Column predicate.

A spec says which base table it reads, which rows it flags (a ``Column``), which columns it
shows, how it orders them and which columns form its case key. The flagging operators turn
specs into plans; nothing here touches data.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------------------
# These must equal the reference's rule definitions for identical results.
# ---------------------------------------------------------------------------------------
COD = "cashondelivery"
COD_30 = "COD-30"
CHQ = "CHQ-"
INVESTIGATE = "Investigate"
PAID = "Paid"
FLOOR_2026_01 = "2026-01-01"
FLOOR_2026_05 = "2026-05-01"
MINUTES_BAND = 30
AMOUNT_1_4 = 100000
AMOUNT_1_41 = 50000
CUTOFF_DAYS = 60
CUTOFF_ZONE = "Asia/Kolkata"
TEST_NAME_PATTERN = "test|Test|Pawan|Ankit"
CLOSED_STATUSES_6 = (
    "Canceled - Follow Up not Required",
    "Canceled - Support to Review",
    "Canceled (Pending)",
    "Canceled - Sales to Review - Initiated",
    "Canceled - Support to Handle - Initiated",
    "Canceled - Sales to Review",
    "Canceled",
    "Closed",
)
ENDED_STATUSES_7 = (
    "Canceled - Follow Up not Required",
    "Canceled - Support to Review",
    "Canceled (Pending)",
    "Canceled - Sales to Review - Initiated",
    "Canceled - Support to Handle - Initiated",
    "Canceled - Sales to Review",
    "Canceled",
    "94.1 - RTO Received - Order To Be Cancelled",
    "96 - Replaced with New Accurate Order",
    "9900 - Create Credit Memo (Processing) [Processing]",
    "9901 - Processing Refund [Processing]",
    "9909 - Fully Refunded",
    "9920 - Cancelled - Full Amount Forfeit",
    "9921 - Cancelled - Partial Amount Forfeit",
    "9930 - Shipment lost by Logistic Partner",
    "961 - Cancelled Before Shipment (but invoice had been created)",
)
ORDER_KEY = ("oldest_order_number", "newest_order_no", "sales_person")
UNASSISTED_KEY = ("oldest_order_number", "newest_order_number")
LEAD_1_KEY = ("lead_id", "closed_at:date")
LEAD_2_KEY = ("lead_id",)
REOPEN_MIN_GAP_DAYS = 60
MISROUTE_FLAG = "First Right, Others Wrong"


@dataclass(frozen=True)
class RuleParams:
    """Run parameters. ``as_of_date`` replaces the wall clock of the relative cutoff (rule 7);
    when None, today's date in the cutoff zone is used."""

    as_of_date: dt.date | None = None
    name_pattern: str = TEST_NAME_PATTERN
    cutoff_days: int = CUTOFF_DAYS
    reopen_min_gap_days: int = REOPEN_MIN_GAP_DAYS


@dataclass(frozen=True)
class RuleSpec:
    id: str
    group: str  # "order" | "lead"
    view: str
    base: str  # "assisted_orders" | "unassisted_orders" | "lead_history"
    title: str
    columns: tuple[str, ...]
    order_by: tuple[tuple[str, bool], ...]  # (column, descending)
    key_cols: tuple[str, ...]
    predicate: Callable[[RuleParams], Column] | None = field(default=None, compare=False)
    floor_column: str | None = None  # column bounded from below (partition pruning hint)
    floor_value: str | None = None


def ntz(text: str) -> Column:
    """Wall-clock timestamp literal (no zone)."""
    return F.lit(text).cast("timestamp_ntz")


def day(text: str) -> Column:
    return F.lit(text).cast("date")


def contains_chq(c: str) -> Column:
    # substring anywhere; NULL text gives NULL, i.e. not flagged
    return F.contains(F.col(c), F.lit(CHQ))


def as_of(params: RuleParams) -> Column:
    if params.as_of_date is not None:
        return F.lit(params.as_of_date)
    # today's date in the cutoff zone, independent of the session time zone
    return F.to_date(F.convert_timezone(None, F.lit(CUTOFF_ZONE), F.current_timestamp()))


def before_cutoff(c: str, params: RuleParams) -> Column:
    """At or before local midnight ``cutoff_days`` before the as-of date (inclusive)."""
    return F.col(c) <= F.date_sub(as_of(params), params.cutoff_days).cast("timestamp_ntz")


def _cod() -> Column:
    return F.col("payment_method") == COD


def _no_frontend() -> Column:
    return F.col("username_frontend").isNull()


def _not_cod30() -> Column:
    return F.col("order_type_in_mtd_form") != COD_30  # NULL is dropped (three-valued logic)


def _since(text: str) -> Column:
    return F.col("order_date_time") >= ntz(text + " 00:00:00")


def _diff() -> Column:
    return F.col("diff_min_ticket_created_vs_02_pending_approval")


# The columns of each view, in the view's order.
_BASE12 = (
    "approval_timestamp", "sales_person", "oldest_order_number", "order_date_time", "total_amount",
    "newest_order_no", "tickets_id", "ticket_created_at", "first_connected_time",
    "mtd_form_filled_timestamp", "username_frontend", "lead_sources",
)
_COLS_1_1 = (
    "approval_timestamp", "sales_person", "oldest_order_number", "order_date_time", "total_amount",
    "newest_order_no", "tickets_id", "ticket_id_text", "first_connected_time", "mtd_form_filled_timestamp",
    "username_frontend", "lead_sources", "payment_method", "order_type_in_mtd_form",
    "pending_approval_02_step_timestamp",
)
_COLS_1_2 = _COLS_1_1 + ("diff_min_ticket_created_vs_02_pending_approval",)
_COLS_1_2_1 = _BASE12 + (
    "payment_method", "order_type_in_mtd_form", "pending_approval_02_step_timestamp",
    "diff_min_ticket_created_vs_02_pending_approval",
)
_COLS_2 = _BASE12 + ("diff_min_1st_connect_vs_10_order_approved",)
_COLS_6 = _BASE12 + ("payment_method",)
_COLS_7 = _BASE12 + ("payment_method", "current_order_status")
_COLS_9 = (
    "approval_timestamp", "sales_person", "oldest_order_number", "order_date_time", "customer_name",
    "total_amount", "newest_order_no", "tickets_id", "ticket_created_at", "first_connected_time",
    "mtd_form_filled_timestamp", "username_frontend", "lead_sources", "order_phone_number_1",
    "lead_phone_number",
)
_COLS_10 = (
    "approval_timestamp", "sales_person", "oldest_order_number", "order_date_time", "total_amount",
    "newest_order_no", "tickets_id", "ticket_created_at", "first_connected_time",
    "mtd_form_filled_timestamp", "first_connect_time_true_false", "lead_sources",
)
_COLS_11 = ("purchase_date", "oldest_order_number", "customer_name", "amount", "newest_order_number")
_COLS_16 = _BASE12 + (
    "payment_method", "order_type_in_mtd_form", "pending_approval_02_step_timestamp",
    "current_order_status", "lead_created_at", "final_assigned_to_name",
)
_COLS_14 = _COLS_16 + ("helper_budget", "assigned_team_acc_to_budget")
LEAD_1_COLUMNS = (
    "lead_id", "closed_state", "closed_at", "next_state", "next_state_updatedAt", "day_gap", "assignedTo",
)
LEAD_2_COLUMNS = (
    "lead_id", "final_order_value", "expected_category", "agent_count", "first_assignee",
    "first_assignee_category", "other_assignees", "Assignment_Flag",
)

_ASC = (("order_date_time", False),)
_DESC = (("order_date_time", True),)


def _order_rule(rid, title, cols, pred, order=_ASC, floor=None) -> RuleSpec:
    return RuleSpec(
        id=rid, group="order", view="inv_" + rid.replace(".", "_"), base="assisted_orders", title=title,
        columns=cols, order_by=order, key_cols=ORDER_KEY, predicate=pred,
        floor_column="order_date_time" if floor else None, floor_value=floor,
    )


RULES: tuple[RuleSpec, ...] = (
    _order_rule(
        "1.1", "#1.1",
        _COLS_1_1,
        lambda p: _cod() & _no_frontend() & _not_cod30()
        & (F.col("true_false_02_vs_ticket_created_date") == F.lit(True)) & _since(FLOOR_2026_01),
        floor=FLOOR_2026_01,
    ),
    _order_rule(
        "1.2", "#1.2",
        _COLS_1_2,
        lambda p: _cod() & _no_frontend() & _not_cod30() & _diff().isNotNull() & (_diff() < MINUTES_BAND),
    ),
    _order_rule(
        "1.2.1", "#1.2.1",
        _COLS_1_2_1,
        lambda p: _cod() & _not_cod30() & (F.col("first_connect_time_true_false") == F.lit(False))
        & F.col("pending_approval_02_step_timestamp").isNotNull() & _diff().isNotNull()
        & (_diff() < MINUTES_BAND) & _since(FLOOR_2026_01),
        floor=FLOOR_2026_01,
    ),
    _order_rule(
        "1.3", "#1.3",
        _COLS_1_2_1,
        lambda p: _cod() & _not_cod30() & (F.col("first_connect_time_true_false") == F.lit(False))
        & (_diff() > MINUTES_BAND) & _since(FLOOR_2026_01),
        floor=FLOOR_2026_01,
    ),
    _order_rule(
        "1.4", "#1.4",
        _COLS_1_2_1,
        lambda p: _cod() & _no_frontend() & (F.col("order_type_in_mtd_form") == COD_30)
        & (F.col("total_amount") < AMOUNT_1_4) & _since(FLOOR_2026_01),
        floor=FLOOR_2026_01,
    ),
    _order_rule(
        "1.41", "#1.41",
        _COLS_1_2,
        lambda p: _cod() & _no_frontend() & (F.col("total_amount") < AMOUNT_1_41),
    ),
    _order_rule(
        "2", "#2",
        _COLS_2,
        lambda p: contains_chq("ticket_id_text") & _no_frontend()
        & (F.col("first_connect_time_true_false") == F.lit(True)) & _since(FLOOR_2026_01),
        floor=FLOOR_2026_01,
    ),
    _order_rule(
        "3", "#3",
        _BASE12,
        lambda p: (F.col("order_limit_team_wise_investigate") == INVESTIGATE) & _since(FLOOR_2026_01),
        floor=FLOOR_2026_01,
    ),
    _order_rule(
        "6", "#6",
        _COLS_6,
        lambda p: (F.col("invoice_status") != PAID) & contains_chq("tickets_id")
        & F.col("current_order_status").isin(*CLOSED_STATUSES_6) & _since(FLOOR_2026_01),
        floor=FLOOR_2026_01,
    ),
    _order_rule(
        "7", "#7",
        _COLS_7,
        lambda p: (F.col("invoice_status") != PAID) & contains_chq("tickets_id")
        & ~F.col("current_order_status").isin(*ENDED_STATUSES_7)
        & before_cutoff("approval_timestamp", p) & _since(FLOOR_2026_01),
        floor=FLOOR_2026_01,
    ),
    _order_rule(
        "9", "#9",
        _COLS_9,
        # the flag's name is inverted: FALSE means the two phones differ
        lambda p: contains_chq("tickets_id") & _no_frontend()
        & (F.col("order_phone_ne_lead_phone") == F.lit(False)) & _since(FLOOR_2026_01),
        floor=FLOOR_2026_01,
    ),
    _order_rule(
        "10", "#10",
        _COLS_10,
        lambda p: F.col("ticket_created_at").isNull() & F.col("tickets_id").isNotNull() & contains_chq("tickets_id"),
    ),
    RuleSpec(
        id="11", group="order", view="inv_11", base="unassisted_orders", title="#11",
        columns=_COLS_11, order_by=(("purchase_date", False),), key_cols=UNASSISTED_KEY,
        predicate=lambda p: F.col("customer_name").rlike(p.name_pattern)
        & (F.col("purchase_date") >= day(FLOOR_2026_01)),
        floor_column="purchase_date", floor_value=FLOOR_2026_01,
    ),
    _order_rule(
        "14", "#14",
        _COLS_14,
        lambda p: (F.col("team") != F.col("assigned_to_team")) & F.col("name_as_per_lead_budget").isNotNull()
        & _since(FLOOR_2026_05) & F.col("tickets_id").isNotNull() & contains_chq("tickets_id"),
        order=_DESC, floor=FLOOR_2026_05,
    ),
    _order_rule(
        "15", "#15",
        _COLS_14,
        lambda p: F.col("invalid_sales_team_flag").isNotNull() & F.col("helper_budget").isNotNull()
        & _since(FLOOR_2026_05) & F.col("tickets_id").isNotNull() & contains_chq("tickets_id"),
        order=_DESC, floor=FLOOR_2026_05,
    ),
    _order_rule(
        "16", "#16",
        _COLS_16,
        lambda p: F.col("ticket_id_beyond_90_days").isNotNull() & (F.col("date") >= day(FLOOR_2026_01))
        & F.col("tickets_id").isNotNull() & contains_chq("tickets_id"),
        order=_DESC,
    ),
    RuleSpec(
        id="L1", group="lead", view="lead_investigation_1", base="lead_history", title="Lead #1",
        columns=LEAD_1_COLUMNS,
        order_by=(("next_state_updatedAt", True),), key_cols=LEAD_1_KEY,
    ),
    RuleSpec(
        id="L2", group="lead", view="lead_investigation_2", base="lead_history", title="Lead #2",
        columns=LEAD_2_COLUMNS, order_by=(("lead_id", False),), key_cols=LEAD_2_KEY,
    ),
)

RULES_BY_ID = {r.id: r for r in RULES}


def find_rule(rule_id: str) -> RuleSpec:
    """Registry lookup; an unknown id is refused."""
    try:
        return RULES_BY_ID[rule_id]
    except KeyError:
        raise KeyError(f"Unknown investigation {rule_id!r}") from None


def rules_on(base: str) -> list[RuleSpec]:
    return [r for r in RULES if r.base == base and r.predicate is not None]
