"""Declared schemas of the business tables (explicit StructTypes: no inference at read time)."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, L, B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()
NTZ, DATE = T.TimestampNTZType(), T.DateType()

_ASSISTED = [
    ("order_date_time", NTZ), ("date", DATE), ("sales_person", S), ("sharing_percentage", D),
    ("amount_toward_sales_person", D), ("customer_type", S), ("oldest_order_number", S), ("customer_name", S),
    ("status", S), ("current_order_status", S), ("total_amount", D), ("order_type_in_mtd_form", S),
    ("newest_order_no", S), ("payment_method", S), ("tickets_id", S), ("approval_timestamp", NTZ),
    ("mtd_form_filled_timestamp", NTZ), ("total_metal_amt", D), ("ticket_id_text", S), ("ticket_created_at", NTZ),
    ("invoice_status", S), ("lead_sources", S), ("first_connected_time", NTZ), ("true_false", B),
    ("first_connect_time_true_false", B), ("username_frontend", S), ("team", S),
    ("order_limit_team_wise_investigate", S), ("pending_approval_02_step_timestamp", NTZ),
    ("diff_min_ticket_created_vs_02_pending_approval", L), ("true_false_02_vs_ticket_created_date", B),
    ("diff_min_1st_connect_vs_10_order_approved", L), ("true_false_02_vs_1st_time_connect", B),
    ("order_phone_number_1", S), ("lead_phone_number", S), ("order_phone_ne_lead_phone", B),
    ("ticket_date_more_than_1_month_older_than_order_date", L), ("lead_source_for_sales_report_data_category_1", S),
    ("lead_source_for_sales_report_data_category_2", S), ("process_key", S), ("assigned_to", S), ("email_id", S),
    ("lead_created_at", DATE), ("budget", S), ("helper_budget", L), ("name_as_per_lead_budget", S),
    ("assigned_team_acc_to_budget", S), ("final_assigned_to_name", S), ("assigned_to_team", S),
    ("ticket_id_beyond_90_days", S), ("budget_team_mismatch_flag", S), ("invalid_sales_team_flag", S),
]
ASSISTED_ORDERS = T.StructType([T.StructField(n, t, True) for n, t in _ASSISTED])
UNASSISTED_ORDERS = T.StructType(
    [T.StructField(n, t, True) for n, t in [
        ("purchase_date", DATE), ("oldest_order_number", S), ("customer_name", S), ("amount", D),
        ("newest_order_number", S),
    ]]
)
LEAD_HISTORY = T.StructType(
    [T.StructField(n, t, True) for n, t in [
        ("event_id", L), ("lead_id", S), ("state", S), ("updatedAt", T.TimestampType()), ("assignedTo", S), ("category", S),
        ("final_order_value", D),
    ]]
)
TEAM_BUDGET = T.StructType(
    [T.StructField("category", S, True), T.StructField("min_value", D, True), T.StructField("max_value", D, True)]
)
EMPLOYEES = T.StructType(
    [T.StructField("display_name", S, True), T.StructField("work_email", S, True), T.StructField("Project_id", S, True)]
)
