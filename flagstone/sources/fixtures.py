"""Deterministic business tables derived from the driver's TPC-H-ish parquet tables.

The SQL text is the single source of the test inputs: Spark runs it with DataFrame
arguments, the DuckDB oracle inlines it as CTEs over the pre-registered views. The
operator under test is written separately on each side; only the inputs are shared.

Placeholders: ``{orders}``, ``{customer}``, ``{events}``, ``{supplier}`` are source
tables, ``{NTZ}`` is the wall-clock timestamp literal keyword of the dialect and ``{UTC}`` the
instant at which the lead history begins.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASSISTED_COLUMNS_SQL = """
SELECT k, s,
  odt AS order_date_time,
  CAST(odt AS DATE) AS date,
  CASE WHEN k%97=0 THEN NULL ELSE 'SP' || LPAD(CAST((k+s*7)%25 AS STRING),2,'0') END AS sales_person,
  CASE WHEN k%10=0 THEN CAST(50 AS DOUBLE) ELSE CAST(100 AS DOUBLE) END AS sharing_percentage,
  CASE WHEN k%10=0 THEN o_totalprice/2 ELSE o_totalprice END AS amount_toward_sales_person,
  c_mktsegment AS customer_type,
  CASE WHEN k%89=0 THEN NULL ELSE 'O' || LPAD(CAST(k AS STRING),8,'0') END AS oldest_order_number,
  c_name AS customer_name,
  o_orderstatus AS status,
  CASE k%12 WHEN 0 THEN 'Canceled' WHEN 1 THEN 'Closed' WHEN 2 THEN 'Canceled - Sales to Review' WHEN 3 THEN NULL
    WHEN 4 THEN '9909 - Fully Refunded' WHEN 5 THEN '94.1 - RTO Received - Order To Be Cancelled' ELSE 'Processing' END AS current_order_status,
  o_totalprice AS total_amount,
  CASE k%5 WHEN 0 THEN 'COD-30' WHEN 1 THEN 'COD-100' WHEN 2 THEN 'Prepaid' WHEN 3 THEN NULL ELSE 'COD-0' END AS order_type_in_mtd_form,
  CASE WHEN k%83=0 THEN NULL ELSE 'N' || LPAD(CAST(k+1000000 AS STRING),8,'0') END AS newest_order_no,
  CASE k%3 WHEN 0 THEN 'cashondelivery' WHEN 1 THEN 'razorpay' ELSE 'banktransfer' END AS payment_method,
  CASE k%7 WHEN 0 THEN NULL WHEN 1 THEN 'TKT-' || CAST(k AS STRING) ELSE 'CHQ-' || CAST(k AS STRING) END AS tickets_id,
  CASE WHEN k%23=0 THEN NULL ELSE odt + INTERVAL '1' MINUTE * ((k*3)%300) END AS approval_timestamp,
  odt + INTERVAL '1' MINUTE * 400 AS mtd_form_filled_timestamp,
  o_totalprice*0.25 AS total_metal_amt,
  CASE WHEN k%11=0 OR k%7=0 THEN NULL WHEN k%7=1 THEN 'Ticket TKT-' || CAST(k AS STRING) ELSE 'Ticket CHQ-' || CAST(k AS STRING) END AS ticket_id_text,
  CASE WHEN k%13=0 THEN NULL ELSE odt + INTERVAL '1' MINUTE * ((k*11)%240 - 60) END AS ticket_created_at,
  CASE k%4 WHEN 0 THEN 'Paid' WHEN 1 THEN 'Pending' WHEN 2 THEN 'Partially Paid' ELSE NULL END AS invoice_status,
  c_mktsegment AS lead_sources,
  CASE WHEN k%19=0 THEN NULL ELSE odt + INTERVAL '1' MINUTE * ((k*5)%600 - 200) END AS first_connected_time,
  CASE WHEN k%13=0 OR k%23=0 THEN NULL ELSE ((k*11)%240 - 60) > ((k*3)%300) END AS true_false,
  CASE WHEN k%23=0 OR k%19=0 THEN NULL ELSE ((k*5)%600 - 200) > ((k*3)%300) END AS first_connect_time_true_false,
  CASE WHEN CAST(FLOOR(k/4) AS BIGINT)%4=0 THEN 'user' || CAST(k%50 AS STRING) ELSE NULL END AS username_frontend,
  'Team ' || CAST(k%4 AS STRING) AS team,
  CASE WHEN o_totalprice > 400000 THEN 'Investigate' ELSE 'OK' END AS order_limit_team_wise_investigate,
  CASE WHEN k%17=0 THEN NULL ELSE odt + INTERVAL '1' MINUTE * ((k*7)%120) END AS pending_approval_02_step_timestamp,
  CASE WHEN k%13=0 OR k%17=0 THEN NULL ELSE ((k*7)%120) - ((k*11)%240 - 60) END AS diff_min_ticket_created_vs_02_pending_approval,
  CASE WHEN k%13=0 OR k%17=0 THEN NULL ELSE ((k*11)%240 - 60) > ((k*7)%120) END AS true_false_02_vs_ticket_created_date,
  CASE WHEN k%23=0 OR k%19=0 THEN NULL ELSE ((k*3)%300) - ((k*5)%600 - 200) END AS diff_min_1st_connect_vs_10_order_approved,
  CASE WHEN k%17=0 OR k%19=0 THEN NULL ELSE ((k*5)%600 - 200) > ((k*7)%120) END AS true_false_02_vs_1st_time_connect,
  '9' || LPAD(CAST(k AS STRING),9,'0') AS order_phone_number_1,
  CASE WHEN k%6=0 THEN '8' ELSE '9' END || LPAD(CAST(k AS STRING),9,'0') AS lead_phone_number,
  k%6<>0 AS order_phone_ne_lead_phone,
  CASE WHEN k%50=9 THEN 30 + k%60 ELSE NULL END AS ticket_date_more_than_1_month_older_than_order_date,
  c_mktsegment AS lead_source_for_sales_report_data_category_1,
  o_orderpriority AS lead_source_for_sales_report_data_category_2,
  'PK-' || CAST(k AS STRING) AS process_key,
  'Agent ' || CAST(k%30 AS STRING) AS assigned_to,
  'agent' || CAST(k%30 AS STRING) || '@example.com' AS email_id,
  CAST(odt - INTERVAL '1' DAY * (k%200) AS DATE) AS lead_created_at,
  o_orderpriority AS budget,
  CASE WHEN k%8=0 THEN NULL ELSE CAST(FLOOR(o_totalprice) AS BIGINT) END AS helper_budget,
  CASE WHEN k%3=1 THEN NULL ELSE 'Lead ' || CAST(k%9 AS STRING) END AS name_as_per_lead_budget,
  'Team ' || CAST((k+1)%4 AS STRING) AS assigned_team_acc_to_budget,
  'Agent ' || CAST(k%30 AS STRING) AS final_assigned_to_name,
  CASE WHEN k%29=0 THEN NULL ELSE 'Team ' || CAST((k + CAST(FLOOR(k/8) AS BIGINT)%2)%4 AS STRING) END AS assigned_to_team,
  CASE WHEN k%200>90 AND k%7=1 THEN 'TKT-' || CAST(k AS STRING) WHEN k%200>90 AND k%7<>0 THEN 'CHQ-' || CAST(k AS STRING) ELSE NULL END AS ticket_id_beyond_90_days,
  CASE WHEN k%4<>(k+1)%4 AND k%6=0 THEN 'Mismatch' ELSE NULL END AS budget_team_mismatch_flag,
  CASE WHEN k%15=2 THEN 'Invalid' ELSE NULL END AS invalid_sales_team_flag
"""

# The order rows before their columns are derived: narrow, with the order time.
ASSISTED_ROWS_SQL = """  SELECT o.*, c.c_name, c.c_mktsegment, o.o_orderkey AS k, 0 AS s,
    {NTZ} '2025-07-01 00:00:00' + INTERVAL '1' DAY * ((o.o_orderkey*37)%460) + INTERVAL '1' MINUTE * ((o.o_orderkey*13)%1440) AS odt
  FROM {orders} o JOIN {customer} c ON c.c_custkey=o.o_custkey
  UNION ALL
  SELECT o.*, c.c_name, c.c_mktsegment, o.o_orderkey AS k, 1 AS s,
    {NTZ} '2025-07-01 00:00:00' + INTERVAL '1' DAY * ((o.o_orderkey*37)%460) + INTERVAL '1' MINUTE * ((o.o_orderkey*13)%1440) AS odt
  FROM {orders} o JOIN {customer} c ON c.c_custkey=o.o_custkey
  WHERE o.o_orderkey%10=0
"""

ASSISTED_ORDERS_SQL = ASSISTED_COLUMNS_SQL + "FROM (\n" + ASSISTED_ROWS_SQL + ") x\n"

UNASSISTED_ORDERS_SQL = """
SELECT o_orderkey AS k,
  CAST({NTZ} '2025-07-01 00:00:00' + INTERVAL '1' DAY * ((o_orderkey*37)%460) AS DATE) AS purchase_date,
  'O' || LPAD(CAST(o_orderkey AS STRING),8,'0') AS oldest_order_number,
  CASE CAST(FLOOR(o_orderkey/4) AS BIGINT)%50 WHEN 0 THEN 'test user' WHEN 1 THEN 'Test Account' WHEN 2 THEN 'Pawan Kumar'
    WHEN 3 THEN 'Latest Shop' WHEN 4 THEN 'TEST CAPS' WHEN 5 THEN NULL WHEN 6 THEN 'Ankita R' ELSE c_name END AS customer_name,
  o_totalprice AS amount,
  CASE WHEN o_orderkey%83=0 THEN NULL ELSE 'N' || LPAD(CAST(o_orderkey AS STRING),8,'0') END AS newest_order_number
FROM {orders} JOIN {customer} ON c_custkey=o_custkey
"""

LEAD_HISTORY_SQL = """
SELECT event_id,
  CASE WHEN event_id%211<>7 THEN 'L' || LPAD(CAST(user_id*20 + event_id%20 AS STRING),6,'0') END AS lead_id,
  CASE WHEN event_id%31=0 THEN NULL WHEN event_type='click' AND event_id%2=0 THEN 'CLOSED' WHEN event_type='click' THEN 'Closed'
    WHEN event_type='error' THEN 'closed' WHEN event_type='purchase' THEN 'Won' WHEN event_type='signup' THEN 'New' ELSE 'Follow up' END AS state,
  {UTC} + (ts - {NTZ} '2024-01-01 00:00:00') * 12 AS updatedAt,
  CASE event_id%7 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'agent' || CAST(CAST(FLOOR(event_id/20) AS BIGINT)%5 AS STRING) END AS assignedTo,
  CASE WHEN event_id%29=0 THEN NULL ELSE CASE (event_id*7)%3 WHEN 0 THEN ' silver ' WHEN 1 THEN 'GOLD' ELSE 'Platinum' END END AS category,
  CASE WHEN CAST(FLOOR(event_id/20) AS BIGINT)%3<>0 THEN value*500 ELSE NULL END AS final_order_value
FROM {events}
"""

TEAM_BUDGET_SQL = """
SELECT * FROM (VALUES
  ('Silver', CAST(0 AS DOUBLE), CAST(10000 AS DOUBLE)),
  ('Gold', CAST(10000 AS DOUBLE), CAST(30000 AS DOUBLE)),
  ('Platinum', CAST(40000 AS DOUBLE), CAST(NULL AS DOUBLE))
) AS t(category, min_value, max_value)
"""

EMPLOYEES_SQL = """
SELECT s_suppkey AS k,
  CASE WHEN s_suppkey%7=0 THEN NULL ELSE s_name END AS display_name,
  CASE WHEN s_suppkey%2=0 THEN UPPER('user' || CAST(s_suppkey AS STRING) || '@example.com') ELSE 'user' || CAST(s_suppkey AS STRING) || '@example.com' END AS work_email,
  CASE s_suppkey%5 WHEN 0 THEN 'audit_app' WHEN 1 THEN 'hr, Audit_App ' WHEN 2 THEN 'crm' WHEN 3 THEN NULL ELSE 'audit_app_old,crm' END AS Project_id
FROM {supplier}
"""

FIXTURE_SQL = {
    "assisted_orders": (ASSISTED_ORDERS_SQL, ("orders", "customer")),
    "unassisted_orders": (UNASSISTED_ORDERS_SQL, ("orders", "customer")),
    "lead_history": (LEAD_HISTORY_SQL, ("events",)),
    "team_budget": (TEAM_BUDGET_SQL, ()),
    "employees": (EMPLOYEES_SQL, ("supplier",)),
}

# Source-table columns each fixture reads: the scan is pruned to these.
SOURCE_COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_mktsegment"),
    "events": ("event_id", "ts", "user_id", "event_type", "value"),
    "supplier": ("s_suppkey", "s_name"),
}


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A source table; a scan with fewer splits than the session's cores (one small file) is
    spread round-robin so the derivation uses every core. Large inputs are left as split."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    return df


def _dialect(text: str) -> str:
    return text.replace("{NTZ}", "TIMESTAMP_NTZ").replace("{UTC}", "TIMESTAMP_LTZ '2025-01-01 00:00:00Z'")


def derive(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived business table as a lazy DataFrame over the parquet sources."""
    text, sources = FIXTURE_SQL[name]
    frames = {s: source_table(spark, sf_dir, s) for s in sources}
    return spark.sql(_dialect(text), **frames)


#: Order rows that one task derives and writes, about; all columns of one are near a kilobyte.
ROWS_PER_TASK = 150_000


def derive_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order table laid out by month, in tasks of about :data:`ROWS_PER_TASK` rows.

    The narrow rows go over the network; their many columns are derived where they are written. A
    month is dealt over several tasks by a hash of the order, so a large one is the work of many."""
    frames = {s: source_table(spark, sf_dir, s) for s in FIXTURE_SQL["assisted_orders"][1]}
    rows = spark.sql(_dialect(ASSISTED_ROWS_SQL), **frames)
    cores = spark.sparkContext.defaultParallelism
    tasks = max(cores, -(-frames["orders"].count() // ROWS_PER_TASK))  # the count is that of the file footers
    dealt = F.pmod(F.xxhash64("k", "s"), F.lit(max(1, tasks // 4)))
    placed = rows.repartition(tasks, F.date_format("odt", "yyyy-MM"), dealt)
    return spark.sql(_dialect(ASSISTED_COLUMNS_SQL) + "FROM {rows}", rows=placed)


def _fingerprint(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Hash of the fixture text and the size / modification time of its source files."""
    text, sources = FIXTURE_SQL[name]
    h = hashlib.sha1(text.encode())
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for s in sources:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{s}.parquet")
        st = path.getFileSystem(conf).getFileStatus(path)
        h.update(f"{path.toString()}|{st.getLen()}|{st.getModificationTime()}".encode())
    return h.hexdigest()[:16]


# Fixtures partitioned by month of the order time (rule date floors prune these partitions).
MONTH_PARTITIONED = ("assisted_orders",)


_RESOLVED: dict[tuple, DataFrame] = {}


def fixture(spark: SparkSession, sf_dir: str, name: str, materialize: bool | None = None) -> DataFrame:
    """A derived business table. By default it is materialised once, like the weekly snapshot
    of the reference, as a committed version under ``spark.checkpoint.dir`` (keyed by a
    fingerprint of its SQL and sources) and read back from there; the order table carries the
    ``order_month`` partition column. ``materialize=False`` returns the lazy derivation.
    Committed versions never change, so the resolved read is reused within a session."""
    from flagstone.session import checkpoint_dir
    from flagstone.sources.snapshot import committed_versions, read_snapshot, refresh_snapshot, with_month

    if materialize is None:
        materialize = spark.conf.get("flagstone.fixtures.materialize", "true").lower() == "true"
    if not materialize or not FIXTURE_SQL[name][1]:
        return derive(spark, sf_dir, name)
    fp = _fingerprint(spark, sf_dir, name)
    cache_key = (spark.sparkContext.applicationId, sf_dir, name, fp)
    if cache_key in _RESOLVED:
        return _RESOLVED[cache_key]
    root = f"{checkpoint_dir(spark)}/flagstone/fixtures/{name}-{fp}"
    if not committed_versions(spark, root):
        if name in MONTH_PARTITIONED:
            refresh_snapshot(with_month(derive_by_month(spark, sf_dir)), root, version=uuid.uuid4().hex, placed=True)
        else:
            df = derive(spark, sf_dir, name)
            # keep the scan's own splits; only a result in fewer pieces than cores is spread
            cores = spark.sparkContext.defaultParallelism
            if df.rdd.getNumPartitions() < cores:
                df = df.repartition(cores)
            refresh_snapshot(df, root, version=uuid.uuid4().hex, partition_col=None)
    out = read_snapshot(spark, root, version=committed_versions(spark, root)[0])
    _RESOLVED[cache_key] = out
    return out


def duckdb_fixture(name: str) -> str:
    """The same fixture as DuckDB text over the pre-registered source views."""
    text, sources = FIXTURE_SQL[name]
    text = text.replace("{NTZ}", "TIMESTAMP").replace("{UTC}", "TIMESTAMP '2025-01-01 00:00:00'")
    for s in sources:
        text = text.replace("{" + s + "}", s)
    return text.strip()


def duckdb_with(*names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH`` clause defining the named fixtures (and extra CTEs) for an oracle query."""
    parts = [f"{n} AS (\n{duckdb_fixture(n)}\n)" for n in names]
    for n, body in (extra or {}).items():
        parts.append(f"{n} AS (\n{body.strip()}\n)")
    return "WITH " + ",\n".join(parts) + "\n"
