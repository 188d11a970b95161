"""Lead-history pipelines (event log: many rows per lead ordered by ``updatedAt``).

K2 ``lead_transitions``     previous state + next non-closed (time, state) after each event
K1 ``lead_reopened``        closing entries re-opened more than N calendar days later
K3 ``lead_first_per_agent`` per (lead, agent): first assignment time and the category then
K4 ``lead_agent_rank``      agent order per lead + number of agents
K5 ``lead_latest_value``    latest non-NULL order value per lead
K6 ``lead_expected_category`` half-open range join of that value to budget bands
K7 ``lead_misrouted``       first agent matched the band, no later agent did

Ties on ``updatedAt`` are broken by ``tie`` (an event id); without one the order of equal
times is unspecified, as in the source system.

Scale notes. K3/K5 are plain aggregations (partial aggregation before the shuffle, so a hot
lead costs one row per map task). K2 needs the events of a lead in order; it is one window
over ``lead_id`` evaluated with a single descending sort and running frames only (O(n) per
lead). A lead with more events than one task should hold is found by a pre-aggregated count
and windowed in consecutive segments, stitched at the edges (``lead_transitions``). K4 ranks a lead
with too many agents by range blocks. K7 decides leads by mergeable aggregates, without a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flagstone.functions.keys import blank_trim, case_key, key_part, utc_date
from flagstone.operators.bands import segment_tree_join
from flagstone.operators.ranking import ranked_by_ranges
from flagstone.operators.rules import LEAD_1_KEY, LEAD_2_KEY, MISROUTE_FLAG, REOPEN_MIN_GAP_DAYS

CLOSED = "closed"


def _order_cols(tie: str | None, descending: bool) -> list[Column]:
    cols = ["updatedAt"] + ([tie] if tie else [])
    return [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in cols]


def _not_closed(state: Column) -> Column:
    # NULL state gives NULL here, so it is skipped as a "next" state
    return F.lower(state) != F.lit(CLOSED)


def _transitions_window(history: DataFrame, tie: str | None, part_cols: list[str]) -> DataFrame:
    """Window form of the transitions over partitions ``part_cols`` (the lead, or the lead and a
    time segment of it). Adds ``_first`` (no earlier row in the partition)."""
    newest_first = Window.partitionBy(*part_cols).orderBy(*_order_cols(tie, descending=True))
    seen_after = newest_first.rowsBetween(Window.unboundedPreceding, -1)
    open_state = _not_closed(F.col("state"))
    return history.select(
        "*",
        F.lead("state", 1).over(newest_first).alias("prev_state"),
        F.lead(F.lit(True), 1).over(newest_first).isNull().alias("_first"),
        F.last(F.when(open_state, F.col("updatedAt")), ignorenulls=True).over(seen_after).alias(
            "next_state_updatedAt"
        ),
        F.last(F.when(open_state, F.col("state")), ignorenulls=True).over(seen_after).alias("next_state"),
    )


DEFAULT_MAX_EVENTS_PER_TASK = 5_000_000


def _max_rows(spark, name: str, given: int | None) -> int:
    return int(spark.conf.get(f"flagstone.leads.{name}", str(DEFAULT_MAX_EVENTS_PER_TASK))) if given is None else given


def lead_transitions(history: DataFrame, tie: str | None = "event_id", max_events_per_task: int | None = None) -> DataFrame:
    """Each event with ``prev_state`` and the first later non-closed ``next_state`` /
    ``next_state_updatedAt`` (searched strictly after the row, NULLs skipped).

    One window, ordered newest first: the previous event is ``lead(1)`` and "first match
    after the row" is ``last(.., ignorenulls)`` over the rows already seen, a running frame
    (unbounded preceding .. 1 preceding) instead of a shrinking forward frame.

    Skew: a lead with more than ``max_events_per_task`` events (spark conf
    ``flagstone.leads.maxEventsPerTask``, default 5,000,000; 0 disables the check) is not
    windowed as one partition. Its events are numbered in order of (time, tie) by range blocks
    (``operators.ranking``) and cut at every ``max_events_per_task``-th of them, so no segment is
    larger, whatever burst of equal times a lead has. Each segment is windowed on its own, and the
    edges are stitched from one summary row per segment.
    """
    max_events_per_task = _max_rows(history.sparkSession, "maxEventsPerTask", max_events_per_task)
    if max_events_per_task <= 0:
        return _transitions_window(history, tie, ["lead_id"]).drop("_first")
    heavy_leads = (
        history.groupBy("lead_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_events_per_task)
    )
    # Each heavy lead holds more than max_events_per_task rows, so there are at most
    # total_rows / max_events_per_task of them; the count below is the runtime proof.
    if heavy_leads.limit(1).count() == 0:
        return _transitions_window(history, tie, ["lead_id"]).drop("_first")
    keys = heavy_leads.select(F.col("lead_id").alias("_heavy"))
    # events without a lead are one group as well, and often the largest: NULL matches NULL
    is_heavy = F.col("lead_id").eqNullSafe(F.col("_heavy"))
    normal = _transitions_window(history.join(keys, is_heavy, "left_anti"), tie, ["lead_id"]).drop("_first")
    heavy = _transitions_segmented(history.join(keys, is_heavy, "left_semi"), tie, max_events_per_task)
    return normal.unionByName(heavy)


def segmented(heavy: DataFrame, tie: str | None, max_rows: int) -> DataFrame:
    """Events with ``_seg``: consecutive stretches of at most ``max_rows`` events of a lead, in order of time and tie."""
    numbered = ranked_by_ranges(heavy, ["lead_id"], _order_cols(tie, descending=False), "_place")
    return numbered.withColumn("_seg", F.floor((F.col("_place") - 1) / max_rows).cast("long")).drop("_place")


def _transitions_segmented(heavy: DataFrame, tie: str | None, max_rows: int) -> DataFrame:
    """Transitions of heavy leads, windowed per (lead, segment) and stitched at the edges."""
    order_key = F.struct(*[F.col(c) for c in ["updatedAt"] + ([tie] if tie else [])])
    rows = segmented(heavy, tie, max_rows)
    local = _transitions_window(rows, tie, ["lead_id", "_seg"])

    open_state = _not_closed(F.col("state"))
    summary = rows.groupBy("lead_id", "_seg").agg(
        F.max_by("state", order_key).alias("_last_state"),
        F.min_by(F.col("updatedAt"), F.when(open_state & F.col("updatedAt").isNotNull(), order_key)).alias("_open_t"),
        F.min_by(F.col("state"), F.when(open_state, order_key)).alias("_open_state"),
    )
    w = Window.partitionBy("lead_id").orderBy("_seg")
    later = w.rowsBetween(1, Window.unboundedFollowing)
    carries = summary.select(
        F.col("lead_id").alias("_l"),
        F.col("_seg").alias("_s"),
        F.lag("_last_state", 1).over(w).alias("_carry_prev"),
        F.first("_open_t", ignorenulls=True).over(later).alias("_carry_t"),
        F.first("_open_state", ignorenulls=True).over(later).alias("_carry_state"),
    )
    # one row per segment: at most (heavy rows / max_rows + heavy leads) rows
    stitched = local.join(carries, F.col("lead_id").eqNullSafe(F.col("_l")) & (F.col("_seg") == F.col("_s")), "left")
    return stitched.select(
        *[c for c in heavy.columns],
        F.when(F.col("_first"), F.col("_carry_prev")).otherwise(F.col("prev_state")).alias("prev_state"),
        F.coalesce(F.col("next_state_updatedAt"), F.col("_carry_t")).alias("next_state_updatedAt"),
        F.coalesce(F.col("next_state"), F.col("_carry_state")).alias("next_state"),
    )


def lead_transitions_forward(history: DataFrame, tie: str | None = "event_id") -> DataFrame:
    """Literal twin of ``lead_transitions`` (LAG + forward frame); used by tests to prove the
    running-frame rewrite returns the same rows."""
    w = Window.partitionBy("lead_id").orderBy(*_order_cols(tie, descending=False))
    ahead = w.rowsBetween(1, Window.unboundedFollowing)
    open_state = _not_closed(F.col("state"))
    return history.select(
        "*",
        F.lag("state", 1).over(w).alias("prev_state"),
        F.first(F.when(open_state, F.col("updatedAt")), ignorenulls=True).over(ahead).alias("next_state_updatedAt"),
        F.first(F.when(open_state, F.col("state")), ignorenulls=True).over(ahead).alias("next_state"),
    )


def day_gap(later: Column, earlier: Column, dtype: T.DataType) -> Column:
    """Calendar-day difference in UTC of two times of one type, as the declared 64-bit integer."""
    return F.datediff(utc_date(later, dtype), utc_date(earlier, dtype)).cast("long")


def lead_reopened_cases(
    history: DataFrame, min_gap_days: int = REOPEN_MIN_GAP_DAYS, tie: str | None = "event_id"
) -> DataFrame:
    """Closing entries (closed, previous state not closed or absent) whose next non-closed
    state came more than ``min_gap_days`` calendar days later; before review exclusion.
    Carries ``rule_id`` and ``case_key`` (lead | UTC date of closing) plus the tie column."""
    t = lead_transitions(history, tie)
    state = F.lower(F.col("state"))
    prev = F.lower(F.col("prev_state"))
    dtype = history.schema["updatedAt"].dataType
    gap = day_gap(F.col("next_state_updatedAt"), F.col("updatedAt"), dtype)
    entries = t.where(
        (state == CLOSED)
        & (F.col("prev_state").isNull() | (prev != CLOSED))
        & F.col("next_state_updatedAt").isNotNull()
        & (gap > min_gap_days)
    )
    extra = [tie] if tie else []
    out = entries.select(
        "lead_id",
        F.col("state").alias("closed_state"),
        F.col("updatedAt").alias("closed_at"),
        "next_state",
        "next_state_updatedAt",
        gap.alias("day_gap"),
        "assignedTo",
        *extra,
    )
    closed_on = F.date_format(utc_date(F.col("closed_at"), dtype), "yyyy-MM-dd")
    key = F.concat_ws("|", key_part(LEAD_1_KEY[0]), F.coalesce(closed_on, F.lit("")))
    return out.select(F.lit("L1").alias("rule_id"), key.alias("case_key"), "*")


def lead_first_per_agent(history: DataFrame, tie: str | None = "event_id") -> DataFrame:
    """Per (lead, agent) over non-blank agents: first assignment time and the category of the
    earliest event (which may be NULL). Agents are grouped untrimmed."""
    order_key = F.struct(*[F.col(c) for c in ["updatedAt"] + ([tie] if tie else [])])
    return (
        history.where(F.col("assignedTo").isNotNull() & (blank_trim("assignedTo") != ""))
        .groupBy("lead_id", "assignedTo")
        .agg(
            F.min("updatedAt").alias("first_assigned_at"),
            F.min_by("category", order_key).alias("agent_category"),
        )
    )


def lead_agent_rank(first_per_agent: DataFrame, max_agents_per_task: int | None = None) -> DataFrame:
    """``assign_rank`` by (first time, agent) and ``agent_count`` per lead.

    A lead with more than ``max_agents_per_task`` agents (spark conf
    ``flagstone.leads.maxAgentsPerTask``, default 5,000,000; 0 disables the check) is ranked by prefix
    sums over range blocks instead of one window, and its count comes from an aggregation."""
    limit = _max_rows(first_per_agent.sparkSession, "maxAgentsPerTask", max_agents_per_task)
    order = [F.col("first_assigned_at").asc_nulls_first(), F.col("assignedTo")]
    w = Window.partitionBy("lead_id")
    plain = lambda df: df.select("*", F.row_number().over(w.orderBy(*order)).alias("assign_rank"), F.count(F.lit(1)).over(w).alias("agent_count"))
    if limit <= 0:
        return plain(first_per_agent)
    counts = first_per_agent.groupBy("lead_id").agg(F.count(F.lit(1)).alias("agent_count")).where(F.col("agent_count") > limit)
    if counts.limit(1).count() == 0:
        return plain(first_per_agent)
    heavy = counts.withColumnRenamed("lead_id", "_heavy")
    is_heavy = F.col("lead_id").eqNullSafe(F.col("_heavy"))
    light = plain(first_per_agent.join(heavy, is_heavy, "left_anti"))
    # each heavy lead has more than ``limit`` rows: few rows to join, by size
    ranked = ranked_by_ranges(first_per_agent.join(heavy, is_heavy, "left_semi"), ["lead_id"], order, "assign_rank")
    return light.unionByName(ranked.withColumn("assign_rank", F.col("assign_rank").cast("int")).join(heavy, is_heavy).drop("_heavy"))


def lead_latest_value(history: DataFrame, tie: str | None = "event_id") -> DataFrame:
    """Latest non-NULL ``final_order_value`` per lead (NULL when it never had one)."""
    v = F.col("final_order_value")
    order_key = F.struct(*[F.col(c) for c in ["updatedAt"] + ([tie] if tie else [])])
    return history.groupBy("lead_id").agg(F.max_by(v, F.when(v.isNotNull(), order_key)).alias("final_order_value"))


def lead_expected_category(values: DataFrame, bands: DataFrame, max_broadcast_bands: int = 10000) -> DataFrame:
    """LEFT range join: value in [min_value, max_value), NULL max = open. Overlapping bands give
    one row per band; values in a gap get NULL.

    The band table is a small lookup; its row count is checked before it is broadcast. Above
    the bound the join is an equi-join on the nodes of a segment tree (``operators.bands``).
    """
    cond = (F.col("v.final_order_value") >= F.col("b.min_value")) & (
        F.col("b.max_value").isNull() | (F.col("v.final_order_value") < F.col("b.max_value"))
    )
    b = bands.select("category", "min_value", "max_value")
    if b.count() <= max_broadcast_bands:
        joined = values.alias("v").join(F.broadcast(b).alias("b"), cond, "left")
        return joined.select("v.*", F.col("b.category").alias("expected_category"))
    return segment_tree_join(values, b)


def _norm(c: Column) -> Column:
    return F.upper(blank_trim(c))


def lead_misrouted_cases(history: DataFrame, bands: DataFrame, tie: str | None = "event_id") -> DataFrame:
    """Leads with more than one agent where the first agent's category equals the budget
    category and no later agent's does; before review exclusion (``rule_id``, ``case_key``).
    Agents and values meet on the lead, so events without a lead take no part.

    Leads are decided by mergeable aggregates alone: per (lead, agent), then per (lead, category of
    the agents), then per lead (latest value, number of agents, first agent). The first agent's
    category is the budget category, so no later agent has it just if that category has one agent.
    Agents are listed for the leads that are flagged, and for no other; a lead's agents are never in
    one window, and one with a million of them is aggregated by all tasks."""
    order_key = F.struct(*[F.col(c) for c in ["updatedAt"] + ([tie] if tie else [])])
    v = F.col("final_order_value")
    value_key = F.when(v.isNotNull(), order_key)
    per_agent = history.where(F.col("lead_id").isNotNull()).groupBy("lead_id", "assignedTo").agg(
        F.min("updatedAt").alias("first_assigned_at"),
        F.min_by("category", order_key).alias("agent_category"),
        F.max_by(v, value_key).alias("_value"),
        F.max(value_key).alias("_value_key"),
    )
    named = F.col("assignedTo").isNotNull() & (blank_trim("assignedTo") != "")
    agent = F.struct("first_assigned_at", "assignedTo", "agent_category")
    per_category = per_agent.groupBy("lead_id", F.when(named, _norm(F.coalesce("agent_category", F.lit("")))).alias("_category")).agg(
        F.count_if(named).alias("_agents"),
        F.min(F.when(named, agent)).alias("_first"),  # null times first, as in the ranking
        F.max_by("_value", "_value_key").alias("_value"),
        F.max("_value_key").alias("_value_key"),
    )
    # the first agent comes with the number of agents in its category
    per_lead = per_category.groupBy("lead_id").agg(
        F.max_by("_value", "_value_key").alias("final_order_value"),
        F.sum("_agents").alias("agent_count"),
        F.min(F.when(F.col("_first").isNotNull(), F.struct("_first", "_agents"))).alias("_start"),
    )
    per_lead = per_lead.select("lead_id", "final_order_value", "agent_count", "_start._first", F.col("_start._agents").alias("_alike"))
    may = per_lead.where((F.col("agent_count") > 1) & (F.col("_alike") == 1) & F.col("_first.agent_category").isNotNull())
    flagged = lead_expected_category(may, bands).where(_norm(F.col("_first.agent_category")) == _norm(F.col("expected_category")))
    flagged = flagged.drop("_alike")

    # a lead can be in several bands: its agents are listed once, from the events of flagged leads alone
    firsts = flagged.select("lead_id", F.col("_first.assignedTo").alias("_first_agent")).distinct()
    label = F.concat(F.col("assignedTo"), F.lit(" ("), F.coalesce(F.col("agent_category"), F.lit("NA")), F.lit(")"))
    others = history.where(named).join(firsts, "lead_id").where(F.col("assignedTo") != F.col("_first_agent"))
    listed = (
        lead_first_per_agent(others, tie)
        .groupBy("lead_id")
        .agg(F.array_sort(F.collect_list(F.struct("first_assigned_at", "assignedTo", label.alias("label")))).alias("_others"))
    )
    # a flagged lead has other agents, so each finds its list; keys alone don't need the lists, and an outer join tells so
    out = flagged.join(listed, "lead_id", "left").select(
        "lead_id",
        "final_order_value",
        "expected_category",
        "agent_count",
        F.col("_first.assignedTo").alias("first_assignee"),
        F.col("_first.agent_category").alias("first_assignee_category"),
        F.array_join(F.transform("_others", lambda x: x["label"]), ", ").alias("other_assignees"),
        F.lit(MISROUTE_FLAG).alias("Assignment_Flag"),
    )
    return out.select(F.lit("L2").alias("rule_id"), case_key(LEAD_2_KEY).alias("case_key"), "*")
