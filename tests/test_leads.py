import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from flagstone.operators import leads
from flagstone.operators.ranking import ranked_by_ranges

HIST = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("lead_id", T.StringType()),
    T.StructField("state", T.StringType()),
    T.StructField("updatedAt", T.TimestampNTZType()),
    T.StructField("assignedTo", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("final_order_value", T.DoubleType()),
])
D0 = dt.datetime(2026, 1, 1)


def hist(spark, events):
    """events: (lead, state, day offset or datetime, agent, category, value)."""
    rows = []
    for i, e in enumerate(events):
        lead, state, t = e[0], e[1], e[2]
        ts = t if isinstance(t, dt.datetime) else D0 + dt.timedelta(days=t)
        rest = list(e[3:]) + [None] * (3 - len(e[3:]))
        rows.append((i, lead, state, ts, *rest))
    return spark.createDataFrame(rows, HIST)


def reopened(df):
    return sorted((r.lead_id, r.closed_state, r.day_gap, r.next_state) for r in leads.lead_reopened_cases(df).collect())


def test_close_runs_and_entries(spark):
    df = hist(spark, [
        ("A", "closed", 0), ("A", "CLOSED", 10), ("A", "Won", 100),          # one entry (closed run)
        ("B", "closed", 0), ("B", None, 5), ("B", "closed", 10), ("B", "Won", 100),  # NULL prev: two entries
        ("C", "New", 0), ("C", "Closed", 1),                                   # closed last: no reopen
    ])
    assert reopened(df) == [("A", "closed", 100, "Won"), ("B", "closed", 90, "Won"), ("B", "closed", 100, "Won")]


def test_gap_is_calendar_days_strictly_over_60(spark):
    df = hist(spark, [
        ("A", "closed", dt.datetime(2026, 1, 1, 23, 59)), ("A", "Open", dt.datetime(2026, 3, 2, 0, 1)),  # 60 days
        ("B", "closed", dt.datetime(2026, 1, 1, 23, 59)), ("B", "Open", dt.datetime(2026, 3, 3, 0, 1)),  # 61 days
    ])
    assert [(r[0], r[2]) for r in reopened(df)] == [("B", 61)]


def test_running_frame_equals_forward_frame_on_random_histories(spark):
    rnd = random.Random(7)
    states = ["closed", "CLOSED", "Closed", "Won", "New", None, "Follow up"]
    events = []
    for lead in range(60):
        for _ in range(rnd.randint(1, 12)):
            events.append((f"L{lead}", rnd.choice(states), rnd.randint(0, 40) if rnd.random() < 0.9 else None))
    rows = [(i, l, s, (D0 + dt.timedelta(days=d)) if d is not None else None, None, None, None)
            for i, (l, s, d) in enumerate(events)]
    df = spark.createDataFrame(rows, HIST)
    cols = ["event_id", "prev_state", "next_state", "next_state_updatedAt"]
    a = leads.lead_transitions(df).select(*cols)
    b = leads.lead_transitions_forward(df).select(*cols)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_budget_band_edges(spark):
    bands = spark.createDataFrame(
        [("Silver", 0.0, 10000.0), ("Gold", 10000.0, 30000.0), ("Platinum", 40000.0, None)],
        "category string, min_value double, max_value double")
    values = spark.createDataFrame(
        [("a", 0.0), ("b", 10000.0), ("c", 35000.0), ("d", 1e9), ("e", None), ("f", 29999.99)],
        "lead_id string, final_order_value double")
    got = dict((r.lead_id, r.expected_category) for r in leads.lead_expected_category(values, bands).collect())
    assert got == {"a": "Silver", "b": "Gold", "c": None, "d": "Platinum", "e": None, "f": "Gold"}


def test_bucketed_band_join_matches_nested_loop(spark):
    rnd = random.Random(3)
    bands = spark.createDataFrame(
        [(f"c{i}", float(lo), float(lo + rnd.randint(1, 500)) if rnd.random() < 0.9 else None)
         for i, lo in enumerate(rnd.randint(0, 5000) for _ in range(40))],
        "category string, min_value double, max_value double")
    values = spark.createDataFrame([(f"v{i}", rnd.uniform(-10, 6000)) for i in range(300)],
                                   "lead_id string, final_order_value double")
    a = leads.lead_expected_category(values, bands)
    b = leads.lead_expected_category(values, bands, max_broadcast_bands=0)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_agent_order_ties_null_category_and_untrimmed_names(spark):
    df = hist(spark, [
        ("A", "x", 0, "zed", None, 20000.0),   # tie on time: 'ann' ranks first by name
        ("A", "x", 0, "ann", "GOLD"),
        ("A", "x", 1, "ann ", "silver"),       # 'ann ' is a different agent
        ("A", "x", 2, "  ", "GOLD"),           # blank agent ignored
    ])
    fpa = leads.lead_first_per_agent(df)
    ranked = {r.assignedTo: (r.assign_rank, r.agent_count, r.agent_category)
              for r in leads.lead_agent_rank(fpa).collect()}
    assert ranked == {"ann": (1, 3, "GOLD"), "zed": (2, 3, None), "ann ": (3, 3, "silver")}
    bands = spark.createDataFrame([("Gold", 10000.0, 30000.0)], "category string, min_value double, max_value double")
    out = leads.lead_misrouted_cases(df, bands).collect()
    assert len(out) == 1
    assert out[0].first_assignee == "ann" and out[0].other_assignees == "zed (NA), ann  (silver)"


def test_segmented_path_for_heavy_leads_equals_forward_frame(spark):
    rnd = random.Random(11)
    states = ["closed", "CLOSED", "Won", "New", None, "Follow up"]
    events = []
    for lead in range(12):
        n = rnd.choice([1, 3, 40, 120])  # a few heavy leads
        for _ in range(n):
            day = rnd.randint(0, 300) if rnd.random() < 0.95 else None
            events.append((f"L{lead}", rnd.choice(states), day))
    rows = [(i, l, st, (D0 + dt.timedelta(days=d, minutes=rnd.randint(0, 3000))) if d is not None else None,
             None, None, None) for i, (l, st, d) in enumerate(events)]
    df = spark.createDataFrame(rows, HIST)
    cols = ["event_id", "prev_state", "next_state", "next_state_updatedAt"]
    ref = leads.lead_transitions_forward(df).select(*cols)
    for limit in (10, 25, 7):
        got = leads.lead_transitions(df, max_events_per_task=limit).select(*cols)
        assert got.count() == ref.count()
        assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0, limit


def test_a_burst_of_equal_times_is_cut_at_the_limit(spark):
    """One lead, one instant: segments are cut by event id, and none is above the limit."""
    rnd = random.Random(5)
    rows = [(i, "L", rnd.choice(["closed", "Won", None]), D0, None, None, None) for i in range(137)]
    rows += [(1000 + i, None, rnd.choice(["closed", "Won"]), None, None, None, None) for i in range(45)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, HIST).repartition(5)
    cols = ["event_id", "prev_state", "next_state", "next_state_updatedAt"]
    got = leads.lead_transitions(df, max_events_per_task=10).select(*cols)
    ref = leads.lead_transitions_forward(df).select(*cols)
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0
    sizes = leads.segmented(df, "event_id", 10).groupBy("lead_id", "_seg").count().collect()
    assert max(r["count"] for r in sizes) == 10 and len(sizes) == 14 + 5


def test_places_by_ranges_equal_a_window(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice(["hot", "hot", "a", None]), rnd.choice([None, 1, 2, 3]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, x int, i int").repartition(6)
    order = [F.col("x").asc_nulls_first(), F.col("i").desc()]
    got = ranked_by_ranges(df, ["k"], order, "place")
    want = df.withColumn("place", F.row_number().over(Window.partitionBy("k").orderBy(*order)).cast("long"))
    assert got.exceptAll(want).count() == 0 and got.count() == 500
    same = ranked_by_ranges(df.select(F.lit("k").alias("k"), F.lit(1).alias("x")), ["k"], [F.col("x")], "place")
    assert sorted(r.place for r in same.collect()) == list(range(1, 501))


def misrouted_plain(history, bands):
    """The pipeline stage by stage, with windows by lead over its agents."""
    w = Window.partitionBy("lead_id").orderBy(F.col("first_assigned_at").asc_nulls_first(), "assignedTo")
    agents = leads.lead_first_per_agent(history.where("lead_id is not null"))
    ranked = agents.withColumns({"rank": F.row_number().over(w), "agent_count": F.count("*").over(Window.partitionBy("lead_id"))})
    valued = ranked.join(leads.lead_expected_category(leads.lead_latest_value(history), bands), "lead_id").where("expected_category is not null")
    norm = lambda c: F.upper(F.trim(c))
    hit = norm(F.col("agent_category")) == norm(F.col("expected_category"))
    later = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", F.concat_ws("", "assignedTo", F.lit(" ("), F.coalesce("agent_category", F.lit("NA")), F.lit(")")).alias("t")))))
    grouped = valued.groupBy("lead_id", "final_order_value", "expected_category", "agent_count").agg(
        F.max(F.when(F.col("rank") == 1, F.col("assignedTo"))).alias("first_assignee"),
        F.count_if((F.col("rank") == 1) & hit).alias("a"), F.count_if((F.col("rank") > 1) & hit).alias("b"), later.alias("later"))
    flagged = grouped.where("agent_count > 1 and a = 1 and b = 0")
    return flagged.select("lead_id", "final_order_value", "expected_category", "agent_count", "first_assignee", F.array_join(F.transform("later", lambda x: x["t"]), ", ").alias("other_assignees"))


def misrouted_events(seed, hot):
    rnd = random.Random(seed)
    events = []
    for lead in [f"L{k}" for k in range(60)] + [None]:
        for _ in range(rnd.choice([1, 2, 5, 9])):
            events.append((lead, "x", rnd.randrange(4), rnd.choice([None, " ", "ann", "bob", "cy", "dee"]), rnd.choice([None, "gold ", "Silver", "GOLD", "tin"]), rnd.choice([None, 5.0, 15.0, 25.0])))
    events += [("hot", "x", 1 + k % 5, f"agent{k}", "tin" if hot else "Silver", 15.0) for k in range(400)] + [("hot", "x", 0, "zoe", "gold", None)]
    rnd.shuffle(events)
    return events


@pytest.mark.parametrize("seed", [1, 2])
def test_misrouted_leads_equal_the_windows(spark, seed):
    """A lead with a third of the events and more agents than a window may hold is one of them."""
    bands = spark.createDataFrame([("Silver", 0.0, 10.0), (" Gold", 10.0, 30.0), ("Tin", 20.0, None), (None, 0.0, 9.0)], "category string, min_value double, max_value double")
    df = hist(spark, misrouted_events(seed, hot=seed == 1))
    got = leads.lead_misrouted_cases(df, bands)
    want = misrouted_plain(df, bands)
    assert got.select(*want.columns).exceptAll(want).count() == 0 and got.count() == want.count() > 3
    assert got.where("lead_id = 'hot'").first().agent_count == 401
    assert "Window" not in got._jdf.queryExecution().executedPlan().toString()


def test_ranks_of_a_lead_with_many_agents(spark):
    events = misrouted_events(3, hot=True)
    agents = leads.lead_first_per_agent(hist(spark, events))
    plain, ranged = leads.lead_agent_rank(agents, 0), leads.lead_agent_rank(agents, 50)
    assert plain.schema == ranged.schema or [f.dataType for f in plain.schema] == [f.dataType for f in ranged.schema]
    assert plain.exceptAll(ranged).count() == 0 and ranged.exceptAll(plain).count() == 0
