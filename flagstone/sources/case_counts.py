"""Counts of open cases per rule, kept by signed changes per committed batch.

A count over the order table is made once per snapshot. With it goes a ledger: for each flagged case,
how many flagged rows it has. A commit of the review log then changes the counts by the ledger's rows
of the cases that it saved; the orders are not read again.

Layout under ``root`` (one per snapshot)::

    root/ledger/rule_id=<rule>/...        (case_key, n) of every flagged case
    root/_counts/<20 digits>.json         counts at a version of the review log, and its change

The file of a version is made from that of the version before it and from the commit alone, so whoever
makes it writes the same; it is created where none is, and missing ones are made by the next reader.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flagstone.operators.flagging import unreviewed
from flagstone.operators.reviews import KEYS
from flagstone.operators.rules import RULES
from flagstone.sources import review_log
from flagstone.sources.snapshot import _fs

LEDGER = "rule_id string, case_key string, n long"


def _path(root: str, version: int) -> str:
    return f"{root}/_counts/{version:020d}.json"


def counted_versions(spark: SparkSession, root: str) -> list[int]:
    """Versions of the review log that have counts, oldest first."""
    fs, p = _fs(spark, f"{root}/_counts")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[:20]) for n in names if n.endswith(".json") and n[:20].isdigit())


def _ledger(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(LEDGER).parquet(f"{root}/ledger").select("rule_id", "case_key", "n")


def _per_rule(rows: DataFrame) -> dict[str, int]:
    """Sum of ``n`` per rule; one row per rule comes to the driver."""
    return {r.rule_id: r.n for r in rows.groupBy("rule_id").agg(F.sum("n").alias("n")).collect()}


def start_counts(flagged_keys: DataFrame, log: str, root: str) -> int:
    """Writes the ledger of all flagged rows (rule_id, case_key) and the counts at the log's newest version; that version."""
    spark = flagged_keys.sparkSession
    ledger = flagged_keys.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    ledger.hint("rebalance", "rule_id").write.mode("errorifexists").partitionBy("rule_id").parquet(f"{root}/ledger")
    version = review_log.latest(spark, log)
    counts = _per_rule(unreviewed(_ledger(spark, root), review_log.read_log(spark, log, version)))
    review_log.create_if_absent(spark, _path(root, version), json.dumps({"counts": counts, "change": {}}))
    return version


def change_of(spark: SparkSession, log: str, root: str, entry: review_log.Entry) -> DataFrame:
    """(rule_id, n): what a commit takes from the counts, from its outcomes and the ledger alone."""
    saved = review_log.outcomes(spark, log, entry).where("status = 'saved'").select(*KEYS).distinct()
    return saved.join(_ledger(spark, root), KEYS).groupBy("rule_id").agg((-F.sum("n")).alias("n"))


def update_counts(spark: SparkSession, log: str, root: str) -> int:
    """Makes the counts of all versions of the log that lack them; the newest version counted."""
    known = counted_versions(spark, root)
    if not known:
        raise FileNotFoundError(f"no counts under {root}: start them first")
    last = known[-1]
    counts = json.loads(review_log.read_text(spark, _path(root, last)))["counts"]
    for version in [v for v in review_log.versions(spark, log) if v > last]:
        entry = review_log.entry(spark, log, version)
        change = _per_rule(change_of(spark, log, root, entry)) if entry.kind == review_log.DELTA else {}
        counts = {rule: counts.get(rule, 0) + change.get(rule, 0) for rule in {*counts, *change}}
        review_log.create_if_absent(spark, _path(root, version), json.dumps({"counts": counts, "change": change}, sort_keys=True))
        last = version
    return last


def open_counts(spark: SparkSession, log: str, root: str, version: int | None = None) -> DataFrame:
    """(rule_id, title, flagged) of all rules at a version of the log (the newest, if None), zero rows kept."""
    newest = update_counts(spark, log, root)
    counts = json.loads(review_log.read_text(spark, _path(root, newest if version is None else version)))["counts"]
    schema = T.StructType([T.StructField("rule_id", T.StringType(), False), T.StructField("title", T.StringType(), False), T.StructField("flagged", T.LongType(), False)])
    return spark.createDataFrame([(r.id, r.title, counts.get(r.id, 0)) for r in RULES], schema)
