"""The order rules over a stream of new snapshot rows.

The reference refreshes its snapshot weekly and has no stream; its order rules are row-local
predicates, so they apply unchanged to a streaming frame. ``flag_stream`` evaluates every
predicate rule of the base table on the stream in one pass (as ``flag_all``).
``start_flagging`` removes reviewed cases per micro-batch with the same batch anti join as the
batch path (``foreachBatch``) and writes each epoch to its own folder of the sink, overwriting
it when an epoch is replayed after a failure, so a restart never duplicates rows. Lead rules
need whole histories and stay batch jobs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from flagstone.operators.flagging import flag_all, unreviewed
from flagstone.operators.rules import RuleParams, rules_on


def flag_stream(stream: DataFrame, params: RuleParams = RuleParams()) -> DataFrame:
    """Streaming (rule_id, case_key, row...) of every predicate-rule hit."""
    return flag_all(stream, rules_on("assisted_orders"), params)


def start_flagging(
    stream: DataFrame,
    reviews: DataFrame | Callable[[], DataFrame],
    sink_path: str,
    checkpoint: str,
    params: RuleParams = RuleParams(),
    available_now: bool = True,
):
    """Append unreviewed hits of each micro-batch to ``sink_path/epoch=<id>/rule_id=..``; the
    checkpoint folder (shared storage) makes the query restartable. ``reviews`` may be a
    function (for example ``lambda: read_reviews(spark, root)``): it is called for every
    micro-batch, so a running stream excludes review versions committed after it started."""

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        current = reviews() if callable(reviews) else reviews
        out = unreviewed(batch, current)
        out.write.mode("overwrite").partitionBy("rule_id").parquet(f"{sink_path}/epoch={epoch_id}")

    writer = flag_stream(stream, params).writeStream.foreachBatch(write_batch).option(
        "checkpointLocation", checkpoint
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
