"""Exact places of rows within their key, without a key in one task.

Rows are put in order by range partitions, which may cut a key anywhere. A row's place is its place
within its block plus the rows of its key in earlier blocks: one small row per (key, block).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flagstone.session import checkpoint_dir


def ranked_by_ranges(rows: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """``rows`` with ``out``, the place of each row within ``keys`` in ``order``, counted from 1.

    Equal to ``row_number`` over a window by ``keys``; rows equal in ``order`` get places of their own.
    Null keys are a key. The ranges come from a sample, so the rows are written with their block under
    the checkpoint folder and read back: places and counts then see the same blocks."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark)}/flagstone/scratch/ranges-{uuid.uuid4().hex}"
    # equal rows may go to several blocks: a number of each row is the last key
    ranged = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*keys, *order, "_row").withColumn("_block", F.spark_partition_id())
    ranged.write.parquet(path)
    blocks = spark.read.schema(ranged.schema).parquet(path)
    local = blocks.withColumn(out, F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(*order, "_row")))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = blocks.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.col("_block").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_block") == F.col("_b")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return local.join(starts, same).select(*[F.col(f"`{c}`") for c in rows.columns], (F.col(out) + F.col("_start")).alias(out))
