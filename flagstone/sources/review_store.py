"""Review dataset on storage: one Parquet dataset partitioned by ``rule_id``, versioned like the
snapshot (a version is visible once committed), so a batch of decisions never leaves readers
with a half-written table. Single writer assumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flagstone.sources.snapshot import committed_versions, read_snapshot, refresh_snapshot


def write_reviews_version(reviews: DataFrame, root: str, version: str | None = None) -> str:
    """Write the next version of the review dataset, one folder per rule."""
    return refresh_snapshot(reviews, root, version=version, partition_col="rule_id")


def read_reviews(spark: SparkSession, root: str, rule_id: str | None = None) -> DataFrame:
    """Newest committed review version; with ``rule_id`` only that partition is read."""
    df = read_snapshot(spark, root)
    return df.where(F.col("rule_id") == rule_id) if rule_id is not None else df


def has_reviews(spark: SparkSession, root: str) -> bool:
    return bool(committed_versions(spark, root))
