"""Scans of the business tables with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flagstone import schemas
from flagstone.sources.snapshot import read_snapshot


def read_assisted(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """Order snapshot (newest committed version); month partition column included."""
    return read_snapshot(spark, root, version=version)


def read_table(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_unassisted(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.UNASSISTED_ORDERS)


def read_lead_history(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.LEAD_HISTORY)


def read_team_budget(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.TEAM_BUDGET)


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, schemas.EMPLOYEES)
