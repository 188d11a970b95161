"""Page directories kept beside a stored version of a table, one per order."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame

from flagstone.operators.explore import MAX_TASK_ROWS, PageDirectory, SortKey, page_directory
from flagstone.sources.review_log import create_if_absent, read_text
from flagstone.sources.snapshot import _fs


def kept_directory(df: DataFrame, keys: list[SortKey], root: str, version: str, order: str, max_task_rows: int = MAX_TASK_ROWS) -> PageDirectory:
    """The directory of an order of a version, read if it is there, else made and kept.

    ``order`` names the sort keys and the filters of ``df``; whoever makes the same directory first
    keeps it, and later ones read that."""
    spark = df.sparkSession
    path = f"{root}/_pages/{version}-{hashlib.sha256(order.encode()).hexdigest()[:32]}.json"
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        create_if_absent(spark, path, page_directory(df, keys, max_task_rows).text())
    return PageDirectory.parsed(read_text(spark, path))
