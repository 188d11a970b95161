"""Order listing by date range (B17), look-back presets."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The listing's floor date and its presets (days back; 0 = everything).
VIEW_START = "2025-07-01"
DATE_MONTH = "date_month"  # partition column: the month of ``date`` itself
PRESETS = {"7": 7, "30": 30, "90": 90, "all": 0}
_ISO_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def check_range(date_from: str, date_to: str) -> tuple[dt.date, dt.date]:
    """Both ends must be YYYY-MM-DD dates with from <= to; raises ValueError otherwise."""
    if not (isinstance(date_from, str) and isinstance(date_to, str)):
        raise ValueError("Invalid date range")
    if not _ISO_DATE.match(date_from) or not _ISO_DATE.match(date_to) or date_from > date_to:
        raise ValueError("Invalid date range")
    try:
        return dt.date.fromisoformat(date_from), dt.date.fromisoformat(date_to)
    except ValueError:
        raise ValueError("Invalid date range") from None


def orders_in_range(df: DataFrame, date_from: str, date_to: str, date_col: str = "date") -> DataFrame:
    """Rows with ``date`` in [from, to] (both included), newest first. The bounds are literals,
    so the filter reaches the Parquet scan. A snapshot's ``order_month`` comes from the order time,
    which may lie in another month than ``date`` or be NULL, so it says nothing here; a snapshot
    partitioned by ``date_month`` (see ``with_month``) is pruned."""
    lo, hi = check_range(date_from, date_to)
    cond = F.col(date_col).between(F.lit(lo), F.lit(hi))
    if DATE_MONTH in df.columns:
        cond = cond & F.col(DATE_MONTH).between(lo.isoformat()[:7], hi.isoformat()[:7])
    return df.where(cond).orderBy(F.col(date_col).desc())


def range_for(preset: str, as_of: dt.date) -> tuple[str, str]:
    """Dates of a look-back preset; both ends are included, so N days back spans N+1 days."""
    days = PRESETS[preset]
    if not days:
        return VIEW_START, as_of.isoformat()
    return (as_of - dt.timedelta(days=days)).isoformat(), as_of.isoformat()


def recent(df: DataFrame, preset: str, as_of: dt.date, date_col: str = "date") -> DataFrame:
    lo, hi = range_for(preset, as_of)
    return orders_in_range(df, lo, hi, date_col)
