"""Access roster (N6): employees whose project list names this system."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flagstone.functions.keys import blank_trim


def roster_members(employees: DataFrame, system: str) -> DataFrame:
    """(work_email, email_key, name) of members: the comma list holds the system (trimmed, any
    case; a prefix does not count). The name falls back to the e-mail."""
    wanted = system.lower()
    member = F.exists(F.split(F.col("Project_id"), ","), lambda p: F.lower(blank_trim(p)) == F.lit(wanted))
    return employees.where(member).select(
        "work_email",
        F.lower(F.col("work_email")).alias("email_key"),
        F.coalesce(F.col("display_name"), F.col("work_email")).alias("name"),
    )


def lookup_member(employees: DataFrame, email: str, system: str) -> DataFrame:
    """At most one roster row for an e-mail (case-insensitive), first by e-mail order; the name
    falls back to the e-mail as given."""
    m = roster_members(employees, system).where(F.col("email_key") == F.lit(email.lower()))
    return m.orderBy("work_email").limit(1).select(F.coalesce(F.col("name"), F.lit(email)).alias("name"))
