"""flagstone: rule-based case flagging and review jobs on Spark DataFrames.

Layout:
  sources/    scans of the input tables, fixture derivation, versioned snapshots
  functions/  Column-level helpers (case keys, blank-safe trim, display text, sort keys)
  operators/  DataFrame -> DataFrame jobs (rules, flagging, lead pipelines, reviews, exploration)
  plans/      the query catalogue (one callable per operator) and its DuckDB oracle SQL
  streaming/  the same rule filters over a streaming snapshot feed
"""

__version__ = "0.1.0"
