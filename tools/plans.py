"""Write PLANS.md: the formatted physical plan (AQE off, so the static plan is shown) of the
headline queries, trimmed to the operator lines and scan details.

usage: python tools/plans.py [sf_dir]
"""

from __future__ import annotations

import re
import sys

sys.path.insert(0, ".")
from flagstone.plans.catalog import build_queries  # noqa: E402
from flagstone.session import build_session  # noqa: E402

HEADLINE = ["flagged_1_1", "flagged_counts", "lead_reopened", "lead_misrouted", "review_apply", "table_page"]
KEEP = re.compile(r"^\(\d+\) |^(PushedFilters|PartitionFilters|ReadSchema|Join type|Join condition|Arguments|Keys|Left keys|Right keys|Functions)")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    q = build_queries()
    out = ["# Physical plans of the headline queries", "",
           f"Generated by `tools/plans.py` on `{sf}` with AQE off (the static plan; at run time AQE",
           "may turn a sort-merge join into a broadcast join and coalesce partitions). Only operator",
           "lines and scan / join details are kept.", ""]
    for name in HEADLINE:
        df = q[name](spark, sf)
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            text = df._jdf.queryExecution().explainString(
                spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", "true")
        tree, _, details = text.partition("\n\n\n")
        lines = [ln for ln in details.splitlines() if KEEP.match(ln.strip())]
        lines = [ln if len(ln) < 220 else ln[:217] + "..." for ln in lines]
        out += [f"## {name}", "", "```", tree.strip(), "", *lines, "```", ""]
    with open("PLANS.md", "w") as f:
        f.write("\n".join(out))


if __name__ == "__main__":
    main()
