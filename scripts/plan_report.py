"""Summarise the physical plan of every registered query.

    python scripts/plan_report.py [sf_dir] > PLANS.md

Counts exchanges (shuffles), broadcasts, aggregate kinds, window operators and
Python stages in the executed-plan text, and lists each scan's pushed filters
and read schema.  Query construction collects a block of questions and numbers
transcripts; the plans themselves are not executed.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

PATTERNS = {
    "shuffles": r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange RoundRobin|Exchange SinglePartition",
    "broadcasts": r"BroadcastExchange",
    "hash_agg": r"\bHashAggregate\(",
    "sort_agg": r"\bSortAggregate\(",
    "obj_agg": r"\bObjectHashAggregate\(",
    "windows": r"\bWindow \[",
    "topk_partial": r"WindowGroupLimit .*Partial",
    "smj": r"SortMergeJoin",
    "bhj": r"BroadcastHashJoin",
    "python": r"ArrowEvalPython|MapInPandas|MapInArrow|FlatMapCoGroupsIn(Pandas|Arrow)",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from tallyspark.session import get_session
    from tallyspark.plans.registry import QUERIES
    spark = get_session("local[8]", 16)
    spark.sparkContext.setLogLevel("ERROR")
    print(f"# Physical plans of the registered queries ({os.path.basename(sf)})\n")
    print("Generated by `scripts/plan_report.py` from `executedPlan` (before AQE re-planning). "
          "`shuffles` counts hash/range/round-robin exchanges; a broadcast is not a shuffle.\n")
    print("| query | " + " | ".join(PATTERNS) + " | scans: pushed filters / read columns |")
    print("| --- " * (len(PATTERNS) + 2) + "|")
    for name, fn in QUERIES.items():
        df = fn(spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        counts = [str(len(re.findall(p, plan))) for p in PATTERNS.values()]
        scans = []
        for m in re.finditer(r"FileScan (\w+) \[([^\]]*)\].*?PushedFilters: \[([^\]\n]*)", plan):
            table = re.search(r"/(\w+)\.parquet", m.group(0))
            cols = len(m.group(2).split(","))
            pushed = m.group(3) or "-"
            scans.append(f"{table.group(1) if table else '?'}: {pushed[:60]} / {cols} cols")
        print(f"| `{name}` | " + " | ".join(counts) + " | " + "; ".join(scans) + " |")


if __name__ == "__main__":
    main()
