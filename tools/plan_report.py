"""Physical-plan summary of every registered query (final plans, after AQE).

    python tools/plan_report.py [sf_dir] > PLANS.md

For each query: hash / range / single-partition shuffles, broadcasts, join
strategies, aggregates, windows (and window group limits), Python operators,
and whether the Parquet scans carry pushed filters.  A review aid: any
single-partition exchange other than a final global aggregate, any window
without a group limit over fact rows, or any sort-merge join on a
low-cardinality key deserves a look.
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from landsight.registry.queries import QUERIES  # noqa: E402
from landsight.session import get_session  # noqa: E402

COUNTED = [
    ("hash shuffle", r"Exchange hashpartitioning"),
    ("range shuffle", r"Exchange rangepartitioning"),
    ("single-partition", r"Exchange SinglePartition"),
    ("broadcast", r"BroadcastExchange"),
    ("BHJ", r"BroadcastHashJoin"),
    ("SMJ", r"SortMergeJoin"),
    ("SHJ", r"ShuffledHashJoin"),
    ("hash agg", r"HashAggregate\(keys"),
    ("sort agg", r"SortAggregate\(key"),
    ("window", r"\bWindow \["),
    ("group limit", r"WindowGroupLimit"),
    ("python", r"MapInPandas|PythonMapInArrow|ArrowEvalPython|BatchEvalPython"),
    ("parquet scans", r"FileScan parquet"),
]


def final_plan(df) -> str:
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("== Initial Plan ==")[0]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", shuffle_partitions=8,
                        extra_conf={"spark.ui.showConsoleProgress": "false"})
    print("# Physical plans of the registered queries\n")
    print(f"Final plans after AQE at `{sf_dir}` on `local[8]` (`tools/plan_report.py`). "
          "Counts are operators in the final plan; the scan column tells whether the "
          "Parquet scans carry pushed filters.\n")
    print("A plan shows the last job only. Queries that store a table first -- the long "
          "indicator table, CSV, log or tile files, a lookup, profile counts, percentile "
          "ranges -- run the joins and shuffles that make it (for the indicator: "
          "`lineitem x supplier x nation`) before the plan that is counted here.\n")
    print("| query | " + " | ".join(name for name, _ in COUNTED) + " | pushed filters |")
    print("| --- " * (len(COUNTED) + 2) + "|")
    for name, fn in QUERIES.items():
        df = fn(spark, sf_dir)
        df.collect()
        plan = final_plan(df)
        counts = [str(len(re.findall(pat, plan))) for _, pat in COUNTED]
        scans = re.findall(r"FileScan parquet[^\n]*", plan)
        pushed = sum(1 for s in scans if re.search(r"PushedFilters: \[[^\]]+\]", s))
        print(f"| `{name}` | " + " | ".join(counts) + f" | {pushed}/{len(scans)} |")
    spark.stop()


if __name__ == "__main__":
    main()
