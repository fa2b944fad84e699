"""End-to-end walk through the library on the driver's test tables.

    python tools/demo.py [sf_dir]

Builds the long indicator table, stores it, prints the dashboard KPIs and
insights, runs a batch of coordinate requests through the workflow with the
stub models, appends the log, and prints the History report.  Scratch data
goes to a fresh folder under the session's checkpoint folder.
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from landsight.plans.dashboard import Dashboard  # noqa: E402
from landsight.plans.history import History  # noqa: E402
from landsight.plans.workflow import StubModelClient, run_requests  # noqa: E402
from landsight.session import get_session  # noqa: E402
from landsight.sources import indicators as I  # noqa: E402
from landsight.sources import testtables as T  # noqa: E402
from landsight.sources.store import table_path  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    spark = get_session("local[8]", extra_conf={"spark.ui.showConsoleProgress": "false"})
    scratch = table_path(spark.range(0), "demo")

    # Ingest once, then every plan reads the stored long table.
    I.write_indicator_table(I.to_long(T.observation(spark, sf_dir), "value"), f"{scratch}/indicator")
    dash = Dashboard(I.read_indicator_table(spark, f"{scratch}/indicator"), T.boundary(spark, sf_dir))
    print("KPIs per dataset and year")
    dash.kpis().orderBy("dataset", "year").show(30, truncate=False)
    print("Top and bottom countries of each dataset's insight series")
    dash.top_bottom().orderBy("dataset", "side", "rank").show(30, truncate=False)

    # Requests: the first run asks the models, the second is answered by the log.
    requests = T.request(spark, sf_dir)
    log_path, tiles = f"{scratch}/log", f"{scratch}/tiles"
    for run in (1, 2):
        res = run_requests(requests, log_path, StubModelClient, tiles)
        print(f"run {run}:", {r.source: r["count"] for r in res.groupBy("source").count().collect()})

    hist = History.from_paths(spark, log_path, tiles)
    hist.kpis().show(truncate=False)
    hist.table().show(5, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
