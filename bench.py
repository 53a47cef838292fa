"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores.
Each query is built and run to its last row; the first pass of the flagship
query warms the session and is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

from faultline.queries import catalog
from faultline.session import local_session

HEADLINE = (
    "q_pattern_findings", "q_js_findings", "q_credential_scan", "q_exact_dedupe", "q_near_dedupe",
    "q_advisories", "q_frameworks", "q_file_counters", "q_full_scan", "q_score", "q_scan_reports",
    "q_admit_archives", "q_running_limits", "q_inline_admission", "q_tool_reports", "q_top_explain",
    "q_merge_replies", "q_status_current", "q_report_findings", "q_latest_reports", "q_report_detail",
    "q_areas", "q_graph_nodes", "q_edges", "q_dashboard",
)


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    run(spark, "q_score", sf_dir)
    seconds = {name: run(spark, name, sf_dir) for name in names}
    print(json.dumps({
        "metric": "headline queries, total wall clock", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
