"""Times the headline queries on ``local[$BENCH_CPUS]`` and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from auditlake.plans.queries import QUERIES
from auditlake.session import local_session

HEADLINE = [
    "flagship_secret_report",   # one detector, controls, ids, metrics
    "d5_config_secrets",        # one detector over all files
    "d38_scan_workspace",       # every detector
    "full_report_findings",     # every detector, then ids and hashes
    "f7_collect_evidence",
    "e8_access_logging_by_config",
    "f8_match_line_number",
    "g4_merkle_root",
    "g9_resolve_states",
    "r1_framework_coverage",
    "h5_auditor_verify",
    "h6_human_attest",
    "v2_topk_ensemble",
    "p4_fix_catalogue",
    "m1_stream_scan",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores)
    spark.sparkContext.setLogLevel("ERROR")
    # not timed: starts Python workers and lets the JVM compile its readers and planner
    QUERIES["flagship_secret_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        start = time.perf_counter()
        QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - start, 3)
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").count() + spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")), "files": files,
        "files_per_sec_all_detectors": round(files / times["d38_scan_workspace"], 1),
    }))


if __name__ == "__main__":
    main()
