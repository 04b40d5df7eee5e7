"""Time the headline queries and print one JSON line.

Each query runs once to warm up, then BENCH_RUNS times; the median counts. A run writes
all result rows to Spark's `noop` sink, so nothing is pruned and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from promptgov.plans.queries import queries  # noqa: E402
from promptgov.plans.session import build_session  # noqa: E402

HEADLINE = (
    "parse_requests", "extract_prompt", "normalize_input", "check_injection", "check_prompt", "redact_pii",
    "contains_pii", "scan_output", "sanitize_output", "mask_secrets", "token_bucket", "rate_limit_gate",
    "prompt_anomaly", "tenant_profile", "verdict_join", "gate_decision", "audit_json", "stats_totals",
    "stats_by_tenant", "violation_counts", "validate_policy", "stream_bucket",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")
    spark = build_session(
        "promptgov-bench",
        spark__master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "sum of median seconds over the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/"))[2:] or 0),
        "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
