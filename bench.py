"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR  folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs after one warm-up; the median counts (default 3)
BENCH_QUERIES comma-separated query names (default: the headline list; "all" for every query)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "majority_vote", "majority_vote_slots", "majority_vote_many", "sc_slot_pivot", "wide_results", "self_consistency",
    "parse_responses", "document_answers", "confusion_matrix", "evaluation_summary", "compare_datasets", "cohens_kappa",
    "row_accuracy", "failed_rows", "failures_by_indicator", "missing_responses", "upsert_reprocessed", "expand_requests",
    "render_prompts", "request_chunks", "dependent_label", "polity_rollup", "geo_mean_having", "probe_accuracy",
    "usage_cost", "usage_rollup", "cost_per_indicator", "tiered_context", "label_logprob", "check_decision",
)


def main() -> None:
    from quorate.plans.catalog import load_all
    from quorate.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    queries = load_all()[0]
    wanted = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if wanted == "all" else (wanted.split(",") if wanted else list(HEADLINE))
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="quorate-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    for name in names:
        took = []
        for run in range(runs + 1):
            start = time.perf_counter()
            # The noop sink runs the whole plan and keeps no rows.
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            if run:
                took.append(time.perf_counter() - start)
        times[name] = round(statistics.median(took), 4)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
                "cores": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
