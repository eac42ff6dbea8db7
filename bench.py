"""Time the headline queries and print one JSON line.

Every query runs once to warm up and then ``BENCH_RUNS`` times; the best run counts.  All
result rows are computed and thrown away.
"""

from __future__ import annotations

import json
import os
import time

from lustra.session import local_session
from lustra.workload.queries import QUERIES

HEADLINE = (
    "clean_people",
    "clean_events",
    "profile_full",
    "profile_numeric",
    "profile_unique",
    "profile_histogram",
    "fill_median_lineitem",
    "fill_mode",
    "cap_iqr",
    "remove_iqr",
    "dedup_exact",
    "dedup_subset_first",
    "dedup_subset_none",
    "dup_flags",
    "cast_schema",
    "normalized_row",
    "validate_valid",
    "validate_errors",
    "validate_quarantine",
    "issue_counts",
    "cell_issues",
    "propose_repairs",
    "apply_repairs",
    "repair_audit",
    "auto_clean",
    "table_diff",
    "cell_match",
    "match_score",
    "action_scores",
    "run_summary",
    "inject_issues",
    "csv_roundtrip",
    "stream_clean",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = local_session(cores, "lustra-bench")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(min(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
