"""Headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]``: one JSON line, median of warm runs."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from labspark.plans.queries import QUERIES  # noqa: E402
from labspark.session import local_session  # noqa: E402

HEADLINE = [
    "linear_regression",
    "numeric_stats",
    "column_profile",
    "delimiter_detect",
    "angular_regression",
    "inverse_regression",
    "sampling_summary",
    "period_stats",
    "plane_rotation",
    "batch_search",
    "photo_features",
    "taxon_detail",
    "active_without_features",
    "doc_quality",
    "citations_missing",
    "payload_scrub",
    "payload_scrub_open",
    "generation_payloads",
    "citation_rules",
    "preview_blocks",
    "analysis_warnings",
    "analysis_reports",
    "pendulum_results",
    "arrival_statistics",
    "table_search",
    "multiline_cells",
    "bibliography_files",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, "bench")
    seconds: dict[str, float] = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} cold {taken[0]:.2f} warm {seconds[name]:.2f}", file=sys.stderr, flush=True)
    spark.stop()
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
