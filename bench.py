"""Benchmark: wall time of the headline query keys.

Runs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` (default 8).  Each query is executed in full (a
``noop`` write, nothing collected to the driver): one warm-up, then the best
of ``$BENCH_REPEAT`` (default 2) runs.  Prints ONE JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitelens.plans.catalog import QUERIES, load_all  # noqa: E402
from sitelens.session import get_session  # noqa: E402

HEADLINE = [
    "manifest", "manifest_summary", "site_companies", "company_site",
    "symbol_summary", "text_length_summary", "language_breakdown", "clean_text",
    "page_extract", "first_level_links", "site_result", "reachability", "domain_funnel",
    "work_list", "build_classify_requests", "build_translate_requests", "batch_plan",
    "reassemble", "verdicts", "stratified_split", "tfidf", "threshold_sweep", "language_id", "run_summary",
    "collect_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=max(8, cpus))
    load_all()
    keys = only or HEADLINE
    times: dict[str, float] = {}
    for key in keys:
        fn = QUERIES[key]
        best = None
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.perf_counter() - t0
            if i > 0:
                best = dt if best is None else min(best, dt)
        times[key] = round(best, 3)
        print(f"[bench] {key}: {times[key]:.3f}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({"metric": "sum_best_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus, "repeat": repeat}))
    spark.stop()


if __name__ == "__main__":
    main()
