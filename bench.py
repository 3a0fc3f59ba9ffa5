"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 BENCH_RUNS=3 python bench.py

Each query is built (including the tables that a search writes before its plan
is complete) and executed to completion with
the ``noop`` sink, so every row is computed but nothing is pulled to the
driver.  One warm-up run, then the median of ``BENCH_RUNS`` runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["dca_cpi", "dca_fixed_rate", "kpi_snapshot", "hash_embed", "knn_l2_top2", "doc_retrieval",
            "rag_prompts"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = max(1, int(os.environ.get("BENCH_RUNS", "3")))
    names = sys.argv[1:] or HEADLINE

    from tallyspark.session import get_session
    from tallyspark.plans.registry import QUERIES

    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2,
                        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEM", "16g")})
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    times: dict[str, float | None] = {}
    errors: dict[str, str] = {}
    for name in names:
        try:
            once(name)  # warm-up: JIT, Python workers, file listing
            times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        except Exception as e:  # noqa: BLE001 - a failing query is reported, not hidden
            times[name] = None
            errors[name] = f"{type(e).__name__}: {str(e)[:300]}"

    sf = os.path.basename(os.path.normpath(sf_dir)).replace("sf", "")
    out = {"metric": "headline_total_median_sec", "value": round(sum(t for t in times.values() if t is not None), 3),
           "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs}
    if errors:
        out["errors"] = errors
    print(json.dumps(out))
    if errors:
        sys.exit(1)


if __name__ == "__main__":
    main()
