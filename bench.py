"""Headline-query benchmark: prints one JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default: the headline set below), BENCH_WARM_DIR
(untimed warm-up tables, default /root/testdata/sf0.001).
Each query is materialised with a no-op write (``format('noop')``), so the
timing covers the whole plan without collecting rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "knn_topk",
    "word_stats",
    "chunk_words",
    "html_clean",
    "article_assemble",
    "upsert_snapshot",
    "summary_fill",
    "rag_context",
    "greedy_match",
    "eval_wide",
    "eval_report",
]


def main() -> None:
    from quire.plans.catalog import QUERIES
    from quire.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n]
    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="quire-bench")
    # warm-up on the smallest tables (JVM JIT, codegen caches, Python workers);
    # not timed, so the numbers below are steady-state throughput at sf_dir
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in names:
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
