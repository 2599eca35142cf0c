"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "self_recovery", "classify_cells", "coverage_rank", "vec_mutual_knn", "bm25_topk", "corpus_redundancy", "top_terms_by_lang", "ppmi_table", "hypothesis_fitness",
    "audit_state_bitemporal", "late_episodes", "depends_on_walk", "triple_homomorphisms", "ngram_counts", "trajectory_labeled", "process_deviations",
]


def main() -> None:
    from sparrowgrid import registry
    from sparrowgrid.session import build_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    spark = build_session(cpus, max(8, 2 * int(cpus)) if cpus.isdigit() else 8, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    names = sys.argv[1:] or HEADLINE
    # The JVM and the Python workers are up before the first query is timed.
    spark.range(1000).selectExpr("sum(id)").collect()
    spark.range(0, 1000, 1, spark.sparkContext.defaultParallelism).mapInArrow(lambda frames: frames, "id long").count()
    times = {}
    for name in names:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "seconds for the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
