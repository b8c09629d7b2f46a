"""Times the headline queries and prints one JSON line. Each query runs whole, into the no-op sink, and gives its wall-clock seconds."""

from __future__ import annotations

import json
import os
import time

from folio.plans import catalog
from folio.session import local_session

QUERIES = [
    "route_counts", "classify_two_tier", "chunk_all", "build_nodes", "flag_issues", "html_text", "exact_dedup", "minhash_signatures",
    "edge_degree", "bfs_khop", "vector_topk", "bridge_vectors", "retrieve_mix", "condition_summary", "stratified_sample", "status_merge", "build_prompt",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "8g")
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in QUERIES:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
