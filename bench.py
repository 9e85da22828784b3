"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from depweave import registry
from depweave.session import local_session

HEADLINE = (
    "q2_repo_info", "q4_imported_by", "q5_imports", "q6_callers", "q8_external_symbols", "q9_ranked_search", "r9_call_binding",
    "g2_degree", "g5_layers", "g6_cycles", "h2_coupling", "h4_risk", "v3_cluster_edges", "v6_subgraph", "l6_crossings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores)
    spark.sparkContext.setLogLevel("ERROR")
    registry.QUERIES["q1_list_repos"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
