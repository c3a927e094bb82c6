"""Times the headline queries and prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from kairoscope.plans import registry  # noqa: E402
from kairoscope.session import get_session  # noqa: E402

HEADLINE = ["hybrid_rrf", "lexical_bm25_topk", "temporal_edge_upsert", "contradiction_counts", "edge_stats_mdl", "transition_weights", "archive_expired", "turn_ingest_final_state", "chunk_windows", "burst_latest", "rate_limit_counts", "commit_context", "symbol_resolution", "memory_graph_read", "temporal_retrieve", "research_search", "report_ingest", "vector_index_exact", "text_index_topk"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session("bench", f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    registry.queries()  # those of all modules
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
