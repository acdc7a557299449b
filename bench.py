"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import time

from quillmesh.plans import registry
from quillmesh.session import build_session

HEADLINE = ["bm25_batch", "vector_topk_batch", "hybrid_topk", "tokenize_docs", "fixed_chunks", "sentence_chunks", "html_to_text", "link_resolve", "backlinks", "graph_stats", "pagerank", "components", "bfs_khop", "health_report", "levenshtein_fuzzy_join", "search_summary", "cdc_diff", "session_summary", "events_sessions"]


def main() -> None:
    at = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, int(cpus))
    known, took = registry.queries(), {}
    known["term_df"](spark, at).write.format("noop").mode("overwrite").save()  # compiles and opens files once
    for name in HEADLINE:
        began = time.time()
        known[name](spark, at).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(at.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
