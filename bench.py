"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from corpusloom.plans import load_all
from corpusloom.session import local_session

HEADLINE = [
    "html_to_markdown",
    "child_chunks",
    "chunk_report_by_corpus",
    "char_windows",
    "lexical_index",  # cuts and stores the passages and their index, which the next ones ask
    "bm25_topk",
    "vector_topk",
    "hybrid_search",
    "log_overview",
    "chunk_hits",
    "daily_quality",
    "log_search",
    "link_dedupe",
    "child_parent",
    "form_match",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cpus, max(8, cpus))
    queries = load_all()[0]
    # start the JVM code paths and the Python workers before timing
    queries["pages_scan"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
