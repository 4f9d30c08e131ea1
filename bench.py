"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON. Each runs once to warm up, then the median of $BENCH_RUNS (2)."""

import json
import os
import statistics
import sys
import time

from docquarry import queries as q
from docquarry.session import session

NAMES = ["simhash_documents", "near_dup_groups", "fts_bm25", "exact_dups", "timeline_month", "stats_by_type", "list_filtered", "rag_context", "folder_counts"]


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "2"))
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in sys.argv[1:] or NAMES:
        times = []
        for _ in range(runs + 1):
            began = time.time()
            q.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        took[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({"metric": "total_median_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
