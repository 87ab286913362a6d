"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from loreloom.plans import QUERIES
from loreloom.session import build_session

HEADLINE = (
    "clean_text html_to_text chunk_stats token_df bm25_topk vector_topk rrf_fuse near_dupes exact_dupes "
    "table_filter_agg column_profile table_completeness paths_3hop node_degree visible_docs latest_version "
    "snapshot_diff cdc_apply version_states transition_replay usage_rollup latency_quantiles retry_schedule "
    "issues conversation_context citation_check recommendations"
).split()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "20g",
        "spark.checkpoint.dir": os.environ.get("BENCH_SHARED", (Path.cwd() / "spark-warehouse" / "_bench").as_uri()),
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start the workers
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
