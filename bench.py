"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the data and the cores."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from boxwright.plans import load_all
from boxwright.plans.registry import QUERIES
from boxwright.session import local_session

HEADLINE = (
    "jon_02_overlap_join", "jon_06_greedy_match", "agg_06_summary_metrics", "agg_09_confusion_matrix", "win_01_greedy_nms",
    "win_02_fast_nms", "win_03_rotated_nms", "agg_01_dataset_statistics", "prj_01_box_formats", "src_02_label_text",
    "win_09_line_counter", "agg_13_region_counts", "jon_14_nearest_neighbours", "top_03_stratified_split",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "boxwright-bench")
    load_all()
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
