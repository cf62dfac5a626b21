"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bindings.queries import QUERIES  # noqa: E402
from terraloom.session import build_session  # noqa: E402

HEADLINE = [
    "profile_fields", "profile_missing", "duplicate_rows", "dedup_keep_first", "outlier_flags", "clip_outliers", "clean_table", "unit_convert",
    "issue_rollup", "constraint_checks", "range_violations", "template_projection", "term_mappings", "normalise_table", "mesh_edges", "mesh_topology",
    "face_areas", "mesh_invalid_index", "model_bounds", "compare_bounds", "slice_area", "nn_heatmap", "nested_borehole", "layer_cylinders",
    "version_numbers", "version_latest", "version_diff", "import_skip_duplicates", "batch_status", "text_entities",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start the executors
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline queries, total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(sf.group(1)) if sf else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
