"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
on ``local[$BENCH_CPUS]`` and prints ONE JSON line. Each query is executed in
full with the ``noop`` sink (every row produced, nothing collected)."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "macro_metrics",
    "fold_metrics",
    "confusion_matrix",
    "auroc_by_label",
    "auroc_wide_export",
    "stratified_split",
    "split_sizes_orders",
    "multi_stage_metrics",
    "confidence_normalised",
    "format_compliance",
    "sections",
    "keyword_rate",
    "error_keywords",
    "confidence_summary",
    "batch_inference_python",
    "streaming_confusion",
    "prompt_evaluation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE

    from labelforge.plans.catalog import QUERIES
    from labelforge.session import get_spark

    spark = get_spark(f"local[{cpus}]", max(8, 2 * cpus), app="labelforge-bench",
                      extra={"spark.driver.memory": "16g"})
    # warm-up: the same code paths once on the smallest data set (JIT, codegen
    # caches, Python workers), so the timed runs measure steady state
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if not os.path.exists(f"{warm_dir}/documents.parquet"):
        warm_dir = sf_dir
    for n in names:
        QUERIES[n](spark, warm_dir).write.format("noop").mode("overwrite").save()

    timings = {}
    for n in names:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[n] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1] if "sf" in sf_dir else sf_dir
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
