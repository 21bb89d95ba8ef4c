"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose input and
cores. Every query runs to the end into a sink that discards its rows.
"""

from __future__ import annotations

import json
import os
import time

from tsengine.plans.queries import QUERIES
from tsengine.session import clear_scratch, local_session

HEADLINE = (
    "daily_panel",
    "parse_map_payload",
    "parse_array_payload",
    "merge_sources",
    "quality_score",
    "impute_linear",
    "rolling_means",
    "rolling_suppliers",
    "lag_features",
    "preprocess",
    "summary_statistics",
    "monthly_aggregates",
    "annual_aggregates",
    "correlation",
    "box_statistics",
    "linear_trend",
    "zscore_flags",
    "isolation_forest",
    "walk_forward_linear",
    "model_ranking",
    "residual_autocorrelation",
    "quantile_pairs",
    "holt_winters_fit",
    "walk_forward_smoothing",
    "forecast_run",
    "executive_kpis",
    "pipeline_summary",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["analysis_span"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        clear_scratch(spark)
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))
    spark.stop()


if __name__ == "__main__":
    main()
