"""Seconds per headline query: warm session, median of three runs, every row produced.

Prints one JSON line. `BENCH_SF_DIR` names the tables, `BENCH_CPUS` the cores.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pyspark  # noqa: E402

from basketry import catalog  # noqa: E402
from basketry.session import build_session  # noqa: E402

HEADLINE = [
    "order_performance", "product_kpis", "cohort_retention", "executive_kpis", "customer_360", "rfm", "rfm_monetary_band",
    "order_sequence", "contract_validation", "table_profile", "training_table", "snapshot_design", "demand_features",
    "forecast_errors", "capacity_evaluation", "roc_auc", "calibration", "review_dataset", "tfidf_weights", "theme_alerts",
    "root_cause_category", "balance_smd",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "20g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.load()

    def once(name: str) -> float:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(3)), 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                "sf": float(scale[1]) if scale else folder, "cpus": int(cpus), "spark": pyspark.__version__,
            }
        )
    )


if __name__ == "__main__":
    main()
