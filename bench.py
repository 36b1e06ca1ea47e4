"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR   folder of the order tables   (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores                  (default 8)

Every query runs twice, from the Parquet files to a discarded full result, and the shorter run counts. The hand-over
tables that later queries share are timed as entries of their own, in the order a monthly run writes them; entries named
`scratch_...` run a query that reads them with nothing written before.
"""

from __future__ import annotations

import json
import os
import sys
import time

from lapsewise.plans.catalog import QUERIES
from lapsewise.plans.handover import Handover
from lapsewise.session import local_session, scratch

HEADLINE = [
    "clean_transactions", "fifo_purchases", "price_matched_purchases", "rfm_table", "netting_policy_comparison",
    "order_table", "order_gaps", "labels_90d", "snapshot_features", "training_table",
]
HANDOVER = ["lots", "days", "labels", "training", "rfm_written"]
SCRATCH = ["label_prevalence_wilson", "asof_open_lots", "value_at_risk"]
AFTER = [
    "label_prevalence_wilson", "history_window_sensitivity", "asof_open_lots", "training_contract_checks",
    "recency_threshold_tuning", "capacity_table", "value_at_risk", "decision_table", "segment_stats", "dbscan_noise",
    "kmeans_segments", "logistic_scores",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/region.parquet").count()  # start the session before the first timing
    tables = Handover(spark, folder)
    times: dict[str, float] = {}

    def seconds(run) -> float:
        begun = time.perf_counter()
        run()
        return time.perf_counter() - begun

    def timed(name, run, runs: int = 1) -> None:
        times[name] = round(min(seconds(run) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    def whole(name) -> None:
        with scratch(spark):
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    for name in HEADLINE:
        timed(name, lambda: whole(name), 2)
    for name in SCRATCH:
        timed(f"scratch_{name}", lambda: whole(name))
        Handover.forget()
    for name in HANDOVER:
        timed(f"handover_{name}", getattr(tables, name))
    for name in AFTER:
        timed(name, lambda: whole(name), 2)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
