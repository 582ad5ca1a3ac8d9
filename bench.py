"""Times the headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

After ``$BENCH_LIMIT`` seconds (1,500 unless set) it ends with the figures that it has and names the queries without one.
"""

from __future__ import annotations

import json
import os
import sys
import threading
import time

from colonnade.plans.catalog import REGISTRY
from colonnade.session import local_session

HEADLINE = (
    "table_profile", "profile_roles", "missing_report", "duplicate_rows", "validation_rules", "numeric_summary",
    "categorical_summary", "top_values", "quantiles_by_narrowing", "corr_pairs", "corr_wide", "outlier_report",
    "outlier_rows", "prepared_table", "frequency_encode", "split_shares", "fold_shares", "weighted_scores",
    "confusion", "roc_points", "roc_auc", "regression_metrics", "batch_score", "stream_score", "leaderboard",
    "shap_adds_up", "shap_beeswarm", "version_resolve", "compare_regressors", "compare_classifiers",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    # The first jobs of a process pay for starting up; that is no property of a query.
    REGISTRY["table_size"](spark, folder).collect()
    seconds: dict[str, float] = {}

    def report() -> None:
        """One line with all figures so far."""
        print(json.dumps({
            "metric": "total wall-clock of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
            "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cores,
            "unfinished": [name for name in names if name not in seconds],
        }), flush=True)

    def give_up() -> None:
        report()
        # The query that runs cannot be waited for; the JVM ends with this process.
        os._exit(0)

    limit = threading.Timer(float(os.environ.get("BENCH_LIMIT", "1500")), give_up)
    limit.daemon = True
    limit.start()

    for name in names:
        started = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
        # Kept on disk as well, so that a run that is broken off still has figures.
        if out := os.environ.get("BENCH_OUT"):
            with open(out, "w", encoding="utf-8") as file:
                json.dump(seconds, file)
    limit.cancel()
    report()


if __name__ == "__main__":
    main()
