"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the table folder (default sf0.1), BENCH_CPUS the number of cores, BENCH_QUERIES an
optional comma-separated choice, or "all". Each query is run BENCH_RUNS times (default 3) and the
median is reported; one that takes more than a few seconds runs once. The layer tables that queries
read are built first, each timed under its own name, so that their cost is not hidden; ``build_model`` is
training with the published settings. ``gbt_importance``, which scores 120 permuted holdouts, is left out
unless chosen.
"""

import json
import os
import statistics
import sys
import time

from roomledger.plans.queries import QUERIES
from roomledger.plans.warehouse import warehouse
from roomledger.session import local_session

LAYERS = ["bronze", "silver_landed", "silver", "gold", "risk", "serving", "csv", "holdout", "model"]
SLOW = 3.0
HEADLINE = [
    "gold_hotel_month", "bronze_landing", "streamed_gold", "silver_table", "clustered_silver",
    "dq_metrics", "hotel_headline", "portfolio_rollup", "monthly_trend", "peak_month",
    "top_loss_months", "layer_counts", "duplicate_profile", "reservation_risk",
    "risk_band_summary", "risk_triage_share", "hotel_scorecard", "reservation_serving",
    "published_snapshot", "kpi_row", "at_risk_page", "filtered_page", "serving_json",
    "action_stream", "latest_action", "reservation_detail", "split_balance", "ranking_metrics",
    "class_report", "gbt_scores", "persona_city_view", "persona_visibility", "feature_importance",
]


def timed(name, run):
    start = time.perf_counter()
    run()
    seconds = time.perf_counter() - start
    print(f"{seconds:8.2f} {name}", file=sys.stderr, flush=True)
    return seconds


def execute(spark, sf_dir, name):
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    wanted = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
    chosen = list(QUERIES) if wanted == ["all"] else wanted or HEADLINE
    spark = local_session(cores, "roomledger-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    small = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if os.path.isdir(small):  # compile the plans once, untimed
        for name in chosen:
            if not name.startswith("gbt"):
                execute(spark, small, name)
    tables = warehouse(spark, sf_dir)
    seconds = {f"build_{name}": round(timed(f"build_{name}", lambda: getattr(tables, name)), 3) for name in LAYERS}

    for name in chosen:
        times = [timed(name, lambda: execute(spark, sf_dir, name))]
        # short queries need more repeats for a steady median
        while len(times) < (runs if times[0] >= 1 else max(runs, 7)) and times[0] < SLOW:
            times.append(timed(name, lambda: execute(spark, sf_dir, name)))
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "total seconds, median per query",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
    }))


if __name__ == "__main__":
    main()
