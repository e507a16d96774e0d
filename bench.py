"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR: data folder (default sf0.1); BENCH_CPUS: local threads. Each query runs to the end
of its plan with all columns computed, after one run on the smallest folder as a warm-up.
"""

from __future__ import annotations

import json
import os
import time

from pricemill.plans import queries as Q
from pricemill.session import default_cpus, local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
SMALL = "/root/testdata/sf0.001"

HEADLINE = (
    "market_analysis",
    "market_price_daily",
    "trailing_trend",
    "guardrail_eval",
    "latest_upsert",
    "elasticity_estimates",
    "price_candidates",
    "optimum_price",
    "optimized_categories",
    "tight_budget_categories",
    "listing_matches",
    "matching_quality",
    "suggestion_recs",
    "execution",
    "approval_resolution",
    "run_metrics",
    "run_summary",
    "call_stats",
    "guarded_follow",
    "strategy_scorecard",
)


def run(spark, name: str, folder: str) -> float:
    started = time.perf_counter()
    getattr(Q, name)(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    spark = local_session(default_cpus(), memory="16g", app="bench")
    if os.path.isdir(SMALL):
        for name in HEADLINE:
            run(spark, name, SMALL)
    seconds = {}
    for name in HEADLINE:
        seconds[name] = round(run(spark, name, FOLDER), 3)
    listings = Q.model_numbers(spark, FOLDER).count()
    strategy_days = 4 * Q.strategy_optimum(spark, FOLDER).count()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(FOLDER.rstrip("/")),
                "cpus": default_cpus(),
                "listings_per_sec": round(listings / seconds["listing_matches"]),
                "sku_days_per_sec": round(strategy_days / seconds["strategy_scorecard"]),
            }
        )
    )


if __name__ == "__main__":
    main()
