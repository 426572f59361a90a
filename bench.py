"""Time the headline queries on one machine and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (timed
runs per query after a warm-up of the session, default 1), BENCH_ONLY (comma-separated names).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

HEADLINE = [
    "bars_from_ticks",
    "dedup_keep_last",
    "coverage_intervals",
    "asof_backward_tolerance",
    "rolling_universe",
    "factor_momentum",
    "factor_kdj",
    "factor_atr",
    "factor_volume_confirmed_reversal_event",
    "factor_funding_rate",
    "outlier_mad_cross_section",
    "rank_cross_section",
    "neutralize_two_exposures",
    "execution_return_labels",
    "ic_summary_spearman",
    "quantile_returns_cross_section",
    "factor_correlation",
    "unique_contribution",
    "ic_scores_renormalize",
    "quantile_portfolio_long_short",
    "portfolio_trade_log",
    "trade_ledger",
    "report_rolling_ols",
    "latest_state",
]


def main() -> None:
    from tidemark.queries import REGISTRY
    from tidemark.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    only = [n for n in os.environ.get("BENCH_ONLY", "").split(",") if n]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    for name in ("bars_from_ticks", "ic_summary_spearman"):
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only or HEADLINE:
        taken = []
        for _ in range(runs):
            started = time.perf_counter()
            REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        times[name] = round(statistics.median(taken), 3)
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf.group(1)) if sf else None,
            }
        )
    )


if __name__ == "__main__":
    main()
