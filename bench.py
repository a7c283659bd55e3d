"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of Parquet tables   (default /root/testdata/sf0.1)
BENCH_CPUS    local cores                (default 4)
BENCH_RUNS    timed runs per query       (default 3, after one warm-up; the median counts)
BENCH_SHARED  folder for staged tables   (default: Spark's own choice)
BENCH_QUERIES comma-separated query names (default: the headline set)
"""

from __future__ import annotations

import json
import os
import statistics
import time

from termlab.plans.workload import queries
from termlab.session import build_session
from termlab.sources.tables import clear_scratch

HEADLINE = (
    "nearest_pick",
    "term_structure",
    "cm_prices",
    "cm_weights",
    "log_returns",
    "residual_by_slope",
    "rolling_cov",
    "hedge_weights_tradable",
    "legs",
    "leg_return_quantiles",
    "daily_pnl",
    "horizon_stats",
    "loss_concentration",
    "signal_carry",
    "sized",
    "sized_with_pca",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "4"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        cpus,
        {
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
            **({"spark.checkpoint.dir": os.environ["BENCH_SHARED"]} if "BENCH_SHARED" in os.environ else {}),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in names:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    clear_scratch(spark)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
