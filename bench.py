"""Wall time of the headline reports; prints one JSON line.

Reads $BENCH_SF_DIR (default /root/testdata/sf0.1) on local[$BENCH_CPUS]. The first pass over all
reports gives the cold times ("cold" in the output), $BENCH_RUNS further passes the warm ones, whose
medians are in "queries". A time covers building, planning and executing the query; its rows go to
the noop sink, so no report is gathered on the driver. "stored" has the warm times of the exported
reports on the stored clean table, without the joins that derive records from order tables.
"""

from __future__ import annotations

import json
import os
import statistics
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from tilltrail.operators.cleaning import clean_purchases
from tilltrail.plans import strategy
from tilltrail.plans.registry import STORED, all_queries
from tilltrail.session import build_session, scratch_folder
from tilltrail.sources.samples import sample_purchases
from tilltrail.sources.tables import read_clean, write_clean

HEADLINES = [
    "user_segmentation",
    "monthly_seasonality",
    "payday_analysis",
    "weekday_rhythm",
    "hourly_analysis",
    "category_master",
    "unlabelled_deep_dive",
    "brand_master",
    "unknown_brand_deep_dive",
    "strategy_portfolio",
    "purchases_view",
    "purchases_view_ids",
    "null_profile_view",
    "null_profile_raw",
    "user_frequency",
    "top_brands_avg_price",
    "brand_diversity",
    "smartphone_avg_price",
]


def timed(queries: dict[str, Callable[[], DataFrame]], runs: int) -> tuple[dict[str, float], dict[str, float]]:
    """Cold times and medians of the warm ones."""
    times: dict[str, list[float]] = {name: [] for name in queries}
    for _ in range(runs + 1):
        for name, query in queries.items():
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            times[name].append(time.perf_counter() - start)
    cold = {name: round(taken[0], 3) for name, taken in times.items()}
    return cold, {name: round(statistics.median(taken[1:]), 3) for name, taken in times.items()}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    partitions = os.environ.get("BENCH_SHUFFLE_PARTITIONS", "8")
    spark = build_session(
        "tilltrail-bench",
        f"local[{cpus}]",
        {
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
        },
        shuffle_partitions=int(partitions),
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    cold, warm = timed({n: lambda n=n: queries[n](spark, folder) for n in HEADLINES}, runs)
    stored_path = scratch_folder(spark, "bench")
    write_clean(clean_purchases(sample_purchases(spark, folder, STORED)), stored_path)
    clean = read_clean(spark, stored_path)
    _, stored = timed({r.__name__: lambda r=r: r(clean) for r in strategy.EXPORTS.values()}, runs)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "median warm wall time, sum over headline reports",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "stored": stored,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "shuffle_partitions": int(partitions),
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
