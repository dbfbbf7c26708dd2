"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the run.
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalog.queries import registered
from gapcast.plans.scratch import drop_stored
from gapcast.session import local_session

HEADLINE = (
    "flagship_features",
    "headways_all",
    "weather_join",
    "make_windows",
    "quantiles_11",
    "kde_200",
    "periodogram",
    "autopower",
    "standard_scale",
    "robust_scale",
    "rolling_origin_cv",
    "evaluate",
    "seasonal_quantile_forecast",
    "huber_regression",
    "parse_messages",
    "detect_arrivals",
    "stream_features",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    registry = registered()
    # One untimed run loads classes and compiles the plans all queries begin with.
    registry["flagship_features"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        began = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        drop_stored(spark)
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": total,
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "event_rows": rows,
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
