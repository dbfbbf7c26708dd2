"""The flagship in plain pandas on one thread, to set the Spark numbers against.

python bench_single_node.py [folder of the tables]
"""

from __future__ import annotations

import json
import sys
import time

import pandas as pd


def features(events: pd.DataFrame) -> pd.DataFrame:
    table = events.sort_values(["event_type", "ts", "event_id"])
    table["mbt"] = table.groupby("event_type")["ts"].diff().dt.total_seconds() / 60
    table = table[(table.value >= 0) & (table.value <= 55) & (table.mbt <= 35)].copy()
    signups = events[events.event_type == "signup"]
    hourly = signups.groupby(signups.ts.dt.floor("h"))["value"].agg(["max", "min", "count"])
    table = table.merge(hourly, left_on=table.ts.dt.round("h"), right_index=True, how="left")
    weather = ["max", "min", "count"]
    table[weather] = table.groupby("event_type")[weather].ffill()
    series = table.groupby("event_type")["mbt"]
    for width, fn in ((50, "std"), (10, "max"), (10, "mean"), (10, "std"), (50, "mean")):
        rolled = getattr(series.rolling(width), fn)().reset_index(level=0, drop=True)
        table[f"rolling_{fn}_{width}"] = rolled.groupby(table["event_type"]).bfill()
    table["dow"] = (table.ts.dt.dayofweek >= 5).astype(int)
    table[weather] = table.groupby("event_type")[weather].bfill()
    return table


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    began = time.perf_counter()
    source = pd.read_parquet(f"{folder}/events.parquet")
    result = features(source)
    print(json.dumps({"rows_in": len(source), "rows_out": len(result), "sec": round(time.perf_counter() - began, 3)}))
