"""Small irregular series, some of them very lopsided."""

from __future__ import annotations

import numpy as np
import pandas as pd

START = pd.Timestamp("2024-01-01")


def lopsided(rows: int = 900, seed: int = 3) -> pd.DataFrame:
    """Three series: one with two thirds of the rows, one short, one of a single row.

    A third of all rows share one timestamp, and some of those are full copies.
    """
    rng = np.random.default_rng(seed)
    sizes = {"hot": rows * 2 // 3, "mid": rows // 3 - 1, "one": 1}
    parts = []
    for name, n in sizes.items():
        at = np.sort(rng.integers(0, 86_400_000_000 * 20, n))
        if name == "hot":
            at[n // 4 : 3 * n // 4] = at[n // 4]
        part = pd.DataFrame({"series_id": name, "ds": START + pd.to_timedelta(at, unit="us")})
        part["tie"] = np.arange(n) // 2
        part["y"] = np.round(rng.gamma(2.0, 5.0, n), 3)
        parts.append(part)
    table = pd.concat(parts)
    copies = table[table.series_id == "hot"].index[rows // 4 : rows // 3]
    table.loc[copies, ["tie", "y"]] = [7, 1.5]
    return table.sample(frac=1, random_state=seed).reset_index(drop=True)


def ordered(table: pd.DataFrame) -> pd.DataFrame:
    """The same in (series, time, tie) order with positions."""
    out = table.sort_values(["series_id", "ds", "tie", "y"], kind="stable").reset_index(drop=True)
    out["idx"] = out.groupby("series_id").cumcount()
    out["n"] = out.groupby("series_id")["idx"].transform("size")
    return out


def ramp(spark, values: dict[str, list], minutes: float = 10.0, name: str = "y"):
    """A numbered frame with the given values per series, at even times."""
    rows = [
        (s, START.to_pydatetime() + pd.Timedelta(minutes=minutes * i).to_pytimedelta(), None if v is None else float(v), i, len(vs), 0)
        for s, vs in values.items()
        for i, v in enumerate(vs)
    ]
    return spark.createDataFrame(
        rows, f"series_id string, ds timestamp, {name} double, idx bigint, n bigint, chunk bigint"
    )


def collect(df, *order: str) -> list:
    return [tuple(r) for r in df.orderBy(*order).collect()]
