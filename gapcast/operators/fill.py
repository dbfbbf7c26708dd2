"""Null filling along a series, exact over chunk borders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapcast.config import SERIES
from gapcast.plans.layout import carry_in, chunk_window


def forward_fill(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (SERIES,), order: str = "idx"
) -> DataFrame:
    """Last known value so far; the frame has ``chunk`` and an order column."""
    w = chunk_window(by, order).rowsBetween(Window.unboundedPreceding, 0)
    carried = carry_in(df, {f"_in_{c}": F.col(c) for c in columns}, by, order)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_in_{c}")) for c in columns}
    return carried.withColumns(filled).drop(*[f"_in_{c}" for c in columns])


def backward_fill(
    df: DataFrame, columns: Sequence[str], by: Sequence[str] = (SERIES,), order: str = "idx"
) -> DataFrame:
    """Next known value: a forward fill read from the end, as a frame that reaches
    ahead without bound would be computed anew for each row."""
    w = Window.partitionBy(*by, "chunk").orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    carried = carry_in(df, {f"_in_{c}": F.col(c) for c in columns}, by, order, forward=False)
    filled = {c: F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_in_{c}")) for c in columns}
    return carried.withColumns(filled).drop(*[f"_in_{c}" for c in columns])


def fill_const(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    return df.fillna(value, subset=list(columns))
