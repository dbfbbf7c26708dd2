"""Sorts, limits and positional slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.config import SERIES, Config
from gapcast.functions.clock import minute_text


def sort_series(df: DataFrame, order: Sequence[str] = ("ds",), by: Sequence[str] = (SERIES,)) -> DataFrame:
    """Global sort; a range exchange, for output only."""
    return df.orderBy(*by, *order)


def head(df: DataFrame, rows: int = Config.request_rows) -> DataFrame:
    """First rows of each numbered series."""
    return df.where(F.col("idx") < rows)


def tail(df: DataFrame, rows: int = Config.report_rows) -> DataFrame:
    """Last rows of each numbered series."""
    return df.where(F.col("idx") >= F.col("n") - rows)


def latest(df: DataFrame, rows: int, order: Sequence[str]) -> DataFrame:
    """Newest rows over all series; each task keeps its own best before the merge."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(rows)


def positional_slice(df: DataFrame, start: int = 0, end: int = 175) -> DataFrame:
    return df.where((F.col("idx") >= start) & (F.col("idx") < end))


def slice_ticks(
    df: DataFrame, start: int = 0, end: int = 175, ticks: int = 8, time: str = "ds"
) -> DataFrame:
    """The evenly spaced rows of a slice that get a date label, with ``tick`` and ``label``."""
    at = F.array(*[F.lit(start + (k * (end - 1 - start)) // (ticks - 1)).cast("long") for k in range(ticks)])
    rows = positional_slice(df, start, end).where(F.array_contains(at, F.col("idx")))
    places = F.transform(at, lambda v, k: F.struct(k.alias("tick"), v.alias("at")))
    hit = F.filter(places, lambda p: p["at"] == F.col("idx"))
    return rows.withColumn("_hit", F.explode(hit)).select(
        *df.columns, F.col("_hit.tick").alias("tick"), minute_text(time).alias("label")
    )
