"""Numeric and text-cell expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: days in a year, as used for the frequency axis.
DAYS_PER_YEAR = 365.25
# Fixed value: the texts Python's float() takes; Spark's cast alone also takes '1.0f'.
NUMBER_TEXT = r"(?i)^\s*[+-]?((\d+(\.\d*)?|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)\s*$"


def safe_double(text: Column) -> Column:
    """Text to double, null if it is not a number."""
    return F.when(text.rlike(NUMBER_TEXT), F.trim(text).try_cast("double"))


def nan_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """NaN to null, so that comparisons drop missing values."""
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


def scale(x: Column, mean: Column, std: Column) -> Column:
    return (x - mean) / F.when(std != 0, std)


def unscale(x: Column, mean: Column, std: Column) -> Column:
    return x * std + mean


def error(actual: Column, predicted: Column) -> Column:
    return actual - predicted


def huber_loss(err: Column, delta: float = 1.0) -> Column:
    size = F.abs(err)
    return F.when(size <= delta, err * err * 0.5).otherwise((size - 0.5 * delta) * delta)


def pinball_loss(err: Column, level: float) -> Column:
    return F.greatest(err * level, err * (level - 1))


def per_year(per_day: Column) -> Column:
    return per_day * F.lit(DAYS_PER_YEAR)


def grid(low: Column, high: Column, points: int) -> Column:
    """Array of evenly spaced values from low to high, both included."""
    steps = F.sequence(F.lit(0), F.lit(points - 1))
    return F.transform(steps, lambda k: low + k * (high - low) / (points - 1))


def metric_text(value: Column) -> Column:
    return F.format_string("%.4f", value)


def as_text(value: Column) -> Column:
    return value.cast("string")


def row_key(series: Column, time_text: Column) -> Column:
    return F.concat_ws("#", series, time_text)
