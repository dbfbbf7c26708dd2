"""Column-level steps: schema checks, renames, defaults."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.config import REQUIRED_COLUMNS, SERIES


def require_columns(df: DataFrame, columns: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    """The frame itself, or ValueError naming what is missing. Runs no job."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing required columns {missing}; expected {list(columns)}")
    return df


def rename_canonical(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"arrival_date": "ds", "mbt": "y"})


def with_series_id(df: DataFrame, value: str = "E") -> DataFrame:
    """A constant series id, unless the frame has one."""
    return df if SERIES in df.columns else df.withColumn(SERIES, F.lit(value))


def drop_helpers(df: DataFrame, helpers: Sequence[str] = ("weather_hour", "datetime", "year")) -> DataFrame:
    return df.drop(*helpers)


def split_features_target(
    df: DataFrame, target: str = "mbt", target_pos: int = 1
) -> tuple[list[str], str, bool]:
    """(feature columns, target column, found by name).

    Features are all columns but the first; a target not found by name is taken by
    its place among the features.
    """
    features = df.columns[1:]
    found = target in features
    return features, target if found else features[target_pos], found


def default_column(df: DataFrame, column: str = "duration", value: float = 0.0) -> DataFrame:
    """The column, added if absent, with nulls replaced."""
    given = F.coalesce(F.col(column), F.lit(value)) if column in df.columns else F.lit(value)
    return df.withColumn(column, given)
