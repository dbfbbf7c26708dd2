"""From raw arrivals to the feature table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.config import ROLLING_FEATURES, SERIES, WEATHER_COLUMNS, Config
from gapcast.functions.clock import weekend_flag
from gapcast.functions.numbers import nan_to_null
from gapcast.operators.clean import clean, cleaning_rules
from gapcast.operators.columns import default_column, rename_canonical, require_columns, with_series_id
from gapcast.operators.rolling import rolling
from gapcast.operators.weather import join_weather
from gapcast.plans.layout import positions, renumber

FEATURE_COLUMNS = ("ds", "duration", "y", "dow", *WEATHER_COLUMNS, *[name for name, _, _ in ROLLING_FEATURES])


def clean_arrivals(
    arrivals: DataFrame,
    cfg: Config = Config(),
    weather: bool = False,
    order: Sequence[str] = ("ds",),
    chunks: int | None = None,
) -> DataFrame:
    """Filtered arrivals, renamed to ds and y, as a numbered frame.

    A frame that comes from ``lay_out`` (it has ``gid``) keeps that order and is only
    renumbered; any other is laid out by ``order`` after the filters.
    """
    named = rename_canonical(clean(with_series_id(arrivals), cleaning_rules(cfg, weather)))
    if "gid" in named.columns:
        return renumber(named)
    return positions(named, order, chunks=chunks)


def add_features(
    numbered: DataFrame, weather: DataFrame | None = None, cfg: Config = Config(), dense: bool = False
) -> DataFrame:
    """Weather, rolling statistics, duration default and weekend flag on a numbered frame.

    ``dense`` says that y has no nulls, as after the filters.
    """
    joined = join_weather(numbered, weather, tz=cfg.weather_tz)
    rolled = rolling(joined, dense=dense, block_rows=cfg.block_rows)
    return default_column(rolled).withColumn("dow", weekend_flag("ds"))


def feature_table(
    arrivals: DataFrame,
    weather: DataFrame | None = None,
    cfg: Config = Config(),
    order: Sequence[str] = ("ds",),
    chunks: int | None = None,
) -> DataFrame:
    """The whole preparation: check, clean, weather, rolling, calendar.

    Filters run before the order is laid out, so the range exchange moves only kept
    rows; all windows after it share one exchange by (series, block).
    """
    require_columns(arrivals, ("arrival_date", "duration", "mbt"))
    numbered = clean_arrivals(nan_to_null(arrivals, ["duration", "mbt"]), cfg, weather is not None, order, chunks)
    featured = add_features(numbered, weather, cfg, dense=True)
    shown = [c for c in FEATURE_COLUMNS if c in featured.columns]
    return featured.select(SERIES, "idx", "n", *shown)


def written_columns(table: DataFrame) -> DataFrame:
    """The feature table in file order, without the position columns."""
    return table.select(F.col(SERIES), *[c for c in FEATURE_COLUMNS if c in table.columns])
