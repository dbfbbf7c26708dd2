"""Hourly weather and monthly facts joined to arrivals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapcast.config import SERIES, WEATHER_COLUMNS
from gapcast.functions.clock import from_zone, month_key, round_hour
from gapcast.operators.asof import asof_join
from gapcast.plans.layout import attach
from gapcast.plans.scratch import store


def weather_hours(weather: DataFrame, tz: str = "UTC") -> DataFrame:
    """``weather_hour`` and the weather columns present; raises if an hour comes twice."""
    present = [c for c in WEATHER_COLUMNS if c in weather.columns]
    hours = store(
        weather.select(from_zone("datetime", tz).alias("weather_hour"), *present), "weather"
    )
    twice = hours.groupBy("weather_hour").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"weather has several rows for {twice[0][0]}: arrivals would be repeated")
    return hours


def filled_hours(weather: DataFrame, tz: str = "UTC") -> DataFrame:
    """Every hour of the table, each value as of the nearest earlier one that is known.

    One row per hour of the time span, however many arrivals; days are spread before their
    hours are listed. ``join_filled`` also serves later hours.
    """
    hours = weather_hours(weather, tz)
    columns = [c for c in hours.columns if c != "weather_hour"]
    ends = hours.agg(F.min("weather_hour").alias("lo"), F.max("weather_hour").alias("hi")).where("lo IS NOT NULL")
    days = ends.select("*", F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 24 HOURS"))).alias("day")).repartition("day")
    listed = F.explode(F.sequence("day", F.col("day") + F.expr("INTERVAL 23 HOURS"), F.expr("INTERVAL 1 HOUR")))
    every = days.select(listed.alias("weather_hour"), "hi").where("weather_hour <= hi").select("weather_hour")
    return store(asof_join(every, hours, "weather_hour", "weather_hour", columns), "filled_weather")


def join_filled(df: DataFrame, filled: DataFrame) -> DataFrame:
    """Left join of ``filled_hours`` on ``weather_hour``; hours after the table's end take its last row, however late."""
    columns = [c for c in filled.columns if c != "weather_hour"]
    ending = F.max(F.struct("weather_hour", *columns)).alias("ending")
    last = store(filled.agg(ending), "last_weather")
    joined = df.join(filled, "weather_hour", "left").join(F.broadcast(last), F.lit(True), "left")
    late = F.col("weather_hour") > F.col("ending.weather_hour")
    known = {c: F.when(late, F.col(f"ending.{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(known).drop("ending")


def join_weather(
    df: DataFrame,
    weather: DataFrame | None,
    time: str = "ds",
    tz: str = "UTC",
    by: Sequence[str] = (SERIES,),
    back: bool = True,
    spread: Sequence[str] = ("idx",),
) -> DataFrame:
    """Left join on the nearest hour, gaps filled from earlier rows of the series.

    Weather depends on the hour alone and hours follow row order, so the fill runs
    over the distinct (series, hour) pairs: at most hours-covered rows per series,
    however many arrivals. ``back`` also fills rows before the first known value.
    """
    if weather is None:
        return df
    hours = weather_hours(weather, tz)
    columns = [c for c in hours.columns if c != "weather_hour"]
    keyed = df.withColumn("weather_hour", round_hour(time))
    pairs = keyed.select(*by, "weather_hour").distinct().join(hours, "weather_hour", "left")
    past = Window.partitionBy(*by).orderBy("weather_hour").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*by).orderBy(F.desc("weather_hour")).rowsBetween(Window.unboundedPreceding, 0)
    filled = pairs.withColumns({c: F.last(c, ignorenulls=True).over(past) for c in columns})
    if back:
        filled = filled.withColumns({c: F.last(c, ignorenulls=True).over(ahead) for c in columns})
    known = store(filled, "weather_by_series")
    return attach(keyed, known, [*by, "weather_hour"], spread).drop("weather_hour")


def join_monthly_static(
    df: DataFrame, monthly: DataFrame, time: str = "ds", spread: Sequence[str] = ("idx",)
) -> DataFrame:
    """Adds ``month_id`` (yyyy-MM) and the columns of the monthly table for it."""
    return attach(df.withColumn("month_id", month_key(time)), store(monthly, "monthly"), ["month_id"], spread)
