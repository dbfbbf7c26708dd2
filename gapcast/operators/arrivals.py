"""From ETA observations to arrivals, trips, live forecasts and stored predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcast.config import SERIES, Config
from gapcast.functions.clock import add_minutes, iso, minutes_between
from gapcast.functions.numbers import as_text, row_key
from gapcast.plans.layout import attach, carry_in, chunk_window, lay_out
from gapcast.plans.scratch import store


def arrived(eta: Column, last_eta: Column, jump: float = Config.eta_jump) -> Column:
    """True if the ETA rose by more than ``jump`` minutes; false without a last one."""
    return F.coalesce(eta > last_eta + F.lit(jump), F.lit(False))


def detect_arrivals(
    updates: DataFrame,
    order: Sequence[str] = ("ts",),
    eta: str = "eta",
    jump: float = Config.eta_jump,
    by: Sequence[str] = (SERIES,),
    chunks: int | None = None,
) -> DataFrame:
    """Adds ``arrival`` to each ETA observation."""
    laid = lay_out(updates, order, by, chunks, "updates")
    carried = carry_in(laid, {"_before": F.col(eta)}, by)
    # An observation without an ETA is not one: the nearest known ETA before counts.
    past = chunk_window(by).rowsBetween(Window.unboundedPreceding, -1)
    last = F.coalesce(F.last(eta, ignorenulls=True).over(past), F.col("_before"))
    return carried.withColumn("arrival", arrived(F.col(eta), last, jump)).drop("_before", "gid", "chunk")


def trip_durations(
    arrivals: DataFrame,
    trip: Sequence[str],
    stop: str,
    time: str,
    origin: str,
    target: str,
    limit_minutes: float = 120.0,
) -> DataFrame:
    """trip, ``origin_ts``, ``target_ts``, ``duration``: first times at the two stops.

    Kept if the target comes within ``limit_minutes`` after the origin. One partial
    aggregation; no pairs are formed.
    """
    firsts = (
        arrivals.where(F.col(stop).isin(origin, target))
        .groupBy(*trip)
        .agg(
            F.min(F.when(F.col(stop) == origin, F.col(time))).alias("origin_ts"),
            F.min(F.when(F.col(stop) == target, F.col(time))).alias("target_ts"),
        )
    )
    timed = firsts.withColumn("duration", minutes_between("origin_ts", "target_ts"))
    return timed.where(F.col("duration").between(0.0, limit_minutes))


def last_arrivals(arrivals: DataFrame, time: str = "ds", by: Sequence[str] = (SERIES,)) -> DataFrame:
    return arrivals.groupBy(*by).agg(F.max(time).alias("last_arrival"))


def eta_forecast(
    forecasts: DataFrame,
    arrivals: DataFrame,
    poll_time: Column,
    value: str = "yhat",
    time: str = "ds",
    by: Sequence[str] = (SERIES,),
    spread: Sequence[str] | None = None,
) -> DataFrame:
    """Adds the last arrival, the predicted one and ``minutes_remaining`` (may be negative)."""
    last = store(last_arrivals(arrivals, time, by), "last_arrivals")
    joined = attach(forecasts, last, by, spread or [value], "inner")
    return live_columns(joined, poll_time, value)


def live_columns(df: DataFrame, poll_time: Column, value: str = "yhat") -> DataFrame:
    """The forecast columns of ``eta_forecast`` for a frame that has ``last_arrival``."""
    named = df.withColumns({"poll_time": poll_time, "predicted_headway": F.col(value)})
    timed = named.withColumn("predicted_arrival", add_minutes("last_arrival", "predicted_headway"))
    return timed.withColumn("minutes_remaining", minutes_between("poll_time", "predicted_arrival"))


def prediction_cells(df: DataFrame, series: str = SERIES) -> DataFrame:
    """Row key (series#poll time) and text cells of each live forecast."""
    return df.select(
        row_key(F.col(series), iso("poll_time")).alias("row_key"),
        as_text(F.col("minutes_remaining")).alias("predicted_minutes_remaining"),
        iso("predicted_arrival").alias("predicted_arrival_time"),
        as_text(F.col("predicted_headway")).alias("predicted_headway"),
        iso("last_arrival").alias("last_arrival_time"),
        iso(F.current_timestamp()).alias("generated_at"),
    )


def latest_per_key(
    predictions: DataFrame, key: Sequence[str] = ("route_id", "stop_id", "timestamp_str"), version: str = "created_at"
) -> DataFrame:
    """The newest stored document per key; the map side keeps one row per key."""
    rest = [c for c in predictions.columns if c not in key]
    newest = predictions.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(version, *rest)).alias("_doc"))
    return newest.select(*key, "_doc.*").select(*predictions.columns)


def staleness(updates: DataFrame, poll_time: Column, time: str = "ts", by: Sequence[str] = (SERIES,)) -> DataFrame:
    """by, ``last_seen``, ``minutes_stale``."""
    seen = updates.groupBy(*by).agg(F.max(time).alias("last_seen"))
    return seen.withColumn("minutes_stale", minutes_between(F.col("last_seen"), poll_time))
