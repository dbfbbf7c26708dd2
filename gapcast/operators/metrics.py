"""Forecast errors and metrics. Metrics are columns, so any number runs in one pass."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.config import SERIES, Config
from gapcast.functions.numbers import huber_loss, metric_text, pinball_loss, unscale
from gapcast.operators.split import window_split
from gapcast.plans.layout import BLOCK_ROWS, attach, shifted
from gapcast.plans.scratch import store

Metric = Callable[[Column, Column], Column]


def mae(y: Column, yhat: Column) -> Column:
    return F.avg(F.abs(y - yhat))


def rmse(y: Column, yhat: Column) -> Column:
    return F.sqrt(F.avg((y - yhat) * (y - yhat)))


def huber(delta: float = 1.0) -> Metric:
    return lambda y, yhat: F.avg(huber_loss(y - yhat, delta))


def pinball(level: float) -> Metric:
    return lambda y, yhat: F.avg(pinball_loss(y - yhat, level))


DEFAULT_METRICS: dict[str, Metric] = {"mae": mae, "rmse": rmse}


def residual_frame(
    df: DataFrame,
    actual: str = "y",
    predicted: str = "yhat",
    inverse: tuple[float, float] | None = None,
) -> DataFrame:
    """Adds Actual, Predicted, Error, Abs Error; ``inverse`` = (mean, std) unscales both first."""
    a, p = F.col(actual), F.col(predicted)
    if inverse:
        mean, std = (F.lit(float(v)) for v in inverse)
        a, p = unscale(a, mean, std), unscale(p, mean, std)
    return df.withColumns({"Actual": a, "Predicted": p}).withColumns(
        {
            "Error": F.col("Actual") - F.col("Predicted"),
            "Abs Error": F.abs(F.col("Actual") - F.col("Predicted")),
        }
    )


def evaluate(
    df: DataFrame,
    models: Sequence[str],
    metrics: dict[str, Metric] | None = None,
    actual: str = "y",
    by: Sequence[str] = (SERIES,),
    overall: str | None = "ALL",
) -> DataFrame:
    """by, ``model``, ``metric``, ``value``: each metric of each model in one pass.

    With ``overall``, rows over all series follow under that name. Rows where the
    actual or the forecast is missing do not count for that model.
    """
    metrics = metrics or DEFAULT_METRICS
    cells = {
        (model, name): F.when(F.col(actual).isNotNull(), F.col(model))
        for model in models
        for name in metrics
    }
    scores = [metrics[name](F.col(actual), col).alias(f"{model}|{name}") for (model, name), col in cells.items()]
    grouped = df.rollup(*by) if overall else df.groupBy(*by)
    level = [F.grouping_id().alias("_level")] if overall else []
    wide = grouped.agg(*scores, *level)
    if overall:
        # Keep the full grouping and the grand total, not the levels between.
        wide = wide.where(F.col("_level").isin(0, 2 ** len(by) - 1)).drop("_level")
        wide = wide.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(overall)) for c in by})
    parts = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(name).alias("metric"), F.col(f"{m}|{name}").alias("value"))
            for m, name in cells
        ]
    )
    return wide.select(*by, F.inline(parts))


def compare_models(
    df: DataFrame, models: Sequence[str], metrics: dict[str, Metric] | None = None, actual: str = "y"
) -> DataFrame:
    """One row per model, one column per metric, over all rows."""
    metrics = metrics or DEFAULT_METRICS
    long = df.unpivot([actual], list(models), "model", "_yhat").where(F.col(actual).isNotNull())
    return long.groupBy("model").agg(
        *[metric(F.col(actual), F.col("_yhat")).alias(name) for name, metric in metrics.items()]
    )


def coverage(
    df: DataFrame, low: str = "lo80", high: str = "hi80", actual: str = "y", by: Sequence[str] = (SERIES,)
) -> DataFrame:
    """by, ``rows``, ``coverage`` (share of actuals inside the band) and ``mean_width``."""
    inside = F.col(actual).between(F.col(low), F.col(high))
    known = df.where(inside.isNotNull())
    return known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(inside.cast("double")).alias("coverage"),
        F.avg(F.col(high) - F.col(low)).alias("mean_width"),
    )


def naive_mae(
    df: DataFrame,
    length: int,
    target: str = "y",
    train: float = Config.train_share,
    val: float = Config.val_share,
    by: Sequence[str] = (SERIES,),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """MAE of 'same as the row before', per split, over the targets that windows of ``length`` rows have.

    Takes a numbered frame: the last row of a window is a lag, so no window is built.
    """
    lagged = shifted(df, {"_last": (target, 1)}, by, block_rows)
    placed = lagged.withColumn("split", window_split(F.col("idx") - 1, length, train, val)).where("split IS NOT NULL")
    return placed.groupBy(*by, "split").agg(mae(F.col(target), F.col("_last")).alias("mae"))


def attach_target_dates(
    predictions: DataFrame, dates: DataFrame, time: str = "ds", by: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Adds ``target_ds`` to predictions by (series, target_idx); each key is one row."""
    times = dates.select(*by, F.col("idx").alias("target_idx"), F.col(time).alias("target_ds"))
    return predictions.drop("target_ds").join(times, [*by, "target_idx"])


def forecast_context(
    windows: DataFrame,
    scaler: DataFrame,
    predicted: str,
    feature: str = "y",
    samples: int = 3,
    split: str = "test",
    by: Sequence[str] = (SERIES,),
) -> DataFrame:
    """The first windows of a split: history in the original unit, truth, forecast, error.

    ``windows`` carries a ``predicted`` column; its features are scaled, its targets raw.
    """
    part = windows.where(F.col("split") == split)
    start = part.groupBy(*by).agg(F.min("start_idx").alias("_first"))
    few = attach(part, store(start, "first_windows"), by, ["start_idx"]).where(F.col("start_idx") < F.col("_first") + samples)
    one = scaler.where(F.col("feature") == feature).select(*by, F.col("mean").alias("_m"), F.col("std").alias("_s"))
    joined = few.join(one, list(by))
    history = F.transform("features", lambda r: r[feature] * F.col("_s") + F.col("_m"))
    return joined.select(
        *by,
        (F.col("start_idx") - F.col("_first")).alias("sample"),
        history.alias("history"),
        F.col("target").alias("true_value"),
        F.col(predicted).alias("prediction"),
        F.abs(F.col("target") - F.col(predicted)).alias("abs_error"),
    )


def metrics_document(scores: DataFrame, by: Sequence[str] = (SERIES, "model")) -> DataFrame:
    """by, ``metrics``: array of {name, numberValue, format}, sorted by name.

    ``scores`` is the long frame of ``evaluate``: a handful of metrics per group.
    """
    item = F.struct(
        F.col("metric").alias("name"), F.col("value").alias("numberValue"), F.lit("RAW").alias("format")
    )
    return scores.groupBy(*by).agg(F.sort_array(F.collect_list(item)).alias("metrics"))


def metrics_report(scores: DataFrame) -> DataFrame:
    """The scores with a four-decimal text."""
    return scores.withColumn("text", metric_text(F.col("value")))
