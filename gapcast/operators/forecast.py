"""Forecast models: seasonal quantiles, Huber regression, bands, selection, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.config import FORECAST_LEVELS, SERIES
from gapcast.functions.clock import weekend_flag
from gapcast.operators.metrics import Metric, mae
from gapcast.operators.quantiles import quantile_columns
from gapcast.plans.layout import BLOCK_ROWS, attach, shifted
from gapcast.plans.scratch import store

BAND = dict(zip(("lo80", "yhat", "hi80"), FORECAST_LEVELS))


def fit_seasonal_quantiles(
    train: DataFrame, target: str = "y", time: str = "ds", by: Sequence[str] = (SERIES,)
) -> tuple[DataFrame, DataFrame]:
    """Quantiles by (series, weekend, hour), and by series for cells never seen."""
    cells = train.select(
        *by, F.col(target), weekend_flag(time).alias("_weekend"), F.hour(time).alias("_hour")
    )
    seasonal = quantile_columns(cells, target, BAND, [*by, "_weekend", "_hour"])
    general = quantile_columns(cells, target, {f"_{c}": p for c, p in BAND.items()}, by)
    return store(seasonal, "seasonal"), store(general, "general")


def seasonal_quantile_forecast(
    df: DataFrame,
    model: tuple[DataFrame, DataFrame],
    time: str = "ds",
    by: Sequence[str] = (SERIES,),
    spread: Sequence[str] = ("idx",),
) -> DataFrame:
    """Adds ``lo80``, ``yhat``, ``hi80`` from calendar facts known in advance."""
    seasonal, general = model
    keyed = df.withColumns({"_weekend": weekend_flag(time), "_hour": F.hour(time)})
    joined = attach(keyed, seasonal, [*by, "_weekend", "_hour"], spread)
    joined = attach(joined, general, by, spread)
    filled = {c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in BAND}
    return joined.withColumns(filled).drop("_weekend", "_hour", *[f"_{c}" for c in BAND])


def lag_features(
    df: DataFrame,
    lags: int,
    target: str = "y",
    history: Sequence[str] = (),
    known: Sequence[str] = (),
    by: Sequence[str] = (SERIES,),
    block_rows: int = BLOCK_ROWS,
) -> tuple[DataFrame, list[str]]:
    """The last ``lags`` targets, history-only columns of the row before, known columns.

    Nothing at or after the row itself enters, but for columns known in advance. Rows
    without a full window are dropped. Returns the frame and its feature names.
    """
    wanted = {f"lag_{k}": (target, k) for k in range(1, lags + 1)}
    wanted.update({f"last_{c}": (c, 1) for c in history})
    names = [*wanted, *known]
    return shifted(df, wanted, by, block_rows).where(F.col("idx") >= lags).dropna(subset=names), names


@dataclass(frozen=True)
class LinearModel:
    """A fitted linear forecast; ``column`` is it as an expression, evaluated inside Spark's generated code."""

    features: tuple[str, ...]
    coefficients: tuple[float, ...]
    intercept: float

    def column(self) -> Column:
        total = F.lit(self.intercept)
        for name, weight in zip(self.features, self.coefficients):
            total = total + F.col(name) * weight
        return total


def _normal_equations(rows: DataFrame, middle: np.ndarray, scale: np.ndarray, weights: np.ndarray | None, delta: float) -> np.ndarray:
    """Sums of w u u' over all rows, for u = (1, scaled features, target).

    Each task adds up its own rows and sends on one matrix. A row's weight is 1 as long as its error
    under ``weights`` is at most ``delta``, and falls as delta / error beyond.
    """
    width = len(middle) + 2

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            u = np.column_stack([np.ones(len(table)), (table[:, :-1] - middle) / scale, table[:, -1]])
            if weights is not None:
                error = np.abs(u[:, -1] - u[:, :-1] @ weights)
                total += (u / np.maximum(1.0, error / delta)[:, None]).T @ u
            else:
                total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["sums"])

    partial = rows.mapInArrow(add_up, "sums array<double>").select(F.posexplode("sums").alias("at", "sum"))
    total = np.zeros(width * width)
    for at, value in partial.groupBy("at").agg(F.sum("sum").alias("sum")).collect():
        total[at] = value
    return total.reshape(width, width)


def huber_regression(
    train: DataFrame,
    features: Sequence[str],
    target: str = "y",
    delta: float = 1.0,
    rounds: int = 10,
    ridge: float = 1e-3,
) -> LinearModel:
    """Linear point forecast with Huber loss over all series at once, by reweighted least squares.

    Every round is one pass: the weighted normal equations of (features + 2)^2 sums are added up in
    the tasks and solved on the driver. Features are scaled to unit deviation; ``ridge`` times the
    sum of weights is added to their diagonal, as lags and the rolling means of them depend on each
    other. A feature that never varies gets no weight. The number of rounds is fixed, so the
    result does not hang on a tolerance. Rows with a null in any of the columns are left out.
    """
    if train.isEmpty():
        raise ValueError("no training rows: no series is longer than its lags and widest window")
    names = list(features)
    rows = train.select(*[F.col(c).cast("double").alias(c) for c in names], F.col(target).cast("double").alias("_target"))
    rows = rows.dropna()
    facts = rows.agg(*[F.avg(c).alias(f"m_{c}") for c in names], *[F.stddev_pop(c).alias(f"s_{c}") for c in names]).first()
    middle = np.array([facts[f"m_{c}"] for c in names], float)
    spread = np.array([facts[f"s_{c}"] for c in names], float)
    scale = np.where(spread > 0, spread, 1.0)
    weights = None
    for _ in range(rounds):
        sums = _normal_equations(rows, middle, scale, weights, delta)
        left = sums[:-1, :-1] + np.diag([0.0] + [ridge * sums[0, 0]] * len(names))
        weights = np.linalg.solve(left, sums[:-1, -1])
    coefficients = weights[1:] / scale
    return LinearModel(tuple(names), tuple(coefficients.tolist()), float(weights[0] - coefficients @ middle))


def boosted_trees(train: DataFrame, features: Sequence[str], target: str = "y", **params) -> PipelineModel:
    """The non-linear candidate."""
    assembler = VectorAssembler(inputCols=list(features), outputCol="_x")
    learner = GBTRegressor(lossType="absolute", **params)
    learner.setParams(featuresCol="_x", labelCol=target, predictionCol="yhat")
    if train.isEmpty():
        raise ValueError("no training rows: no series is longer than its lags and widest window")
    rows = assembler.transform(train.select(*features, target)).select("_x", target)
    return PipelineModel([assembler, learner.fit(rows)])


def score(
    df: DataFrame,
    model: LinearModel | Transformer | Callable[[], Callable[[pd.DataFrame], pd.Series]] | None,
    output: str = "yhat",
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Forecasts by a linear or a fitted Spark model, or by any model a worker can load.

    A callable is run once per Python worker task and must return a function from a
    batch of feature columns to a series of forecasts.
    """
    if model is None:
        raise ValueError("model not initialised: fit or load one first")
    if isinstance(model, LinearModel):
        return df.withColumn(output, model.column())
    if isinstance(model, Transformer):
        scored = model.transform(df).drop("_x")
        return scored if output == "yhat" else scored.withColumnRenamed("yhat", output)
    names = list(features or df.columns)

    @F.pandas_udf("double")
    def predict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        run = model()
        for batch in batches:
            yield run(batch)

    return df.withColumn(output, predict(F.struct(*names)))


def residual_band(
    scored: DataFrame,
    validation: DataFrame,
    predicted: str = "yhat",
    target: str = "y",
    levels: tuple[float, float] = (FORECAST_LEVELS[0], FORECAST_LEVELS[-1]),
    by: Sequence[str] = (SERIES,),
    spread: Sequence[str] = ("idx",),
) -> DataFrame:
    """Adds ``lo80`` and ``hi80``: the forecast plus quantiles of validation residuals."""
    gaps = quantile_columns(
        validation, F.col(target) - F.col(predicted), {"_lo": levels[0], "_hi": levels[1]}, by
    )
    joined = attach(scored, store(gaps, "residual_quantiles"), by, spread)
    band = {"lo80": F.col(predicted) + F.col("_lo"), "hi80": F.col(predicted) + F.col("_hi")}
    return joined.withColumns(band).drop("_lo", "_hi")


def best_by_validation(
    df: DataFrame,
    models: Sequence[str],
    metric: Metric = mae,
    target: str = "y",
    by: Sequence[str] = (SERIES,),
    split: str = "val",
) -> DataFrame:
    """by, ``best`` and ``loss``: the forecast column with the least validation loss."""
    rows = df.where(F.col("split") == split)
    losses = rows.groupBy(*by).agg(*[metric(F.col(target), F.col(m)).alias(m) for m in models])
    ranked = F.array_sort(
        F.filter(
            F.array(*[F.struct(F.col(m).alias("loss"), F.lit(m).alias("best")) for m in models]),
            lambda s: s["loss"].isNotNull(),
        )
    )
    return losses.withColumn("_first", F.get(ranked, F.lit(0))).select(*by, "_first.best", "_first.loss")


def chosen_forecast(df: DataFrame, best: DataFrame, models: Sequence[str], by: Sequence[str] = (SERIES,)) -> DataFrame:
    """``yhat`` of each series' best model."""
    picked: Column = F.lit(None).cast("double")
    for m in models:
        picked = F.when(F.col("best") == m, F.col(m)).otherwise(picked)
    return attach(df, store(best.select(*by, "best"), "best"), by, ["idx"]).withColumn("yhat", picked)
