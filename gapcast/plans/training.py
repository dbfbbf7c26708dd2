"""Train and evaluate: the batch run from feature table to metrics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.config import FUTURE_KNOWN, HISTORY_ONLY, SERIES, Config
from gapcast.operators.forecast import (
    boosted_trees,
    fit_seasonal_quantiles,
    huber_regression,
    lag_features,
    residual_band,
    score,
    seasonal_quantile_forecast,
)
from gapcast.operators.metrics import evaluate, metrics_document
from gapcast.operators.rolling import naive_forecast
from gapcast.operators.split import rolling_origin, split
from gapcast.plans.scratch import store

MODELS = ("naive", "seasonal", "huber")


@dataclass
class TrainingRun:
    forecasts: DataFrame
    scores: DataFrame
    metrics: DataFrame


def with_point_forecasts(
    table: DataFrame,
    cfg: Config = Config(),
    lags: int = 24,
    known: Sequence[str] = FUTURE_KNOWN,
    history: Sequence[str] = HISTORY_ONLY,
    trees: bool = False,
) -> DataFrame:
    """Adds one column per model, each fitted on training rows only.

    ``table`` is a feature table; rows without a full lag window drop out.
    """
    parts = split(naive_forecast(table, block_rows=cfg.block_rows), cfg.train_share, cfg.val_share)
    rows, names = lag_features(
        parts,
        lags,
        history=[c for c in history if c in table.columns],
        known=[c for c in known if c in table.columns],
        block_rows=cfg.block_rows,
    )
    rows = store(rows, "training_rows")
    train = rows.where(F.col("split") == "train")
    scored = score(rows, huber_regression(train, names), "huber")
    if trees:
        scored = score(scored, boosted_trees(train, names), "trees")
    seasonal = seasonal_quantile_forecast(scored, fit_seasonal_quantiles(train))
    named = seasonal.withColumnsRenamed({"yhat": "seasonal", "lo80": "seasonal_lo80", "hi80": "seasonal_hi80"})
    return named.drop(*[c for c in names if c not in table.columns])


def train_and_evaluate(table: DataFrame, cfg: Config = Config(), lags: int = 24) -> TrainingRun:
    """Forecasts over the last share of each series, scores and the metrics document."""
    forecasts = store(with_point_forecasts(table, cfg, lags), "forecasts")
    banded = residual_band(forecasts, forecasts.where(F.col("split") == "val"), "huber")
    cutoffs = rolling_origin(table.select(SERIES, "idx", "n", "ds"), cfg.test_share).select(
        SERIES, "idx", "cutoff"
    )
    tested = store(banded.join(cutoffs, [SERIES, "idx"]), "tested")
    scores = evaluate(tested, MODELS)
    return TrainingRun(tested, scores, metrics_document(scores))
