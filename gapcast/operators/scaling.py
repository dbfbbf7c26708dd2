"""Per-series feature scaling fitted on training rows only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.config import SERIES
from gapcast.functions.numbers import scale, unscale
from gapcast.operators.quantiles import quantile_columns
from gapcast.plans.layout import attach
from gapcast.plans.scratch import store


def _long(df: DataFrame, features: Sequence[str], by: Sequence[str], spread: Sequence[str]) -> DataFrame:
    return df.unpivot([*by, *spread], list(features), "feature", "_v")


def fit_scaler(
    df: DataFrame, features: Sequence[str], by: Sequence[str] = (SERIES,), train: str | None = "train"
) -> DataFrame:
    """by, ``feature``, ``mean``, ``std`` (population) over rows with ``split`` = train.

    A feature that never varies gets a null ``std``.
    """
    rows = df.where(F.col("split") == train) if train else df
    wide = rows.groupBy(*by).agg(
        *[F.struct(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std")).alias(c) for c in features]
    )
    return wide.unpivot(list(by), list(features), "feature", "_s").select(
        *by, "feature", "_s.mean", F.when(F.col("_s.std") != 0, F.col("_s.std")).alias("std")
    )


def fit_robust_scaler(
    df: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (SERIES,),
    train: str | None = "train",
    spread: Sequence[str] = ("idx",),
) -> DataFrame:
    """The same with ``mean`` = median and ``std`` = median absolute deviation."""
    rows = df.where(F.col("split") == train) if train else df
    keys = [*by, "feature"]
    values = _long(rows, features, by, spread)
    medians = store(quantile_columns(values, "_v", {"mean": 0.5}, keys), "medians")
    apart = attach(values, medians, keys, spread, "inner").withColumn("_d", F.abs(F.col("_v") - F.col("mean")))
    mads = quantile_columns(apart, "_d", {"std": 0.5}, keys)
    return medians.join(mads, keys).withColumn("std", F.when(F.col("std") != 0, F.col("std")))


def unscalable(scaler: DataFrame) -> DataFrame:
    """Features whose scaled value is null, as they never vary."""
    return scaler.where(F.col("std").isNull())


def _with_scaler(
    df: DataFrame, scaler: DataFrame, features: Sequence[str], by: Sequence[str], spread: Sequence[str]
) -> DataFrame:
    picks = [
        F.max(F.when(F.col("feature") == c, F.col(part))).alias(f"_{part}_{c}")
        for c in features
        for part in ("mean", "std")
    ]
    wide = store(scaler.groupBy(*by).agg(*picks), "scaler")
    return attach(df, wide, by, spread)


def apply_scaler(
    df: DataFrame,
    scaler: DataFrame,
    features: Sequence[str],
    by: Sequence[str] = (SERIES,),
    spread: Sequence[str] = ("idx",),
    inverse: bool = False,
) -> DataFrame:
    """Scaled features in place; ``inverse`` goes back to the original unit."""
    formula = unscale if inverse else scale
    scaled = {c: formula(F.col(c), F.col(f"_mean_{c}"), F.col(f"_std_{c}")) for c in features}
    joined = _with_scaler(df, scaler, features, by, spread).withColumns(scaled)
    return joined.drop(*[f"_{part}_{c}" for c in features for part in ("mean", "std")])


def inverse_scale(df: DataFrame, scaler: DataFrame, features: Sequence[str], **options) -> DataFrame:
    return apply_scaler(df, scaler, features, inverse=True, **options)
