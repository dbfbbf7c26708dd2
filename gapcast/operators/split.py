"""Positional splits, sliding windows, rolling-origin rows and request shaping.

All take a numbered frame (``idx``, ``n``); see plans/layout.py.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcast.config import SERIES, Config
from gapcast.operators.permute import place_of, ranked
from gapcast.plans.layout import (
    BLOCK_ROWS,
    block_window,
    own_rows,
    shifted,
    with_blocks,
)


def _share(fraction: float) -> Column:
    """Rows in a share, cut to a whole number."""
    return F.floor(F.lit(float(fraction)) * F.col("n"))


def split(
    df: DataFrame, train: float = Config.train_share, val: float = Config.val_share
) -> DataFrame:
    """``split`` by position: the first share train, the next val, the rest test."""
    n_train, n_val = _share(train), _share(val)
    name = (
        F.when(F.col("idx") < n_train, "train").when(F.col("idx") < n_train + n_val, "val").otherwise("test")
    )
    return df.withColumn("split", name)


def window_split(
    end: Column, length: int, train: float = Config.train_share, val: float = Config.val_share
) -> Column:
    """The split that a window of ``length`` rows up to position ``end`` lies in, null where it is in none."""
    n_train, n_val = _share(train), _share(val)
    start = end - (length - 1)
    inside = (
        F.when((start >= 0) & (end < n_train), "train")
        .when((start >= n_train) & (end < n_train + n_val), "val")
        .when(start >= n_train + n_val, "test")
    )
    return F.when(end < F.col("n") - length, inside)


def make_windows(
    df: DataFrame,
    features: Sequence[str],
    target: str = "y",
    length: int = Config.lookback,
    stride: int = 1,
    train: float = Config.train_share,
    val: float = Config.val_share,
    splits: Sequence[str] = ("train", "val", "test"),
    by: Sequence[str] = (SERIES,),
    time: str = "ds",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sliding windows of ``length`` rows, each with the target of the row after it.

    A window lies inside one split; of the whole series the last ``length`` rows end
    no window. Columns: by, ``split``, ``start_idx``, ``target_idx``, ``target_ds``,
    ``target``, ``features`` (array of structs, oldest first). Arrays are built only
    for the splits asked for.
    """
    n_train, n_val = _share(train), _share(val)
    framed = with_blocks(df, length - 1, 1, max(block_rows, length))
    w = block_window(by)
    rows = F.collect_list(F.struct(*features)).over(w.rowsBetween(-(length - 1), 0))
    start = F.col("idx") - (length - 1)
    framed = framed.withColumn("split", window_split(F.col("idx"), length, train, val))
    first = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", n_train).otherwise(n_train + n_val)
    chosen = F.col("split").isin(*splits) & ((start - first) % stride == 0)
    if set(splits) != {"train", "val", "test"} or stride > 1:
        framed = framed.withColumn("features", F.when(chosen, rows))
    else:
        framed = framed.withColumn("features", rows)
    built = framed.withColumns(
        {"target": F.lead(target).over(w), "target_ds": F.lead(time).over(w), "start_idx": start}
    )
    return (
        own_rows(built.where(chosen))
        .withColumn("target_idx", F.col("idx") + 1)
        .select(*by, "split", "start_idx", "target_idx", "target_ds", "target", "features")
    )


def shuffle_batches(
    df: DataFrame,
    seed: int = 0,
    batch: int = Config.batch_size,
    key: Sequence[str] = (SERIES, "start_idx"),
    chunks: int | None = None,
) -> DataFrame:
    """Repeatable shuffle: ``place`` 0..N-1 over all rows, and ``batch`` = place / size.

    Rows stay where they are: their number in the order of ``key`` goes through a permutation
    fixed by ``seed`` (operators/permute.py), so the place depends on keys and seed alone.
    """
    numbered = ranked(df, key, chunks)
    placed = numbered.withColumn("place", place_of(F.col("rank"), F.col("_total"), seed)).drop("rank", "_total")
    return placed.withColumn("batch", F.floor(F.col("place") / batch))


def ordered_batches(
    df: DataFrame, batch: int = Config.batch_size, key: Sequence[str] = (SERIES, "start_idx")
) -> DataFrame:
    """Batches in series order, as validation and test use them."""
    placed = ranked(df, key).drop("_total").withColumnRenamed("rank", "place")
    return placed.withColumn("batch", F.floor(F.col("place") / batch))


def rolling_origin(
    df: DataFrame,
    test: float = Config.test_share,
    horizon: int = Config.horizon,
    step: int = 1,
    time: str = "ds",
    by: Sequence[str] = (SERIES,),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per (cutoff, step ahead) over the last share of each series.

    Adds ``cutoff`` (time of the last row a forecast may use), ``cutoff_idx`` and
    ``ahead`` (1..horizon). The first cutoff is the row before the test share; a
    cutoff counts only if all its steps lie in the series.
    """
    n_test = _share(test)
    lags = shifted(df, {f"_ds{k}": (time, k) for k in range(1, horizon + 1)}, by, block_rows)
    origins = F.array(
        *[
            F.struct(
                F.lit(k).alias("ahead"),
                (F.col("idx") - k).alias("cutoff_idx"),
                F.col(f"_ds{k}").alias("cutoff"),
            )
            for k in range(1, horizon + 1)
        ]
    )
    since = F.col("cutoff_idx") - (F.col("n") - n_test - 1)
    return (
        lags.where(F.col("idx") >= F.col("n") - n_test)
        .withColumn("_origin", F.explode(origins))
        .select(*df.columns, "_origin.*")
        .where(
            (F.col("cutoff_idx") >= 0)
            & (since >= 0)
            & (since % step == 0)
            & (F.col("cutoff_idx") + horizon <= F.col("n") - 1)
        )
    )


def history_future_split(df: DataFrame, horizon: int = Config.horizon) -> DataFrame:
    """``part``: the last ``horizon`` rows of each series are 'future', the rest 'history'."""
    late = F.col("idx") >= F.col("n") - horizon
    return df.withColumn("part", F.when(late, "future").otherwise("history"))


def pad_history(df: DataFrame, rows: int = Config.lookback) -> DataFrame:
    """Exactly ``rows`` rows per series, numbered ``step`` 0..rows-1.

    Long series keep their last rows; short ones repeat their earliest row in front,
    marked ``is_pad``.
    """
    missing = F.greatest(F.lit(rows) - F.col("n"), F.lit(0))
    last = df.where(F.col("idx") >= F.col("n") - rows)
    lead_in = F.when(F.col("idx") == 0, missing).otherwise(F.lit(0))
    step = F.col("idx") - F.col("n") + rows
    copies = F.transform(
        F.sequence(F.lit(0).cast("long"), lead_in),
        lambda k: F.struct((step - k).alias("step"), (k > 0).alias("is_pad")),
    )
    return last.withColumn("_copy", F.explode(copies)).select(*df.columns, "_copy.*")


def append_future_row(
    df: DataFrame,
    horizon: int = Config.horizon,
    freq: str = Config.frequency,
    time: str = "ds",
    keep: Sequence[str] = (SERIES,),
) -> DataFrame:
    """``horizon`` rows after the end of each series: next times, all values unknown.

    Weather and calendar columns are filled by running those steps on the result.
    """
    ends = df.where(F.col("idx") == F.col("n") - 1)
    ahead = ends.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    moved = {
        time: F.col(time) + F.col("_k") * F.expr(f"INTERVAL {freq}"),
        "idx": F.col("idx") + F.col("_k"),
    }
    kept = {*keep, time, "idx", "n"}
    future = ahead.withColumns(moved).select(
        *[F.col(c) if c in kept else F.lit(None).cast(t).alias(c) for c, t in df.dtypes]
    )
    return df.withColumn("is_future", F.lit(False)).unionByName(
        future.withColumn("is_future", F.lit(True))
    )


def align_future(
    history: DataFrame,
    future: DataFrame,
    freq: str = Config.frequency,
    time: str = "ds",
    by: Sequence[str] = (SERIES,),
    horizon: int = Config.horizon,
) -> DataFrame:
    """Future rows get the times the model expects: last history time + k steps.

    A series whose future has not exactly ``horizon`` rows keeps its own times, with
    ``aligned`` false. The future part is at most a few rows per series.
    """
    last = history.groupBy(*by).agg(F.max(time).alias("_last"))
    own = Window.partitionBy(*by)
    placed = future.withColumns(
        {
            "step": F.row_number().over(own.orderBy(time)),
            "aligned": F.count(F.lit(1)).over(own) == horizon,
        }
    )
    expected = F.col("_last") + F.col("step") * F.expr(f"INTERVAL {freq}")
    joined = placed.join(last, list(by), "left")
    fits = F.col("aligned") & F.col("_last").isNotNull()
    return joined.withColumns({time: F.when(fits, expected).otherwise(F.col(time)), "aligned": fits}).drop("_last")
