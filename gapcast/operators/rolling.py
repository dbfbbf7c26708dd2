"""Statistics over the last w rows, naive forecasts and headways."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapcast.config import ROLLING_FEATURES, SERIES, Config
from gapcast.functions.clock import minutes_between
from gapcast.operators.fill import backward_fill
from gapcast.plans.layout import (
    BLOCK_ROWS,
    block_window,
    carry_in,
    chunk_window,
    lay_out,
    own_rows,
    renumber,
    shifted,
    with_blocks,
)

_STATISTICS = {"mean": F.avg, "std": F.stddev_samp, "max": F.max, "min": F.min, "sum": F.sum}


# From this width on a mean or deviation is put together from shorter windows.
COMPOSED_FROM = 20


def _base_width(width: int) -> int:
    """The divisor of ``width`` for which base rows plus lags are fewest."""
    return min((d for d in range(1, width + 1) if width % d == 0), key=lambda d: (d + width // d, -d))


def _composed(features: Sequence[tuple[str, str, int]]) -> dict[int, int]:
    """Width -> base width, where composing is cheaper than the plain frame."""
    widths = {w for _, fn, w in features if fn in ("mean", "std") and w >= COMPOSED_FROM}
    return {w: _base_width(w) for w in widths if 1 < _base_width(w) < w}


def _with_statistics(
    framed: DataFrame, column: str, features: Sequence[tuple[str, str, int]], by: Sequence[str], dense: bool
) -> DataFrame:
    """The features, null unless the window is full.

    A frame of w rows costs w steps per row. The mean and the squared deviations of a
    wide window follow from those of the windows of b rows ending 0, b, 2b, ... rows
    before, so it costs b steps and w/b lags; sums of squares are never differenced.
    """
    line = block_window(by)
    base = _composed(features)
    over = lambda fn, w: fn(column).over(line.rowsBetween(-(w - 1), 0))
    # Without nulls the position alone tells whether a window is full.
    full = lambda w: F.col("idx") >= w - 1 if dense else over(F.count, w) == w
    short = {}
    for b in set(base.values()):
        short[f"_mean_{b}"] = F.when(full(b), over(F.avg, b))
        short[f"_dev_{b}"] = F.when(full(b), over(F.var_samp, b) * (b - 1))
    plain = {
        name: F.when(full(w), over(_STATISTICS[fn], w))
        for name, fn, w in features
        if not (fn in ("mean", "std") and (w in base or w in base.values()))
    }
    framed = framed.withColumns({**short, **plain})
    lags = {
        f"_{part}_{b}_{k}": F.lag(f"_{part}_{b}", k * b).over(line)
        for w, b in base.items()
        for part in ("mean", "dev")
        for k in range(1, w // b)
    }
    framed = framed.withColumns(lags) if lags else framed
    wide = {}
    for name, fn, w in features:
        if fn not in ("mean", "std") or (w not in base and w not in base.values()):
            continue
        b = base.get(w, w)
        means = [F.col(f"_mean_{b}")] + [F.col(f"_mean_{b}_{k}") for k in range(1, w // b)]
        mean = reduce(add, means) / len(means)
        if fn == "mean":
            wide[name] = mean
        else:
            inner = reduce(add, [F.col(f"_dev_{b}")] + [F.col(f"_dev_{b}_{k}") for k in range(1, w // b)])
            between = reduce(add, [(m - mean) * (m - mean) for m in means]) * b
            wide[name] = F.sqrt((inner + between) / (w - 1))
    return framed.withColumns(wide).drop(*short, *lags) if wide else framed


def rolling(
    df: DataFrame,
    column: str = "y",
    features: Sequence[tuple[str, str, int]] = ROLLING_FEATURES,
    by: Sequence[str] = (SERIES,),
    fill: bool = True,
    dense: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Trailing statistics of full windows, nulls before the first one back-filled.

    ``features`` lists (name, mean|std|max|min|sum, width). All of them share one
    exchange and one sort. ``dense`` says the column has no nulls; then the nulls are
    exactly the first width-1 rows and the value at row width-1 fills them inside
    block 0. Otherwise the fill looks for the next value over the whole series.
    """
    widest = max(width for _, _, width in features)
    framed = with_blocks(df, before=widest - 1, block_rows=max(block_rows, widest))
    framed = _with_statistics(framed, column, features, by, dense)
    if fill and dense:
        whole = Window.partitionBy(*by, "block")
        filled = {}
        for name, _, width in features:
            first = F.max(F.when(F.col("idx") == width - 1, F.col(name))).over(whole)
            filled[name] = F.when(F.col("idx") < width - 1, first).otherwise(F.col(name))
        framed = framed.withColumns(filled)
    rows = own_rows(framed)
    return backward_fill(rows, [name for name, _, _ in features], by) if fill and not dense else rows


def rolling_plain(df: DataFrame, column: str = "y", width: int = 50, **options) -> DataFrame:
    """Trailing mean of full windows, without any fill."""
    return rolling(df, column, [(f"rolling_mean_{width}", "mean", width)], fill=False, **options)


def naive_forecast(df: DataFrame, column: str = "y", **options) -> DataFrame:
    """``naive``: the last observed value before the row."""
    return shifted(df, {"naive": (column, 1)}, **options)


def with_headway(
    laid_out: DataFrame, time: str = "ds", name: str = "mbt", by: Sequence[str] = (SERIES,)
) -> DataFrame:
    """Minutes since the preceding arrival of the series, for a frame from ``lay_out``."""
    carried = carry_in(laid_out, {"_before": F.col(time)}, by)
    before = F.coalesce(F.lag(time).over(chunk_window(by)), F.col("_before"))
    return carried.withColumn(name, minutes_between(before, F.col(time))).drop("_before")


def headways(
    arrivals: DataFrame,
    last_n: int | None = Config.history_steps,
    min_gap: float = Config.min_gap,
    order: Sequence[str] = ("ds",),
    by: Sequence[str] = (SERIES,),
    chunks: int | None = None,
) -> DataFrame:
    """Gaps ``y`` of at least ``min_gap`` minutes, the last ``last_n`` per series.

    A gap is taken to the arrival directly before, kept or not.
    """
    gaps = with_headway(lay_out(arrivals, order, by, chunks), order[0], "y", by)
    numbered = renumber(gaps.where(F.col("y") >= min_gap), by)
    return numbered if last_n is None else numbered.where(F.col("idx") >= F.col("n") - last_n)
