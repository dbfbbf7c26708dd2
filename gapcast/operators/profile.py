"""Distribution profiles: describe, heat map, histogram, density, counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.config import DAY_NAMES, SERIES
from gapcast.functions.clock import calendar_parts
from gapcast.functions.numbers import grid
from gapcast.operators.quantiles import quantile_columns
from gapcast.plans.layout import attach
from gapcast.plans.scratch import store

# Beyond this many bandwidths exp(-z*z/2) is zero in double precision; the half
# width of a cell and the number of moments, see ``_cell_polynomial``.
KERNEL_REACH = 38.7
CELL_HALF = 0.25
MOMENTS = 17


def describe(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (SERIES,)) -> DataFrame:
    """by, ``column``, count, mean, std, min, q25, q50, q75, max; exact quartiles."""
    unpivoted = df.unpivot(list(by), list(columns), "column", "_v")
    keys = [*by, "column"]
    moments = unpivoted.groupBy(*keys).agg(
        F.count("_v").alias("count"),
        F.avg("_v").alias("mean"),
        F.stddev_samp("_v").alias("std"),
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )
    quartiles = quantile_columns(unpivoted, "_v", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, keys)
    return moments.join(quartiles, keys, "left").select(
        *keys, "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def hourly_means(
    df: DataFrame, value: str = "y", time: str = "ds", tz: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Long form of the heat map: by, hour, day_name, mean."""
    parts = calendar_parts(time, tz)
    keyed = df.select(*by, parts["hour"].alias("hour"), parts["day_name"].alias("day_name"), value)
    return keyed.groupBy(*by, "hour", "day_name").agg(F.avg(value).alias("mean"))


def heatmap(
    df: DataFrame, value: str = "y", time: str = "ds", tz: str | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Mean by hour (rows) and day name (columns, Monday first).

    The at most 168 cells of a group are stored, so what follows does not run the plan again.
    """
    cells = store(hourly_means(df, value, time, tz, by), "heat_cells")
    return cells.groupBy(*by, "hour").pivot("day_name", list(DAY_NAMES)).agg(F.first("mean"))


def present_days(table: DataFrame) -> DataFrame:
    """A heat map without the days that never occur."""
    seen = table.agg(*[F.count(d).alias(d) for d in DAY_NAMES if d in table.columns]).first()
    return table.drop(*[d for d, n in seen.asDict().items() if n == 0])


def histogram(
    df: DataFrame,
    value: str,
    bins: int = 10,
    by: Sequence[str] = (SERIES,),
    density: bool = False,
    spread: Sequence[str] = ("idx",),
) -> DataFrame:
    """by, ``bin``, ``lower``, ``upper``, ``count`` (or ``density``); empty bins included.

    Equal bins over [min, max]; the last one is closed on the right. A constant
    column gets the range value +- 0.5.
    """
    known = df.where(F.col(value).isNotNull())
    ends = known.groupBy(*by).agg(
        F.min(value).alias("_min"), F.max(value).alias("_max"), F.count(value).alias("_n")
    )
    flat = F.col("_min") == F.col("_max")
    low = F.when(flat, F.col("_min") - 0.5).otherwise(F.col("_min"))
    high = F.when(flat, F.col("_max") + 0.5).otherwise(F.col("_max"))
    ranges = store(ends.select(*by, "_n", low.alias("_lo"), high.alias("_hi")), "ranges")
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    counted = (
        attach(known, ranges, by, spread, "inner").groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    )
    every = ranges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    filled = F.coalesce(F.col("count"), F.lit(0))
    shown = (filled / (F.col("_n") * width)).alias("density") if density else filled.alias("count")
    return every.join(counted, [*by, "bin"], "left").select(
        *by,
        "bin",
        (F.col("_lo") + F.col("bin") * width).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * width).alias("upper"),
        shown,
    )


def _hermite(order: int) -> list[list[int]]:
    """Coefficients by power of the Hermite polynomials below ``order``."""
    rows = [[1], [0, 2]]
    for n in range(1, order - 1):
        twice = [0, *[2 * c for c in rows[n]]]
        rows.append([c - 2 * n * d for c, d in zip(twice, [*rows[n - 1], 0, 0])])
    return rows[:order]


def _cell_polynomial(moments: Sequence[Column]) -> list[Column]:
    """Coefficients a_k so that the sum of exp(-(t - s)^2) over a cell is exp(-t^2) times sum a_k t^k.

    Moment n is the sum of s^n, with s and t the distances from the cell's centre over sqrt(2)
    bandwidths. The expansion in Hermite functions is cut after ``MOMENTS`` terms; with
    |s| <= ``CELL_HALF`` what is left out of a row is below 1.1 (sqrt(2) / 4)^17 / sqrt(17!)
    = 1.3e-15 times exp(-t^2 / 2), where the row itself has about exp(-t^2).
    """
    table = _hermite(len(moments))
    sums = []
    for k in range(len(moments)):
        total = F.lit(0.0)
        for n in range(k, len(moments)):
            if k < len(table[n]) and table[n][k]:
                total = total + moments[n] * F.lit(table[n][k] / math.factorial(n))
        sums.append(total)
    return sums


def kde(
    df: DataFrame,
    columns: Sequence[str],
    points: int = 200,
    pad: float = 0.1,
    by: Sequence[str] = (SERIES,),
    bins: int | None = None,
    spread: Sequence[str] = ("idx",),
) -> DataFrame:
    """Gaussian kernel densities of several columns on one padded grid per group.

    Scott's bandwidth n^(-1/5) * sample std. A fast Gauss transform: values are summed up to
    power moments of cells half a bandwidth wide or less, one partial aggregation; the grid is
    evaluated from the cells, so no row meets a grid point and only cells are shuffled. With
    ``bins``, ``curve`` scales the density to the counts of a histogram of that many bins.
    Columns: by, column, point, x, density[, curve].
    """
    if not by:
        raise ValueError("give a group key; a constant column stands for one group")
    keys = [*by, "column"]
    values = df.unpivot([*by, *spread], list(columns), "column", "_v").where(F.col("_v").isNotNull())
    facts = store(
        values.groupBy(*keys).agg(
            F.count("_v").alias("_n"),
            F.stddev_samp("_v").alias("_s"),
            F.min("_v").alias("_min"),
            F.max("_v").alias("_max"),
        ),
        "density_facts",
    )
    ends = facts.groupBy(*by).agg(F.min("_min").alias("_lo"), F.max("_max").alias("_hi"))
    margin = (F.col("_hi") - F.col("_lo")) * pad
    width = F.col("_n").cast("double") ** F.lit(-0.2) * F.col("_s")
    own_bin = (F.col("_max") - F.col("_min")) / (bins or 1)
    joined = facts.join(ends, list(by))
    params = store(
        joined.select(
            *keys,
            "_n",
            width.alias("_h"),
            (F.col("_lo") - margin).alias("_from"),
            (F.col("_hi") + margin).alias("_to"),
            (F.col("_n") * own_bin).alias("_scale"),
        ).where(F.col("_h") > 0),
        "density_params",
    )
    unit = F.col("_h") * math.sqrt(2)
    place = (F.col("_v") - F.col("_from")) / (unit * (2 * CELL_HALF))
    near = attach(values, params.select(*keys, "_h", "_from"), keys, spread, "inner").withColumn("_cell", F.floor(place))
    shift, sums, term = (place - F.col("_cell") - 0.5) * (2 * CELL_HALF), [], F.lit(1.0)
    for n in range(MOMENTS):
        sums.append(F.sum(term).alias(f"_m{n}"))
        term = term * F.col("_shift")
    cells = near.withColumn("_shift", shift).groupBy(*keys, "_cell").agg(*sums)
    shape = [c.alias(f"_a{k}") for k, c in enumerate(_cell_polynomial([F.col(f"_m{n}") for n in range(MOMENTS)]))]
    gap = (F.col("_to") - F.col("_from")) / (points - 1)
    centre = F.col("_from") + (F.col("_cell") + 0.5) * (unit * (2 * CELL_HALF))
    reach = (KERNEL_REACH + 1) * F.col("_h")
    first = F.greatest(F.ceil((centre - reach - F.col("_from")) / gap), F.lit(0))
    last = F.least(F.floor((centre + reach - F.col("_from")) / gap), F.lit(points - 1))
    around = cells.select(*keys, "_cell", *shape).join(params, keys).where(first <= last)
    terms = around.withColumn("point", F.explode(F.sequence(first, last)))
    terms = terms.withColumn("_t", (F.col("_from") + F.col("point") * gap - centre) / unit)
    value = F.lit(0.0)
    for k in reversed(range(MOMENTS)):
        value = value * F.col("_t") + F.col(f"_a{k}")
    sums = terms.groupBy(*keys, "point").agg(F.sum(F.exp(-F.col("_t") * F.col("_t")) * value).alias("_sum"))
    at = grid(F.col("_from"), F.col("_to"), points)
    every = params.select("*", F.posexplode(at).alias("point", "x")).withColumn("point", F.col("point").cast("long"))
    norm = F.col("_n") * F.col("_h") * F.sqrt(F.lit(2.0) * F.pi())
    density = F.greatest(F.coalesce(F.col("_sum"), F.lit(0.0)), F.lit(0.0)) / norm
    shown = [density.alias("density")] + ([(density * F.col("_scale")).alias("curve")] if bins else [])
    return every.join(sums, [*keys, "point"], "left").select(*keys, "point", "x", *shown)


def row_count(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"))


def frame_shape(df: DataFrame) -> DataFrame:
    """rows, columns."""
    return row_count(df).withColumn("columns", F.lit(len(df.columns)))
