"""Lomb-Scargle power of unevenly sampled series, in cycles per day.

Generalised form with floating mean, standard normalisation (Zechmeister & Kuerster
2009). The rows are first reduced to power moments of short time cells, an ordinary
partial aggregation; trigonometric sums at any frequency follow from those, exact to
about 1e-13. There are some 300 cells per day for 24 cycles per day, however many rows.

A series is not one group: its cells are dealt to parts that sum at all frequencies, and the
parts' sums are added per block of frequencies. For a list of frequencies a part is a stretch
of cells. For the automatic grid it is the cells whose number leaves one remainder, so that
each part is a shorter transform and the whole work that of one (decimation in time).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcast.config import SERIES
from gapcast.functions.clock import days_between
from gapcast.functions.numbers import DAYS_PER_YEAR
from gapcast.plans.layout import attach
from gapcast.plans.scratch import store

# The frequency range of the automatic grid and its samples per peak.
MIN_FREQUENCY = 1 / 365.25
MAX_FREQUENCY = 24.0
SAMPLES_PER_PEAK = 5
# Moments 0..ORDER of a cell, and the largest phase (radians) from its centre: the
# first term left out is below 0.5**13 / 13! = 2e-14.
ORDER = 12
CELL_PHASE = 0.5
# Cells of a part, and frequencies of a block.
PART_CELLS = 1 << 14
BLOCK = 4096


def _centred(df: DataFrame, value: str, time: str, by: Sequence[str], spread: Sequence[str]) -> DataFrame:
    """by, ``_t`` (days since the first row), ``_y`` (less its mean), ``_span``."""
    known = df.select(*by, *spread, time, value).where(F.col(value).isNotNull() & F.col(time).isNotNull())
    facts = known.groupBy(*by).agg(
        F.min(time).alias("_t0"), F.avg(value).alias("_mean"), days_between(F.min(time), F.max(time)).alias("_span")
    )
    joined = attach(known, store(facts, "series_facts"), by, spread, "inner")
    return joined.select(
        *by, "_span", days_between("_t0", time).alias("_t"), (F.col(value) - F.col("_mean")).alias("_y")
    )


def power(c, s, yc, ys, cc, cs, yy, y):
    """Power from the means of cos, sin, y cos, y sin, cos^2, cos sin, y^2 and y."""
    var = yy - y * y
    pc, ps = yc - y * c, ys - y * s
    vc, vs, cov = cc - c * c, 1 - cc - s * s, cs - c * s
    return (vs * pc * pc + vc * ps * ps - 2 * cov * pc * ps) / (var * (vc * vs - cov * cov))


def _cell_moments(rows: DataFrame, by: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Power moments of each time cell of width ``_cell``, for offsets in half cells.

    One ordinary partial aggregation: by, ``cell``, m0.., y0.., ``yy`` and the columns
    to ``keep``, which are constant in a series.
    """
    placed = rows.withColumn("cell", F.floor(F.col("_t") / F.col("_cell")))
    offset = (F.col("_t") / F.col("_cell") - F.col("cell") - 0.5) * 2
    sums, term = [], F.lit(1.0)
    for p in range(ORDER + 1):
        sums += [F.sum(term).alias(f"m{p}"), F.sum(term * F.col("_y")).alias(f"y{p}")]
        term = term * F.col("_u")
    sums.append(F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    constant = [F.max(c).alias(c) for c in ("_cell", *keep)]
    return placed.withColumn("_u", offset).groupBy(*by, "cell").agg(*sums, *constant)


def _moments(group: pd.DataFrame, name: str) -> np.ndarray:
    return group[[f"{name}{p}" for p in range(ORDER + 1)]].to_numpy().T


def _listed_sums(moments: np.ndarray, places: np.ndarray, cell: float, frequencies: np.ndarray) -> np.ndarray:
    """Sum of m(t) exp(2 pi i f t) for each frequency, from cell moments."""
    total = np.empty(len(frequencies), complex)
    centres = (places + 0.5) * cell
    for at, f in enumerate(frequencies):
        half, factor, inner = 1j * np.pi * f * cell, 1.0 + 0j, 0
        for p in range(ORDER + 1):
            inner = inner + factor * moments[p]
            factor = factor * half / (p + 1)
        total[at] = inner @ np.exp(2j * np.pi * f * centres)
    return total


class _Part:
    """The cells ``rest``, ``rest`` + ``parts``, ... of a grid whose step times the cell is one over ``size``."""

    def __init__(self, moments: np.ndarray, places: np.ndarray, cell: float, size: int, parts: int, rest: int):
        self.cell, self.size, self.parts, self.rest = cell, size, parts, rest
        self.places = places
        self.table = np.zeros((ORDER + 1, int(places.max() // parts) + 1))
        self.table[:, places // parts] = moments
        self.wave: dict[float, np.ndarray] = {}

    def _transformed(self, first: float) -> np.ndarray:
        if first not in self.wave:
            cells = self.rest + self.parts * np.arange(self.table.shape[1])
            turn = np.exp(2j * np.pi * first * cells * self.cell)
            length = self.size // self.parts
            self.wave[first] = np.fft.ifft(self.table * turn, length, axis=1) * length
        return self.wave[first]

    def sums(self, first: float, step: float, numbers: np.ndarray, stride: int = 1) -> np.ndarray:
        """Sum of m(t) exp(2 pi i f t) at f = stride * (first + k step) for the numbers k."""
        wave = self._transformed(first * stride)
        k = numbers * stride
        half = 1j * np.pi * stride * (first + step * numbers) * self.cell
        total, factor = np.zeros(len(k), complex), np.ones(len(k), complex)
        for p in range(ORDER + 1):
            total += factor * wave[p, k % wave.shape[1]]
            factor = factor * half / (p + 1)
        return total * np.exp(half + 2j * np.pi * k * self.rest / self.size)


def _sent(group: pd.DataFrame, by: Sequence[str], block: int, sums: Sequence[np.ndarray], span: float = 0.0) -> pd.DataFrame:
    """A part's share of one block of frequencies: its sums at f, at 2f and of the signal at f."""
    flat = np.concatenate([x for z in sums for x in (z.real, z.imag)])
    row = {k: group[k].iloc[0] for k in by}
    row |= {"block": block, "span": span, "n": group["m0"].sum(), "y0": group["y0"].sum(), "yy": group["yy"].sum(), "sums": flat}
    return pd.DataFrame([row])


def _finished(parts: DataFrame, by: Sequence[str], result: str, frequencies: Callable[[int, int, float], np.ndarray]) -> DataFrame:
    """Power per series and block from the shares of all parts; ``frequencies`` gives those of a block."""
    keys = list(by)

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        n = group["n"].sum()
        total = np.sum(np.stack(group["sums"].tolist()), axis=0).reshape(6, -1) / n
        c, s, c2, s2, yc, ys = total
        values = power(c, s, yc, ys, (1 + c2) / 2, s2 / 2, group["yy"].sum() / n, group["y0"].sum() / n)
        at = frequencies(int(group["block"].iloc[0]), len(c), float(group["span"].iloc[0]))
        return pd.DataFrame({**{k: group[k].iloc[0] for k in keys}, "frequency": at, "power": values})

    return parts.groupBy(*keys, "block").applyInPandas(finish, result)


def _types(df: DataFrame, by: Sequence[str]) -> tuple[str, str]:
    """Of the shares of a part and of the result."""
    types = dict(df.dtypes)
    keys = [f"`{k}` {types[k]}" for k in by]
    share = "block bigint, span double, n double, y0 double, yy double, sums array<double>"
    return ", ".join([*keys, share]), ", ".join([*keys, "frequency double", "power double"])


def periodogram(
    df: DataFrame,
    frequencies: Sequence[float] | tuple[float, float, int],
    value: str = "y",
    time: str = "ds",
    by: Sequence[str] = (SERIES,),
    spread: Sequence[str] = ("idx",),
    part_cells: int = PART_CELLS,
) -> DataFrame:
    """by, ``frequency``, ``power`` at the given frequencies.

    A list gives the frequencies; a tuple (first, step, count) a regular grid.
    """
    if isinstance(frequencies, tuple):
        first, step, count = frequencies
        wanted = first + np.arange(count) * step
    else:
        wanted = np.array(frequencies, float)
    cell = CELL_PHASE / (2 * math.pi * float(np.abs(wanted).max()))
    rows = _centred(df, value, time, by, spread).withColumn("_cell", F.lit(cell))
    keys = list(by)

    def share(group: pd.DataFrame) -> pd.DataFrame:
        places, m, y = group["cell"].to_numpy(), _moments(group, "m"), _moments(group, "y")
        out = []
        for at in range(0, len(wanted), BLOCK):
            f = wanted[at : at + BLOCK]
            sums = [_listed_sums(x, places, cell, w) for x, w in ((m, f), (m, 2 * f), (y, f))]
            out.append(_sent(group, keys, at // BLOCK, sums))
        return pd.concat(out)

    sent, result = _types(df, keys)
    cells = _cell_moments(rows, by, ()).withColumn("_part", F.floor(F.col("cell") / part_cells))
    parts = cells.groupBy(*keys, "_part").applyInPandas(share, sent)
    return _finished(parts, keys, result, lambda block, count, span: wanted[block * BLOCK : block * BLOCK + count])


def _fast_size(least: Column) -> Column:
    """The next whole number of the form 4, 5 or 6 times a power of two: fast to transform."""
    base = F.pow(F.lit(2.0), F.floor(F.log2(least)) - 2)
    sizes = [base * k for k in (4, 5, 6)]
    pick = F.when(least <= sizes[0], sizes[0]).when(least <= sizes[1], sizes[1]).when(least <= sizes[2], sizes[2])
    return F.greatest(pick.otherwise(base * 8), F.lit(8.0))


def autopower(
    df: DataFrame,
    min_frequency: float = MIN_FREQUENCY,
    max_frequency: float = MAX_FREQUENCY,
    samples_per_peak: int = SAMPLES_PER_PEAK,
    value: str = "y",
    time: str = "ds",
    by: Sequence[str] = (SERIES,),
    spread: Sequence[str] = ("idx",),
    part_cells: int = PART_CELLS,
) -> DataFrame:
    """by, ``frequency``, ``power`` on the automatic grid of each series.

    Step 1 / (samples_per_peak * time span).
    """
    rows = _centred(df, value, time, by, spread).where(F.col("_span") > 0)
    widest = CELL_PHASE / (2 * math.pi * max_frequency)
    # The grid step times the cell must be one over a whole number, the transform size.
    rows = rows.withColumn("_size", _fast_size(F.lit(samples_per_peak / widest) * F.col("_span")))
    rows = rows.withColumn("_cell", F.col("_span") * samples_per_peak / F.col("_size"))
    keys = list(by)

    def share(group: pd.DataFrame) -> pd.DataFrame:
        size, cell, span = int(group["_size"].iloc[0]), float(group["_cell"].iloc[0]), float(group["_span"].iloc[0])
        step = 1 / (samples_per_peak * span)
        count = 1 + int(round((max_frequency - min_frequency) / step))
        layout = group["cell"].to_numpy(), cell, size, int(group["_parts"].iloc[0]), int(group["_part"].iloc[0])
        m, y = (_Part(_moments(group, name), *layout) for name in "my")
        out = []
        for at in range(0, count, BLOCK):
            k = np.arange(at, min(count, at + BLOCK))
            sums = m.sums(min_frequency, step, k), m.sums(min_frequency, step, k, 2), y.sums(min_frequency, step, k)
            out.append(_sent(group, keys, at // BLOCK, sums, span))
        return pd.concat(out)

    def grid(block: int, count: int, span: float) -> np.ndarray:
        return min_frequency + (1 / (samples_per_peak * span)) * np.arange(block * BLOCK, block * BLOCK + count)

    sent, result = _types(df, keys)
    # A power of two, which the transform size is a multiple of.
    number = F.pow(F.lit(2.0), F.greatest(F.floor(F.log2(F.col("_size") / max(part_cells, 8))), F.lit(0))).cast("long")
    cells = _cell_moments(rows, by, ("_span", "_size")).withColumn("_parts", number)
    parts = cells.withColumn("_part", F.pmod(F.col("cell"), F.col("_parts"))).groupBy(*keys, "_part").applyInPandas(share, sent)
    return _finished(parts, keys, result, grid)


def peaks(spectrum: DataFrame, top: int = 3, by: Sequence[str] = (SERIES,)) -> DataFrame:
    """The strongest local maxima, with the frequency also per year and the period in days."""
    line = Window.partitionBy(*by).orderBy("frequency")
    higher = lambda k: F.col("power") > F.coalesce(F.lag("power", k).over(line), F.lit(float("-inf")))
    local = spectrum.withColumn("_peak", higher(1) & higher(-1)).where("_peak").drop("_peak")
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("power"), "frequency"))
    return local.withColumn("rank", rank).where(F.col("rank") <= top).withColumns(
        {"per_year": F.col("frequency") * DAYS_PER_YEAR, "period_days": 1 / F.col("frequency")}
    )
