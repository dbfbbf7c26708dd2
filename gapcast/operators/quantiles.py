"""Exact quantiles by selection: no sort of the rows, no group held in one task.

The wanted ranks of a group are narrowed down by counting. All rows of a group are its first gap.

1. The distinct values of a gap of at most ``limit`` rows are counted, and the ranks picked among
   them in one window.
2. A longer gap is sketched (``percentile_approx``, mergeable). The sketch only proposes pivots
   around the wanted levels; nothing rests on its accuracy. A second aggregation counts the rows
   below, at and between the pivots, exactly. A rank that falls on a pivot is found; hot values and
   ties end here. The others lie in gaps between pivots, about 2 in ``ACCURACY`` of the rows on
   either side of a level, which are treated alike, if need be with evenly spaced pivots.

Each pass is a partial aggregation, so what is shuffled is counts and not rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcast.config import QUANTILE_LEVELS, SERIES
from gapcast.plans.layout import attach, stored_bytes
from gapcast.plans.scratch import store

ACCURACY = 10_000
EVEN = 64
LIMIT = 1_000_000
SMALL_BYTES = 16 << 20


def _sketch(percentages: Sequence[float]) -> Column:
    """Pivots, ascending; NaN, which sorts last, is left to the counting."""
    number = F.when(~F.isnan(F.col("_v").cast("double")), F.col("_v"))
    return F.percentile_approx(number, sorted(set(percentages)), ACCURACY).alias("_p")


def _cell(pivots: int) -> Column:
    """2 i + 1 for a value equal to pivot i, 2 i for one between pivots i - 1 and i."""
    below, equal = F.lit(0), F.lit(False)
    for i in range(pivots):
        pivot = F.get("_p", F.lit(i))
        below = below + F.coalesce((pivot < F.col("_v")).cast("int"), F.lit(0))
        equal = equal | F.coalesce(pivot == F.col("_v"), F.lit(False))
    return 2 * below + equal.cast("int")


def _within(ranks: Column, start: Column, count: Column) -> Column:
    return F.filter(ranks, lambda r: (r >= start) & (r < start + count))


def _counted(rows: DataFrame, keys: Sequence[str], by: str, start: Column) -> DataFrame:
    """keys, ``by``, ``_count`` and ``_start``: rows of the group before it in the order of ``by``."""
    counts = rows.groupBy(*keys, by).agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", start + F.coalesce(F.sum("_count").over(earlier), F.lit(0)))


def _among_values(rows: DataFrame, keys: list[str], gaps: DataFrame) -> DataFrame:
    """keys, ``_rank``, ``_value``: the ranks of short gaps, picked among their distinct values."""
    values = _counted(rows, keys, "_v", F.lit(0)).join(gaps, keys)
    picked = _within(F.col("_ranks"), F.col("_start"), F.col("_count"))
    return values.select(*keys, F.explode(picked).alias("_rank"), F.col("_v").alias("_value"))


def _between_pivots(
    rows: DataFrame, keys: list[str], gaps: DataFrame, steps: Sequence[float], limit: int, longest: int
) -> DataFrame:
    """The same for long gaps, by counting the rows between pivots."""
    cell = f"_cell{len(keys)}"
    wanted = store(rows.groupBy(*keys).agg(_sketch(steps)).join(gaps, keys).select(*keys, "_ranks", "_p"), "quantile_pivots")
    placed = attach(rows, wanted, keys, ["_spread"], "inner").withColumn(cell, _cell(len(set(steps))))
    placed = placed.select(*keys, cell, "_v", "_spread")
    counts = _counted(placed, keys, cell, F.lit(0)).join(wanted, keys)
    counts = counts.withColumn("_hits", _within(F.col("_ranks"), F.col("_start"), F.col("_count")))
    hits = store(counts.where(F.size("_hits") > 0).drop("_ranks"), "quantile_cells")
    at_pivot = F.get("_p", F.shiftright(F.col(cell), 1))
    solved = hits.where(F.col(cell) % 2 == 1).select(*keys, F.explode("_hits").alias("_rank"), at_pivot.alias("_value"))
    inner, first = [*keys, cell], F.col("_start").alias("_first")
    own = F.transform("_hits", lambda r: r - F.col("_start")).alias("_ranks")
    open_gaps = store(hits.where(F.col(cell) % 2 == 0).select(*inner, first, F.col("_count").alias("_size"), own), "quantile_gaps")
    if open_gaps.isEmpty():
        return solved
    inside = attach(placed, open_gaps.select(*inner), inner, ["_spread"], "inner")
    even = [(k + 0.5) / EVEN for k in range(EVEN)]
    found = _select(inside, inner, open_gaps.drop("_first"), even, limit, longest).join(open_gaps.select(*inner, "_first"), inner)
    return solved.unionByName(found.select(*keys, (F.col("_rank") + F.col("_first")).alias("_rank"), "_value"))


def _select(
    rows: DataFrame, keys: list[str], gaps: DataFrame, steps: Sequence[float], limit: int, before: int | None = None
) -> DataFrame:
    """keys, ``_rank``, ``_value`` for the ranks of stored ``gaps``: keys, ``_ranks``, ``_size``.

    ``rows`` has the keys, ``_v`` and ``_spread``, and only rows of those gaps. No gap was longer
    than ``before`` a round earlier; where no pivot parted it (pivots are doubles, the values may be
    longer integers), it is gone through in a window all the same.
    """
    shortest, longest = gaps.agg(F.min("_size"), F.max("_size")).first()
    if longest is None or longest <= limit or longest == before:
        return _among_values(rows, keys, gaps)
    if shortest > limit:
        return _between_pivots(rows, keys, gaps, steps, limit, longest)
    short, long = (store(gaps.where(g), "quantile_gaps") for g in (F.col("_size") <= limit, F.col("_size") > limit))
    of = lambda part: attach(rows, part.select(*keys), keys, ["_spread"], "inner")
    return _among_values(of(short), keys, short).unionByName(_between_pivots(of(long), keys, long, steps, limit, longest))


def quantiles(
    df: DataFrame,
    value: Column | str,
    levels: Sequence[float] = QUANTILE_LEVELS,
    by: Sequence[str] = (SERIES,),
    exact: bool = True,
    limit: int = LIMIT,
) -> DataFrame:
    """by, ``level``, ``quantile`` (linear interpolation). Nulls are left out.

    ``exact=False`` uses the mergeable sketch, a different definition that returns an
    observed value. ``limit`` bounds the rows of a gap that one window goes through.
    """
    column = F.col(value) if isinstance(value, str) else value
    if not exact:
        known = df.select(*by, column.alias("_v")).where(F.col("_v").isNotNull())
        wanted = F.array(*[F.lit(float(p)) for p in levels])
        sketch = known.groupBy(*by).agg(F.percentile_approx("_v", [float(p) for p in levels]).alias("_q"))
        pairs = F.arrays_zip(wanted.alias("level"), F.col("_q").alias("quantile"))
        return sketch.select(*by, F.inline(pairs))
    keys = list(by) or ["_all"]
    # Only read where a group is too hot to be met by a broadcast.
    spread = F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and "variant" not in t])
    every = df if by else df.withColumn("_all", F.lit(1))
    known = every.select(*keys, column.alias("_v"), spread.alias("_spread")).where(F.col("_v").isNotNull())
    spot = lambda p: F.lit(float(p)) * (F.col("_size") - 1)
    ranks = F.array_distinct(F.array(*[end(spot(p)) for p in levels for end in (F.floor, F.ceil)]))
    if limit >= LIMIT and stored_bytes(df) <= SMALL_BYTES:
        # A small table: its groups are short gaps, and their sizes come with the window.
        counts = _counted(known, keys, "_v", F.lit(0))
        sized = counts.withColumn("_size", F.sum("_count").over(Window.partitionBy(*keys)))
        picked = _within(ranks, F.col("_start"), F.col("_count"))
        found = sized.select(*keys, "_size", F.explode(picked).alias("_rank"), F.col("_v").alias("_value"))
    else:
        around = [min(1.0, max(0.0, p + e)) for p in levels for e in (-2 / ACCURACY, 0.0, 2 / ACCURACY)]
        sizes = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
        groups = store(sizes.withColumn("_ranks", ranks), "quantile_groups")
        found = _select(known, keys, groups, around, limit).join(groups.select(*keys, "_size"), keys)
    # At most two rows for each level.
    pairs = F.map_from_entries(F.collect_list(F.struct("_rank", "_value"))).alias("_at")
    named = found.groupBy(*keys).agg(F.first("_size").alias("_size"), pairs)
    low, high = (lambda p: F.col("_at")[F.floor(spot(p))]), (lambda p: F.col("_at")[F.ceil(spot(p))])
    share = lambda p: spot(p) - F.floor(spot(p))
    # Infinite neighbours that are equal have no difference.
    between = lambda p: F.when(low(p) == high(p), low(p).cast("double")).otherwise(low(p) + share(p) * (high(p) - low(p)))
    each = [F.struct(F.lit(float(p)).alias("level"), between(p).alias("quantile")) for p in dict.fromkeys(levels)]
    return named.select(*by, F.inline(F.array(*each)))


def quantile_columns(
    df: DataFrame, value: Column | str, names: dict[str, float], by: Sequence[str] = (SERIES,), limit: int = LIMIT
) -> DataFrame:
    """The same, one row per group and one column per named level."""
    long = quantiles(df, value, list(names.values()), by, limit=limit)
    return long.groupBy(*by).agg(
        *[F.max(F.when(F.col("level") == float(p), F.col("quantile"))).alias(c) for c, p in names.items()]
    )
