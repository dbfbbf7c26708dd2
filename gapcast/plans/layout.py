"""Order without a hot task.

One series may hold a third of all rows, so no operator here puts a whole series
into one window group. Instead:

1. ``lay_out`` range-partitions the rows by (series, time, tie) and stores them.
   Range bounds are sampled, so a long series, a busy hour and even a pile of
   identical rows are spread over as many partitions as their size asks for. Each
   stored row carries ``gid`` = (partition << 33) + row in partition, a total order.
2. ``number`` turns that into the 0-based position ``idx`` in the series, and the
   series length ``n``, by adding up row counts per (series, ``chunk``), where
   ``chunk`` is the range partition. The summary has at most
   (range partitions + series) rows.
3. ``with_blocks`` cuts a numbered series into blocks of equal length and copies
   the few border rows a frame needs into the neighbouring block. Windows then run
   per (series, block): equal groups, whatever the skew.

Operators that need only "the last known value so far" use ``carry_in`` over chunks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from gapcast.config import SERIES, Config
from gapcast.plans.scratch import store

BLOCK_ROWS = Config.block_rows
CHUNK_BYTES = 128 << 20
HOT_ROWS = 1_000_000
UNKNOWN_BYTES = 1 << 62


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate; for a stored table, its file size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def stored_bytes(df: DataFrame) -> int:
    """The bytes of the tables a plan reads.

    Catalyst's estimate for a plan multiplies the sides of a join; the scans below it
    have the sizes of their files. Rows that come from no table have no known size.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(n for n in sizes if n < UNKNOWN_BYTES)


def chunk_count(size: int, default: int) -> int | None:
    """Range partitions for so many bytes; None leaves a small input to the session and AQE."""
    wanted = math.ceil(size / CHUNK_BYTES)
    return wanted if wanted > default else None


def _chunk_count(df: DataFrame) -> int | None:
    return chunk_count(stored_bytes(df), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lay_out(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (SERIES,),
    chunks: int | None = None,
    name: str = "layout",
) -> DataFrame:
    """Store ``df`` sorted by (by, order), with ``gid`` and ``chunk`` columns.

    Rows equal in all keys are told apart by their place in the input scan, so that
    copies can be split over partitions too. A null key is an error, as the joins
    further on would lose its rows. The input should be a scan or a
    deterministic plan over one, as every re-run of a lost task must see it alike.
    """
    keys = [*by, *order, "_copy"]
    named = {k: F.coalesce(F.col(k), F.raise_error(F.lit(f"null in key column {k}"))) for k in by}
    salted = df.withColumns({**named, "_copy": F.monotonically_increasing_id()})
    count = chunks or _chunk_count(df)
    ranged = salted.repartitionByRange(count, *keys) if count else salted.repartitionByRange(*keys)
    ordered = ranged.sortWithinPartitions(*keys).drop("_copy")
    stored = store(ordered.withColumn("gid", F.monotonically_increasing_id()), name)
    return stored.withColumn("chunk", F.shiftright("gid", 33))


def _offsets(df: DataFrame, by: Sequence[str]) -> DataFrame:
    counts = df.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("_rows"), F.min("gid").alias("_first"))
    series = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    earlier = series.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = counts.select(
        *by,
        "chunk",
        "_first",
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_offset"),
        F.sum("_rows").over(series).alias("n"),
    )
    return store(summary, "offsets")


def number(laid_out: DataFrame, by: Sequence[str] = (SERIES,)) -> DataFrame:
    """Add ``idx`` and ``n`` to a frame as ``lay_out`` returned it (no row dropped)."""
    at = F.col("_offset") + F.col("gid") - F.col("_first")
    return (
        laid_out.join(_offsets(laid_out, by), [*by, "chunk"])
        .withColumn("idx", at)
        .drop("_first", "_offset", "gid")
    )


def renumber(df: DataFrame, by: Sequence[str] = (SERIES,), name: str = "numbered") -> DataFrame:
    """As ``number`` after rows were dropped: ranks inside each chunk, then offsets."""
    rank = F.row_number().over(chunk_window(by)).cast("long") - 1
    stored = store(df.withColumn("_rank", rank), name)
    return (
        stored.join(_offsets(stored, by), [*by, "chunk"])
        .withColumn("idx", F.col("_offset") + F.col("_rank"))
        .drop("_first", "_offset", "_rank", "gid")
    )


def positions(
    df: DataFrame, order: Sequence[str], by: Sequence[str] = (SERIES,), chunks: int | None = None
) -> DataFrame:
    """``lay_out`` then ``number``."""
    return number(lay_out(df, order, by, chunks), by)


def chunk_window(by: Sequence[str] = (SERIES,), order: str = "gid") -> WindowSpec:
    return Window.partitionBy(*by, "chunk").orderBy(order)


def carry_in(
    df: DataFrame,
    values: dict[str, Column],
    by: Sequence[str] = (SERIES,),
    order: str = "gid",
    forward: bool = True,
) -> DataFrame:
    """Add, per name, the nearest non-null value from the chunks before (or after).

    ``values`` maps a new column name to the expression carried. Only one row per
    (series, chunk) crosses chunk borders.
    """
    pick = F.max_by if forward else F.min_by
    ends = df.groupBy(*by, "chunk").agg(
        *[pick(v, F.when(v.isNotNull(), F.col(order))).alias(name) for name, v in values.items()]
    )
    towards = F.asc("chunk") if forward else F.desc("chunk")
    passed = Window.partitionBy(*by).orderBy(towards).rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.last(name, ignorenulls=True).over(passed).alias(name) for name in values]
    summary = store(ends.select(*by, "chunk", *carried), "carry")
    return df.join(summary, [*by, "chunk"])


def with_blocks(
    df: DataFrame, before: int = 0, after: int = 0, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Add ``block`` and ``halo``; border rows are copied to the neighbour as halo.

    Frames reaching ``before`` rows back and ``after`` rows ahead are then whole
    inside (series, block) for every row with ``halo`` false.
    """
    size = max(block_rows, before, after, 1)
    own = F.expr(f"idx div {size}")
    inside = F.col("idx") % size
    home, ahead, behind = (
        F.struct((own + k).alias("block"), F.lit(k != 0).alias("halo")) for k in (0, 1, -1)
    )
    late = (inside >= size - before) & (F.col("idx") + size - inside < F.col("n"))
    early = (inside < after) & (own > 0)
    places = (
        F.when(late & early, F.array(home, ahead, behind))
        .when(late, F.array(home, ahead))
        .when(early, F.array(home, behind))
        .otherwise(F.array(home))
    )
    return df.withColumn("_place", F.explode(places)).select(*df.columns, "_place.block", "_place.halo")


def block_window(by: Sequence[str] = (SERIES,)) -> WindowSpec:
    return Window.partitionBy(*by, "block").orderBy("idx")


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(~F.col("halo")).drop("block", "halo")


def shifted(
    df: DataFrame,
    columns: dict[str, tuple[str, int]],
    by: Sequence[str] = (SERIES,),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Lags (positive) and leads (negative) of a numbered frame: name -> (column, k)."""
    steps = [k for _, k in columns.values()]
    framed = with_blocks(df, max(0, *steps), max(0, *[-k for k in steps]), block_rows)
    w = block_window(by)
    return own_rows(framed.withColumns({name: F.lag(c, k).over(w) for name, (c, k) in columns.items()}))


def attach(
    df: DataFrame,
    facts: DataFrame,
    on: Sequence[str],
    spread: Sequence[str],
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join per-series ``facts``, a stored table, onto rows whose key may be hot.

    If the file size of ``facts`` is under the broadcast threshold, the choice is left to
    Spark, which knows that size and at run time the true ones. Beyond it both sides are
    shuffled: keys are counted, and only those with more than ``hot_rows`` rows are salted,
    each with as many salts as its count asks for, by a hash of the ``spread`` columns.
    """
    limit = df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if plan_bytes(facts) <= _bytes(limit):
        return df.join(facts, list(on), how)
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    # At most one row for every ``hot_rows`` rows.
    hot = store(counts.select(*on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_salts")), "hot_keys")
    salts = F.coalesce("_salts", F.lit(1))
    salted = df.join(hot, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(*spread), salts).cast("int"))
    copies = facts.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.drop("_salts").join(copies.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def _bytes(text: str) -> int:
    """Bytes of a setting such as 10485760b, 10MB or -1."""
    number = text.lower().rstrip("b")
    scale = {"k": 10, "m": 20, "g": 30}.get(number[-1], 0)
    return int(number[:-1] if scale else number) << scale
