"""As-of join on the positional layout: the latest known values at or before a row's time.

Both sides are united and laid out together by (by, time, side), so a long series is spread
over range partitions. Inside a partition the last known value is carried down in order; over
its border goes one row per series and partition (``carry_in``). Neither side is shuffled by
key alone and no pairs are formed, whatever the gaps.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.operators.fill import forward_fill
from gapcast.plans.layout import lay_out


def asof_join(
    left: DataFrame,
    right: DataFrame,
    time: str,
    right_time: str,
    columns: Sequence[str],
    by: Sequence[str] = (),
    chunks: int | None = None,
) -> DataFrame:
    """``left`` with each of ``columns`` as last known (not null) in ``right`` at or before ``time``.

    Every left row comes back once. A left row without a time, or before all of ``right``, gets
    nulls; right rows without a time are never met. Of right rows of one time, the last in the
    order of their values counts.
    """
    nothing = {c: F.lit(None).cast(t) for c, t in right.select(*columns).dtypes}
    asked = left.select(
        *by, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"),
        *[nothing[c].alias(c) for c in columns],
    )
    shape = asked.schema["_row"].dataType
    known = right.where(F.col(right_time).isNotNull()).select(
        *by, F.col(right_time).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(shape).alias("_row"), *columns
    )
    both = lay_out(asked.unionByName(known), ["_at", "_side", *columns], by, chunks, "asof")
    filled = forward_fill(both, list(columns), by, order="gid").where("_side = 1")
    return filled.select("_row.*", *columns)
