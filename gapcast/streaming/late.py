"""Rows that come later than the watermark allows, kept where a user can read and count them.

Spark drops such rows inside its stateful operators and tells only their number, report by
report. ``split_late`` runs beside those operators over the same updates: each micro-batch is
written once with the watermark that holds for it, so the rows dropped, their number per batch
and the watermarks are tables. A batch that runs again replaces what it wrote.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapcast.sources.sinks import stream_batches

#: Stateful operators drop rows by the watermark that the batch before them ran with, and that
#: is known from the batches before that one.
BEHIND = 2


def split_late(
    updates: DataFrame,
    path: str,
    checkpoint: str,
    delay: str = "2 minutes",
    time: str = "ts",
    behind: int = BEHIND,
    **trigger,
) -> StreamingQuery:
    """Start writing every row with ``late``, and ``marks`` of each batch, under ``path``.

    A row of batch k is late if its time is not after the watermark: the greatest time in
    batches up to k - ``behind``, less ``delay``, in whole milliseconds. ``behind=1`` holds
    a row against all batches before its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        marks = spark.read.schema(_MARKS).parquet(f"{path}/marks") if number else None
        high = marks.where(F.col("batch") <= number - behind).agg(F.max("high")).first()[0] if number else None
        mark = F.lit(high).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        watermark = F.timestamp_millis(F.unix_millis(mark))
        late = F.coalesce(F.col(time) <= watermark, F.lit(False))
        rows = f"{path}/rows/batch={number}"
        batch.withColumns({"late": late, "watermark": watermark}).write.mode("overwrite").parquet(rows)
        done = spark.read.schema(f"late boolean, watermark timestamp, `{time}` timestamp").parquet(rows)
        counts = done.agg(
            F.max(time).alias("high"), F.max("watermark").alias("watermark"),
            F.count(F.lit(1)).alias("rows"), F.count_if("late").alias("late_rows"),
        )
        counts.write.mode("overwrite").parquet(f"{path}/marks/batch={number}")

    return stream_batches(updates, write, checkpoint, **trigger)


_MARKS = "high timestamp, watermark timestamp, rows bigint, late_rows bigint, batch int"


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The late rows with the watermark that passed them, and their ``batch``."""
    return spark.read.parquet(f"{path}/rows").where("late").drop("late")


def late_counts(spark: SparkSession, path: str) -> DataFrame:
    """batch, rows, late_rows, watermark and high (the greatest time) of every batch so far."""
    marks = spark.read.schema(_MARKS).parquet(f"{path}/marks")
    return marks.select("batch", "rows", "late_rows", "watermark", "high")
