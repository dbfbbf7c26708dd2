"""Cleaning of a stream with its report: both come from one pass over each micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapcast.operators.clean import clean_observed, observed_report
from gapcast.sources.sinks import stream_batches


def write_cleaned(stream: DataFrame, rules: dict[str, Column], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start writing the rows that pass ``rules`` and, per micro-batch, what each rule removed.

    The counts are observed while the rows are written. A batch that runs again replaces both.
    """

    def write(batch: DataFrame, number: int) -> None:
        kept, counts = clean_observed(batch, rules)
        kept.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        report = observed_report(batch.sparkSession, counts, rules)
        report.coalesce(1).write.mode("overwrite").parquet(f"{path}/report/batch={number}")

    return stream_batches(stream, write, checkpoint, **trigger)


def cleaned_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch")


def live_report(spark: SparkSession, path: str) -> DataFrame:
    """step, rule, rows_before, rows_after, removed over all batches so far."""
    counts = [F.sum(c).alias(c) for c in ("rows_before", "rows_after", "removed")]
    return spark.read.parquet(f"{path}/report").groupBy("step", "rule").agg(*counts)
