"""Writers. Parquet between steps, CSV and JSON at the edges."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gapcast.functions.clock import iso

# Fixed value: all six digits; the default format cuts to milliseconds.
CSV_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_table(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    writer = df.write.mode(mode)
    if format == "csv":
        writer = writer.option("header", True).option("timestampFormat", CSV_TIME)
    writer.format(format).save(path)


def write_metrics(document: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The ``metrics`` arrays of ``metrics_document`` as JSON lines."""
    document.write.mode(mode).json(path)


def write_scaler(scaler: DataFrame, path: str, mode: str = "errorifexists") -> None:
    scaler.write.mode(mode).parquet(path)


def write_windows(windows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One partition folder per split, so that a reader of one split scans only it."""
    windows.write.mode(mode).partitionBy("split").parquet(path)


def prediction_documents(cells: DataFrame, route: str, stop: str) -> DataFrame:
    """Live forecasts as stored documents, keyed by route, stop and poll time."""
    stamp = iso("poll_time")
    return cells.select(
        F.concat_ws("#", F.col(route), F.col(stop), stamp).alias("doc_id"),
        stamp.alias("timestamp_str"),
        F.col("poll_time").alias("timestamp"),
        F.col(route).alias("route_id"),
        F.col(stop).alias("stop_id"),
        F.col("predicted_headway").alias("predicted_mbt"),
        F.lit("ok").alias("status"),
        F.current_timestamp().alias("created_at"),
    )


def stream_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, **trigger
) -> StreamingQuery:
    """Start a stream whose micro-batches go to ``write(batch, number)``, which must bear a second run.

    ``trigger`` has the options of a stream's trigger, such as ``availableNow=True``.
    """
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(**trigger) if trigger else writer).start()


def replace_batch(documents: DataFrame, path: str, writer: str, number: int) -> None:
    """The documents of one micro-batch, in place of those of an earlier run of it."""
    documents.write.mode("overwrite").parquet(f"{path}/writer={writer}/batch={number}")


def write_predictions(documents: DataFrame, path: str, checkpoint: str | None = None, **trigger):
    """Add documents to the store; for a stream, start it with its own checkpoint and return the query.

    Each micro-batch has a folder named by its checkpoint and number and replaces that folder,
    so a batch that runs again after a crash leaves its documents once. Documents that come with
    another checkpoint, or a second batch write, are further versions of their keys, of which
    ``read_predictions`` takes the newest.
    """
    if not documents.isStreaming:
        replace_batch(documents, path, uuid.uuid4().hex, 0)
        return None
    if checkpoint is None:
        raise ValueError("a stream of predictions needs a checkpoint folder")
    writer = hashlib.sha256(checkpoint.rstrip("/").encode()).hexdigest()[:32]
    return stream_batches(documents, lambda batch, number: replace_batch(batch, path, writer, number), checkpoint, **trigger)
