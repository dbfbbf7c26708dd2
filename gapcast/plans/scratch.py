"""Intermediate tables in the shared folder the cluster names.

A stored table cuts the lineage, so a lost executor costs a re-read and not a
re-run, and it gives Catalyst true sizes: a small summary that has been stored
is broadcast because its file size is known to lie under
``spark.sql.autoBroadcastJoinThreshold``; a large one is shuffled.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_stored: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temp folder only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gapcast-"))
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str, owned: bool = True) -> str:
    """A path of its own in the shared folder; ``drop_stored`` deletes it only if it is ``owned``."""
    path = f"{shared_dir(spark)}/gapcast/{name}-{uuid.uuid4().hex}"
    if owned:
        _stored.append(path)
    return path


def store(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once and return a scan of what was written."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_paths() -> list[str]:
    """The tables this process stored and has not deleted, oldest first."""
    return list(_stored)


def drop_stored(spark: SparkSession, paths: list[str] | None = None) -> int:
    """Delete the tables this process stored, or only ``paths`` of them; returns how many were there."""
    jvm, gone = spark.sparkContext._jvm, 0
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in list(_stored) if paths is None else [p for p in paths if p in _stored]:
        _stored.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone
