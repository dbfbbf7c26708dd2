"""Vectors of an array column as bytes of doubles, with those that can't be compared set apart."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_bytes(table: DataFrame, shape: Callable[[np.ndarray], np.ndarray | None], column: str = "embedding") -> DataFrame:
    """(vec_id, dim, v): the values as doubles, as ``shape`` returns them.

    v is null for a null vector, one without components, one with a null or non-finite component,
    and where ``shape`` returns None.
    """

    def put(x: np.ndarray) -> bytes | None:
        shaped = shape(x) if len(x) and np.isfinite(x).all() else None
        return None if shaped is None else shaped.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            sizes = np.array([0 if n is None else n for n in pc.list_value_length(lists).to_pylist()], np.int64)
            ends = np.cumsum(sizes)
            values: list[bytes | None] = []
            for end, size in zip(ends, sizes):
                values.append(put(flat[end - size : end]))
            arrays = [batch.column(0), pa.array(sizes), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "dim", "v"])

    rows = table.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    return rows.mapInArrow(run, "vec_id bigint, dim bigint, v binary")


def matrix(values) -> np.ndarray:
    """One row per vector of a non-empty column of bytes."""
    return np.frombuffer(b"".join(values)).reshape(len(values), -1)
