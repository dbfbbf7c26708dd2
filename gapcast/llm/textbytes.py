"""Texts of an Arrow batch as one byte buffer, and hashes of their words without Python objects.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case.
All hashes are of 64 bits; what depends on equality of long texts uses two of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

SLICE_BYTES = 1 << 20
U64 = np.uint64
_rng = np.random.default_rng(20240607)
_TABLE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_BASE = 0x9E3779B97F4A7C15 | 5  # odd and 5 mod 8, so its powers have full period
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values, another for each seed."""
    z = x + U64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse."""
    both = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    return both[0], both[1]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return powers(max(2 * SLICE_BYTES, 1 << (n + 1).bit_length()))


def bounded_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Sends texts to Python in smaller batches than the default 10,000 rows.

    Executors then hold a few MB of text at a time, where texts are as long as web pages.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings or bytes; null counts as empty."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_string()).fill_null("")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of at most ``limit`` bytes, or of one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """``n + 1`` running sums from which ``span_hash`` takes the hash of any range."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * _powers(len(data))[0][: len(data)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of the bytes in each range [start, end), the same wherever they stand."""
    return mix((sums[ends] - sums[starts]) * _powers(len(sums))[1][starts])


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The hash of every word, the words' starts, and for each row the number of words before it."""
    data = _LOWER[data]
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.ones(len(data), bool)
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    after = np.ones(len(data), bool)
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    hashes = span_hash(prefix_hash(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return hashes, starts, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """For each row the sorted distinct hashes of its ``width``-word shingles.

    A row of fewer words has the whole sequence as its only one; a row without words has none.
    """
    hashes, _, first = words(data, offsets)
    weights = [U64(int(w)) for w in mix(np.arange(1, width + 1, dtype=np.uint64), 77) | U64(1)]
    total = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k, w in enumerate(weights):
        total += hashes[k : k + len(total)] * w
    total = mix(total, 3)
    for i in range(len(offsets) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= width:
            yield np.unique(total[lo : hi - width + 1])
        elif hi > lo:
            short = np.zeros(1, np.uint64)
            for k in range(hi - lo):
                short += hashes[lo + k : lo + k + 1] * weights[k]
            yield mix(short, 100 + hi - lo)
        else:
            yield np.zeros(0, np.uint64)
