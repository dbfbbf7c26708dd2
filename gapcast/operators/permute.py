"""A shuffle without a sort: a keyed permutation gives each row its place.

Rows are numbered 0..N-1 in the order of their keys, which for a series and a position is
arithmetic on one row per series. The number goes through a Feistel network over a rectangle
of a little more than N cells; what falls outside goes through again until it is inside, so
the network is a permutation of 0..N-1. No row is moved.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcast.plans.layout import attach, lay_out, positions
from gapcast.plans.scratch import store

ROUNDS = 6
BLOCK = 1 << 16
U64 = np.uint64


def _scrambled(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit values mixed under a seed."""
    z = x + U64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ (z >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> U64(27))) * U64(0x94D049BB133111EB)
    return z ^ (z >> U64(31))


def permuted(numbers: np.ndarray, total: int, seed: int) -> np.ndarray:
    """Where a permutation of 0..total-1, fixed by ``seed``, takes each of ``numbers``."""
    width = math.isqrt(max(total - 1, 0)) + 1
    height = -(-total // width)
    out = numbers.astype(U64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] // U64(width), out[todo] % U64(width)
        # The halves take turns; each is moved round its own side of the rectangle.
        for k in range(ROUNDS):
            if k % 2 == 0:
                left = (left + _scrambled(right, seed * ROUNDS + k) % U64(height)) % U64(height)
            else:
                right = (right + _scrambled(left, seed * ROUNDS + k) % U64(width)) % U64(width)
        out[todo] = left * U64(width) + right
        todo = todo[out[todo] >= U64(total)]
    return out.astype(np.int64)


def place_of(number: Column, total: Column, seed: int) -> Column:
    """``permuted`` as a column; ``total`` is the same in all rows."""

    @F.pandas_udf("bigint")
    def run(numbers: pd.Series, totals: pd.Series) -> pd.Series:
        if not len(numbers):
            return numbers
        return pd.Series(permuted(numbers.to_numpy(), int(totals.iloc[0]), seed))

    return run(number, total)


def _running(facts: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """``facts`` (a row per key) with the sum of ``value`` over the keys before, and over all."""
    laid = lay_out(facts, list(by), by=(), name="running")
    parts = laid.groupBy("chunk").agg(F.sum(value).alias("_part"))
    earlier = Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    # One row per range partition.
    parts = parts.select(
        "chunk", F.coalesce(F.sum("_part").over(earlier), F.lit(0)).alias("_lead"), F.sum("_part").over(every).alias("_total")
    )
    before = Window.partitionBy("chunk").orderBy("gid").rowsBetween(Window.unboundedPreceding, -1)
    inside = laid.withColumn("_sum", F.coalesce(F.sum(value).over(before), F.lit(0)))
    joined = inside.join(store(parts, "running_parts"), "chunk")
    return joined.withColumn("_before", F.col("_lead") + F.col("_sum")).drop("_lead", "_sum", "chunk", "gid")


def ranked(df: DataFrame, key: Sequence[str], chunks: int | None = None) -> DataFrame:
    """``df`` with ``rank``, its 0-based number in the order of ``key``, and ``_total``, the number of rows.

    Where the last key counts in equal steps within the others, as the starts of windows do, the
    rank is worked out from each group's count and ends. Whether it does is told by counts, ends
    and a hash of all its values against that of the steps, without moving a row. Rows whose last
    key has gaps or repeats are laid out in order to be numbered, with the same result.
    """
    *groups, counter = key
    whole = dict(df.dtypes)[counter] in ("tinyint", "smallint", "int", "bigint")
    if groups and whole:
        value = F.col(counter).cast("bigint")
        counts = df.groupBy(*groups).agg(
            F.count(F.lit(1)).alias("_rows"), F.count(counter).alias("_known"), F.min(value).alias("_low"),
            F.max(value).alias("_high"), F.bit_xor(F.xxhash64(value)).alias("_hash"),
        )
        step = F.greatest(F.expr("(_high - _low) div greatest(_rows - 1, 1)"), F.lit(1))
        facts = store(counts.withColumn("_step", step), "rank_facts")
        steps = facts.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(_rows - 1) div {BLOCK}"))))
        ends = F.col("_block") * BLOCK, F.least(F.col("_block") * BLOCK + BLOCK, F.col("_rows")) - 1
        steps = steps.withColumn("_k", F.explode(F.sequence(*ends)))
        right = F.bit_xor(F.xxhash64(F.col("_low") + F.col("_step") * F.col("_k"))) == F.first("_hash")
        lost = F.col("_known") < F.col("_rows")
        for c in groups:
            lost = lost | F.col(c).isNull()
        if facts.where(lost).isEmpty() and steps.groupBy(*groups).agg(right.alias("_right")).where("NOT _right").isEmpty():
            offsets = store(_running(facts.select(*groups, "_rows", "_low", "_step"), groups, "_rows"), "rank_offsets")
            joined = attach(df, offsets.drop("_rows"), groups, [counter], "inner")
            rank = F.col("_before") + F.expr(f"(cast(`{counter}` as bigint) - _low) div _step")
            return joined.withColumn("rank", rank).drop("_before", "_low", "_step")
    placed = positions(df, list(key), by=(), chunks=chunks)
    return placed.drop("chunk").withColumnsRenamed({"idx": "rank", "n": "_total"})
