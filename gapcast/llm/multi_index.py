"""Embedding near-dedup over an inverted multi-index.

1. Vectors that are equal bit for bit form a class with a weight; one of them goes on.
2. Two codebooks, one for each half of the normalised vectors, are fitted on a bounded
   sample (``SAMPLE``) and form a product grid; every vector is put into its cell.
3. A vector visits cells by the multi-sequence rule: pairs of codewords in the order of the
   sum of two squared distances, here those from the vector's halves to the codewords'
   regions. It goes on until the limit that holds ``RECALL`` of pairs which are as far
   apart as links can be, in random directions; closer pairs are found more often.
4. In a cell, members and visitors are compared in double precision, in blocks. A pair is
   met once: in a common cell, or where the one of the lesser cell visits the other's.
5. A block gives sums of link weights, and links that join what it has linked, at most one
   per vector, never all pairs. Large cells are split into blocks of members and visitors.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do
vectors of different dimensions. Rows with the same vec_id and equal vectors are copies of
each other. A row without vec_id is linked with nothing and has no component.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.llm.links import components
from gapcast.llm.vectors import as_bytes, matrix
from gapcast.plans.scratch import store

COSINE = 0.9
SAMPLE = 8192
RECALL = 0.995
CELL = 256
MEMBERS, VISITORS = 1024, 4096


def codebook(points: np.ndarray, size: int, rounds: int = 12) -> np.ndarray:
    """k-means codewords, started from points spread over the sample."""
    words = points[np.linspace(0, len(points) - 1, size).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(points, words)
        sums = np.zeros_like(words)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=size)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def squares(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (points**2).sum(1)[:, None] - 2 * points @ words.T + (words**2).sum(1)[None, :]


def nearest(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    return squares(points, words).argmin(1)


def regions(points: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Squared distances, from below, of points to the regions of the codewords: over the plane to each from the own one."""
    far = squares(points, words)
    own = far.argmin(1)
    gap = np.sqrt(np.maximum(squares(words, words), 1e-18))[own]
    over = (far - far[np.arange(len(points)), own][:, None]) / (2 * gap)
    over[np.arange(len(points)), own] = 0
    return np.maximum(over, 0) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Pairs of codewords by increasing sum of their distances, while it is within the limit."""
    one, two = first.argsort(kind="stable"), second.argsort(kind="stable")
    heap = [(float(first[one[0]] + second[two[0]]), 0, 0)]
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield int(one[i]), int(two[j])
        if j + 1 < len(two):
            heapq.heappush(heap, (float(first[one[i]] + second[two[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(one):
            heapq.heappush(heap, (float(first[one[i + 1]] + second[two[0]]), i + 1, 0))


class Grid:
    """The two codebooks for one dimension, and the limit of the traversal."""

    def __init__(self, sample: np.ndarray, total: int, cosine: float, recall: float):
        self.half = sample.shape[1] // 2 or 1
        size = max(1, min(len(sample) // 4, round((total / CELL) ** 0.5)))
        self.words = [codebook(part, size if part.shape[1] else 1) for part in self.halves(sample)]
        rng = np.random.default_rng(7)
        base = sample[rng.integers(0, len(sample), 4096)]
        turn = rng.normal(size=base.shape)
        turn -= (turn * base).sum(1, keepdims=True) * base
        turn /= np.maximum(np.linalg.norm(turn, axis=1, keepdims=True), 1e-12)
        other = cosine * base + (1 - cosine**2) ** 0.5 * turn
        cost = sum(
            regions(x, w)[np.arange(len(x)), nearest(y, w)]
            for x, y, w in zip(self.halves(base), self.halves(other), self.words)
        )
        self.limit = float(np.quantile(cost, recall, method="higher"))

    def halves(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return points[:, : self.half], points[:, self.half :]

    def cells(self, points: np.ndarray) -> np.ndarray:
        one, two = (nearest(x, w) for x, w in zip(self.halves(points), self.words))
        return one * len(self.words[1]) + two

    def visits(self, points: np.ndarray) -> Iterator[list[int]]:
        """For each point the cells of a greater number than its own that it visits."""
        far = [regions(x, w) for x, w in zip(self.halves(points), self.words)]
        for first, second, own in zip(*far, self.cells(points)):
            found = (i * len(self.words[1]) + j for i, j in traverse(first, second, self.limit))
            yield [c for c in found if c > own]


def unit(values) -> np.ndarray:
    points = matrix(values)
    points = points / np.abs(points).max(1, keepdims=True)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _placed(classes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """A row for the cell of each vector (visitor false) and for every cell it visits."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                grid = grids[int(dim)]
                for k in range(0, len(rows), 1000):
                    part = rows.iloc[k : k + 1000]
                    points = unit(part["v"].tolist())
                    own, visits = grid.cells(points), list(grid.visits(points))
                    at = np.repeat(np.arange(len(part)), [1 + len(v) for v in visits])
                    cell = np.concatenate([[o, *v] for o, v in zip(own, visits)]).astype(np.int64)
                    visitor = np.concatenate([[False] + [True] * len(v) for v in visits])
                    yield part.iloc[at].assign(cell=cell, visitor=visitor)

    return classes.mapInPandas(run, "dim bigint, v binary, id bigint, weight bigint, cell bigint, visitor boolean")


def _block(cosine: float):
    """Weights of links in a block, and links that join what is linked in it."""

    def run(rows):
        members, visitors = rows[rows["role"] == 0], rows[rows["role"] == 1]
        if not len(members) or not len(visitors):
            return pd.DataFrame({"a": [], "b": [], "links": []}).astype("int64")
        x, y = unit(visitors["v"].tolist()), unit(members["v"].tolist())
        x_id, y_id = visitors["id"].to_numpy(), members["id"].to_numpy()
        linked = x @ y.T >= cosine
        # Two of the same cell are compared once, as visitor the smaller.
        home = ~visitors["visitor"].to_numpy()
        linked &= ~home[:, None] | (x_id[:, None] < y_id[None, :])
        to_x, to_y = linked @ members["weight"].to_numpy(), visitors["weight"].to_numpy() @ linked
        some_x, some_y = linked.any(1), linked.any(0)
        linked, x_id, y_id = linked[some_x][:, some_y], x_id[some_x], y_id[some_y]
        label = np.arange(len(y_id))
        while len(label):
            of_x = np.where(linked, label[None, :], len(label)).min(1)
            new = np.where(linked, of_x[:, None], len(label)).min(0)
            if (new == label).all():
                break
            label = new
        roots = [y_id[of_x], y_id[label]] if len(label) else [y_id, y_id]
        ids = np.concatenate([x_id, y_id])
        sums = np.concatenate([to_x[some_x], to_y[some_y]])
        return pd.DataFrame({"a": ids, "b": np.concatenate(roots) if len(label) else ids, "links": sums}).astype("int64")

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row."""
    rows = as_bytes(vectors, lambda x: x + 0.0 if x.any() else None)
    rows = store(rows.withColumn("v", F.when(F.col("vec_id").isNotNull(), F.col("v"))), "vectors")
    classes = rows.where("v IS NOT NULL").groupBy("dim", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("weight"))
    classes = store(classes, "vector-classes")
    sizes = {int(r["dim"]): int(r["n"]) for r in classes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    grids = {}
    for dim, n in sizes.items():
        share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))
        drawn = classes.where((F.col("dim") == dim) & share).select("v").collect() or classes.where(F.col("dim") == dim).select("v").take(1)
        grids[dim] = Grid(unit(sorted(bytes(r["v"]) for r in drawn)), n, cosine, recall)
    placed = store(_placed(classes.select("dim", "v", "id", "weight"), grids), "cells")
    cell = ["dim", "cell"]
    count = placed.groupBy(*cell).agg(F.count_if(~F.col("visitor")).alias("members"), F.count("*").alias("all"))
    count = store(count.where("members > 0"), "cell-sizes")
    m, v = F.ceil(F.col("members") / MEMBERS).cast("int"), F.ceil(F.col("all") / VISITORS).cast("int")
    dealt = placed.join(count.withColumn("m", m).withColumn("v_parts", v), cell)
    own = F.pmod(F.xxhash64("id"), F.col("m")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("v_parts")).cast("int")
    role = lambda r, i, j: F.struct(F.lit(r).alias("role"), i.alias("i"), j.alias("j"))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda i: role(1, i, own[1]))
    as_member = F.transform(F.sequence(F.lit(0), F.col("v_parts") - 1), lambda j: role(0, own[0], j))
    roles = F.when(F.col("visitor"), as_visitor).otherwise(F.concat(as_visitor, as_member))
    dealt = dealt.withColumn("r", F.explode(roles)).select(*cell, "r.i", "r.j", "r.role", "id", "v", "weight", "visitor")
    found = store(dealt.groupBy(*cell, "i", "j").applyInPandas(_block(cosine), "a bigint, b bigint, links bigint"), "vector-links")
    parts = components(found.select("a", "b"))
    sums = found.groupBy("a").agg(F.sum("links").alias("links"))
    joined = classes.join(sums, classes.id == sums.a, "left").join(parts, classes.id == parts.node, "left")
    known = joined.select(
        "dim", F.col("v").alias("value"), F.coalesce("component", "id").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    known = store(known.drop("dim"), "vector-parts")
    out = rows.join(known, rows.v == known.value, "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
