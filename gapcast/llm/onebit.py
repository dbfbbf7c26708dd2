"""Approximate nearest neighbours by cosine over randomly rotated one-bit codes.

1. ``Index`` has centres fitted on a bounded sample and, for each dimension, a random rotation
   made from a fixed seed. Every vector is indexed: its unit vector goes to the nearest
   centre's cell, the rest of it (unit vector less centre) is rotated, and the code is the sign
   of each coordinate, packed to bits, with correction scalars: the length of the rest, the
   inner product of code and rest, and that of vector and centre.
2. The product of a query's rotated rest with the code's signs, over the correction, estimates
   the inner product of the rests without bias. What the estimate lacks is a random direction's
   share, so ``BOUND`` of its deviations bound the error (Gao and Long, RaBitQ, 2024).
3. A query meets its own cell first, which gives it a floor that its k-th best has at least.
   It then meets the other cells near it. In each it computes the cosines of those with the
   best estimates, and then of all whose estimate plus its error bound reaches the floor.
4. The best of all cells are merged by query. Scores are exact cosines in double precision.

How many cells are met is set on the sample: as many as hold a share ``recall`` of the nearest
sample vectors; those in the whole table are nearer, and so in nearer cells. Vectors without
clusters need most cells and the search is then a scan of all codes.

Equal vectors are one class of which at most k + 1 ids, the smallest, are carried: no other can
be among a query's k nearest. Classes of a cell are dealt to parts of about ``MEMBERS`` and its
queries to parts of about ``QUERIES``, so neither copies nor close groups fill a task, and
memory is that of two parts.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
rows without vec_id. Vectors are compared with those of their own dimension. Rows with the same
id and vector count once; rows that share an id but not the vector are candidates each, and none
is offered to a query of that id. Ties go to the smaller vec_id. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcast.llm.vectors import as_bytes, matrix
from gapcast.plans.scratch import store

K = 5
CELL = 2048  # vectors of a cell, as far as the sample allows
SAMPLE = 16_384  # vectors the centres are fitted on
RECALL = 0.97
BOUND = 2.5  # deviations of an estimate
MEMBERS = 4096
QUERIES = 1024
ROUNDS = 8  # of fitting the centres


@lru_cache(8)
def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same wherever it is made."""
    turned, upper = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return turned * np.sign(np.diag(upper))


def unit(values) -> np.ndarray:
    points = matrix(values)
    points = points / np.abs(points).max(1, keepdims=True)
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def _apart(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, less what is the same for all centres."""
    return (centres**2).sum(1)[None, :] - 2 * (points @ centres.T)


class Index:
    """Centres of one dimension and the number of cells a query meets."""

    def __init__(self, sample: np.ndarray, total: int, k: int = K, recall: float = RECALL):
        size = max(1, min(-(-total // CELL), len(sample) // 16))
        rng = np.random.default_rng(5)
        self.centres = sample[rng.choice(len(sample), size, replace=False)]
        for _ in range(ROUNDS if size > 1 else 1):
            own = self.cells(sample)
            count = np.bincount(own, minlength=size)
            sums = np.zeros_like(self.centres)
            np.add.at(sums, own, sample)
            lost = count == 0
            sums[lost] = sample[rng.choice(len(sample), int(lost.sum()))]
            self.centres = sums / np.maximum(count, 1)[:, None]
        self.probes = self._needed(sample, rng, k, recall)

    def cells(self, points: np.ndarray) -> np.ndarray:
        return np.concatenate([_apart(points[i : i + 4096], self.centres).argmin(1) for i in range(0, len(points), 4096)])

    def near(self, points: np.ndarray) -> np.ndarray:
        """For each point the cells to meet, the nearest first."""
        return np.argsort(_apart(points, self.centres), axis=1, kind="stable")[:, : self.probes]

    def _needed(self, sample: np.ndarray, rng: np.random.Generator, k: int, recall: float) -> int:
        asked = rng.choice(len(sample), min(len(sample), 512), replace=False)
        cosines = sample[asked] @ sample.T
        cosines[np.arange(len(asked)), asked] = -2
        found = np.argsort(-cosines, axis=1)[:, : min(k, len(sample) - 1)]
        if not found.size:
            return len(self.centres)
        place = np.argsort(np.argsort(_apart(sample[asked], self.centres), axis=1, kind="stable"), axis=1)
        ranks = np.take_along_axis(place, self.cells(sample)[found], axis=1)
        return int(np.quantile(ranks, recall, method="higher")) + 1

    def encode(self, points: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, length of the rest, product of code and rest, product with the centre."""
        centre = self.centres[cells]
        length, turned = self._rest(points, centre)
        aligned = np.abs(turned).sum(1) / np.sqrt(points.shape[1])
        aligned[length == 0] = 1.0
        return np.packbits(turned > 0, axis=1), length, aligned, (points * centre).sum(1)

    @staticmethod
    def _rest(points: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = points - centre
        length = np.linalg.norm(rest, axis=1)
        return length, (rest / np.where(length > 0, length, 1)[:, None]) @ rotation(points.shape[1])

    def estimate(self, cell: int, queries: np.ndarray, bits, length, aligned, to_centre) -> tuple[np.ndarray, np.ndarray]:
        """Estimated cosines of queries (rows) and a cell's members, and bounds of their errors."""
        dim = queries.shape[1]
        centre = self.centres[cell]
        q_length, turned = self._rest(queries, centre[None, :])
        signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
        rests = (turned.astype(np.float32) @ signs.T) / (np.sqrt(dim) * aligned)
        scale = q_length[:, None] * length
        spread = np.sqrt(np.maximum(0.0, 1 - aligned**2)) / aligned / np.sqrt(max(1, dim - 1))
        mid = (queries @ centre)[:, None] + to_centre - centre @ centre
        return mid + scale * rests, scale * (BOUND * spread) + 1e-5


def _indexed(classes: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                index = indexes[int(dim)]
                for i in range(0, len(rows), 4096):
                    part = rows.iloc[i : i + 4096]
                    points = unit(part["v"].tolist())
                    cells = index.cells(points)
                    bits, length, aligned, to_centre = index.encode(points, cells)
                    yield part.assign(
                        cell=cells.astype(np.int64), bits=[b.tobytes() for b in bits], length=length, aligned=aligned, to_centre=to_centre
                    )

    schema = "cls bigint, dim bigint, v binary, ids array<bigint>, asked boolean"
    return classes.mapInPandas(run, f"{schema}, cell bigint, bits binary, length double, aligned double, to_centre double")


def _visits(asked: DataFrame, indexes: dict[int, Index]) -> DataFrame:
    """cls, dim, v, cell, nth: a row for each cell that a query class meets; nth 0 is the nearest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, rows in batch.groupby("dim"):
                for i in range(0, len(rows), 256):
                    part = rows.iloc[i : i + 256]
                    near = indexes[int(dim)].near(unit(part["v"].tolist()))
                    at = np.repeat(np.arange(len(part)), near.shape[1])
                    nth = np.tile(np.arange(near.shape[1]), len(part))
                    yield part.iloc[at].assign(cell=near.ravel().astype(np.int64), nth=nth.astype(np.int64))

    return asked.mapInPandas(run, "cls bigint, dim bigint, v binary, cell bigint, nth bigint")


def _search(indexes: dict[int, Index], k: int):
    """The k + 1 best ids of a part of a cell for each query class of a part."""

    def run(key, queries, members):
        none = pd.DataFrame({"cls": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(queries) or not len(members):
            return none
        index, cell, want = indexes[int(key[0])], int(key[1]), k + 1
        wanted, points = unit(queries["v"].tolist()), unit(members["v"].tolist())
        bits = np.frombuffer(b"".join(members["bits"]), np.uint8).reshape(len(members), -1)
        scalars = (members[c].to_numpy() for c in ("length", "aligned", "to_centre"))
        guess, error = index.estimate(cell, wanted, bits, *scalars)
        ids = members["ids"].to_numpy()
        out = []
        for q, cls, floor, middle, off in zip(wanted, queries["cls"], queries["floor"], guess, error):
            take = np.arange(len(points))
            if len(take) > 4 * want:
                # The best by estimate may lift the floor of this part.
                first = np.argpartition(-middle, 4 * want)[: 4 * want]
                exact = (points[first] * q).sum(1)
                floor = max(floor, np.partition(exact, len(exact) - want)[len(exact) - want])
                take = np.flatnonzero(middle + off >= floor)
                take = np.union1d(take, first)
            exact = (points[take] * q).sum(1)
            best = np.argsort(-exact, kind="stable")
            if len(best) > want:
                best = np.flatnonzero(exact >= exact[best[want - 1]])
            rows = [(-exact[b], int(i)) for b in best for i in ids[take[b]]]
            rows.sort()
            out += [(cls, i, -s) for s, i in rows[:want]]
        return pd.DataFrame(out, columns=["cls", "vec_id", "score"])

    return run


def _meet(visits: DataFrame, members: DataFrame, indexes: dict[int, Index], k: int) -> DataFrame:
    """cls, vec_id, score: the best for each query class in each cell it meets."""
    cell = ["dim", "cell"]
    sizes = members.groupBy(*cell).agg(F.count("*").alias("n")).join(visits.groupBy(*cell).agg(F.count("*").alias("q")), cell)
    parts = store(sizes.select(*cell, F.ceil(F.col("n") / MEMBERS).alias("m"), F.ceil(F.col("q") / QUERIES).alias("j_parts")), "onebit-parts")
    own = lambda n: F.pmod(F.xxhash64("cls"), F.col(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asked = visits.join(parts, cell).withColumn("j", own("j_parts")).withColumn("i", all_of("m"))
    given = members.join(parts, cell).withColumn("i", own("m")).withColumn("j", all_of("j_parts"))
    key = [*cell, "i", "j"]
    asked = asked.select(*key, "cls", "v", "floor").groupBy(*key)
    given = given.select(*key, "v", "ids", "bits", "length", "aligned", "to_centre").groupBy(*key)
    return asked.cogroup(given).applyInPandas(_search(indexes, k), "cls bigint, vec_id bigint, score double")


def _best(found: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def build(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE):
    """The indexed classes of ``vectors`` (stored), the query rows, and the fitted parts by dimension."""
    flag = F.coalesce(is_query, F.lit(False))
    marked = vectors.select("vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    rows = as_bytes(marked, lambda x: x + 0.0 if x.any() else None).where("v IS NOT NULL AND vec_id IS NOT NULL").distinct()
    rows = store(rows.withColumn("asked", flag), "onebit-rows")
    value = Window.partitionBy("dim", "v").orderBy("vec_id")
    few = rows.withColumn("copy", F.row_number().over(value)).where(F.col("copy") <= k + 1)
    some = rows.where("asked").select("dim", "v").distinct().withColumn("asked", F.lit(True))
    classes = few.groupBy("dim", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).join(some, ["dim", "v"], "left")
    classes = classes.select(
        F.monotonically_increasing_id().alias("cls"), "dim", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")
    )
    classes = store(classes, "onebit-classes")
    indexes = {}
    for dim, n in classes.groupBy("dim").count().collect():
        own = classes.where(F.col("dim") == dim)
        share = F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample / n))
        drawn = own.where(share).select("v").limit(2 * sample).collect() or own.select("v").take(1)
        indexes[int(dim)] = Index(unit(sorted(bytes(r["v"]) for r in drawn)), n, k, recall)
    members = store(_indexed(classes, indexes), "onebit-index")
    return rows.where("asked").select(F.col("vec_id").alias("query_id"), "dim", "v"), members, indexes


def search(asked: DataFrame, members: DataFrame, indexes: dict[int, Index], k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score for the query rows, from what ``build`` returns."""
    queries = members.where("asked").select("cls", "dim", "v")
    visits = store(_visits(queries, indexes), "onebit-visits")
    start = store(_meet(visits.where("nth = 0").withColumn("floor", F.lit(-2.0)), members, indexes, k), "onebit-start")
    floors = _best(start, "cls", k + 1).where(F.col("rank") == k + 1).select("cls", F.col("score").alias("floor"))
    later = visits.where("nth > 0").join(floors, "cls", "left").fillna(-2.0, ["floor"])
    rest = _meet(later, members, indexes, k)
    best = store(_best(start.unionByName(rest), "cls", k + 1).drop("rank"), "onebit-best")
    named = asked.join(queries, ["dim", "v"]).select("query_id", F.bitwise_not("cls").alias("of"))
    found = named.join(best.withColumn("of", F.bitwise_not("cls")), "of").where("vec_id <> query_id")
    return _best(found.select("query_id", "vec_id", "score").distinct(), "query_id", k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query`` the nearest found by cosine, itself left out."""
    return search(*build(vectors, is_query, k, recall, sample), k=k)
