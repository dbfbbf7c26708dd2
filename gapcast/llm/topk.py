"""Exact top-k by inner product over norm buckets.

Vectors are turned into floor(1024 * x), exact in doubles. Candidates are range-partitioned
by length, longest first, into buckets of about ``BUCKET``; queries into blocks of about
``QUERIES``.

1. Every block meets the bucket with the longest vectors, which gives each query a score
   that its k-th best has at least.
2. A block meets a bucket only if that score lets some query reach it: for a query q and a
   bucket with greatest length m the local cosine threshold is score / (|q| m), and nothing
   above 1 can be met.
3. In a bucket, a query with a low threshold takes the candidates that are long enough (a
   beginning of the bucket); one with a high threshold takes those whose coordinate at the
   query's strongest dimension lies in the interval that the threshold allows. The products
   of the survivors are computed in full.
4. The best of each pair are merged by query with a limited window.

Memory is bounded by a block and a bucket. Vectors that are null, empty, or hold null or
non-finite components take no part, nor do rows without vec_id. Vectors are compared with
those of their own dimension. Repeated rows with the same vector count once; ties go to the
smaller vec_id. Scores are exact while products stay below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapcast.llm.vectors import as_bytes, matrix
from gapcast.plans.scratch import store

K = 10
SCALE = 1024
BUCKET = 4096
QUERIES = 1024
COSINE = 0.5  # from this local threshold on, coordinates prune
SLACK = 1e-9


def _dealt(rows: DataFrame, size: int, name: str, label: str) -> DataFrame:
    """Rows under ``label``, the number of their part in the order by length; a part has one dimension."""

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield batch.assign(task=task, nth=seen + np.arange(len(batch)))
            seen += len(batch)

    parts = max(1, -(-rows.count() // size))
    ranged = rows.repartitionByRange(parts, "dim", F.desc("norm"), "vec_id").sortWithinPartitions("dim", F.desc("norm"), "vec_id")
    kinds = "vec_id bigint, dim bigint, v binary, norm double, task int, nth bigint"
    numbered = store(ranged.mapInPandas(number, kinds), name)
    # One row per task and dimension; the window is over those.
    tally = numbered.groupBy("dim", "task").agg(F.count("*").alias("n"), F.min("nth").alias("low"))
    before = Window.partitionBy("dim").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")
    placed = numbered.join(tally.select("dim", "task", start.alias("start")), ["dim", "task"])
    part = F.floor((F.col("start") + F.col("nth")) / size)
    return store(placed.select("vec_id", "dim", "v", "norm", F.xxhash64("dim", part).alias(label)), name)


def _search(k: int):
    """The k best of a bucket for each query of a block."""

    def run(queries, members):
        if not len(queries) or not len(members):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        members = members.sort_values(["norm", "vec_id"], ascending=[False, True])
        ids, norms = members["vec_id"].to_numpy(), members["norm"].to_numpy()
        candidates, wanted = matrix(members["v"].tolist()), matrix(queries["v"].tolist())
        unit = candidates / np.maximum(norms, 1e-300)[:, None]
        out = []
        for q, query_id, length, floor in zip(wanted, queries["vec_id"], queries["norm"], queries["floor"]):
            take = np.arange(len(ids))
            if floor > 0:
                # Shorter ones can't reach the score at any angle.
                take = take[: np.searchsorted(-norms, -(floor / length) * (1 - SLACK), "right")]
                cosine = floor / (length * norms[0])
                if cosine >= COSINE and len(take):
                    f = int(np.abs(q).argmax())
                    at, u = q[f] / length, np.clip(unit[take, f], -1, 1)
                    most = at * u + np.sqrt(max(0.0, 1 - at * at)) * np.sqrt(1 - u * u)
                    take = take[length * norms[take] * (most + SLACK) >= floor]
            take = take[ids[take] != query_id]
            scores = candidates[take] @ q
            if len(take) > k:
                least = np.partition(scores, len(scores) - k)[len(scores) - k]
                near = np.flatnonzero(scores >= least)
                near = near[np.lexsort([ids[take[near]], -scores[near]])][:k]
            else:
                near = np.arange(len(take))
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[take[near]], "score": scores[near].astype(np.int64)}))
        return pd.concat(out).astype("int64")

    return run


def _meet(pairs: DataFrame, blocks: DataFrame, buckets: DataFrame, k: int) -> DataFrame:
    """The k best for each query, over the given pairs of a block and a bucket."""
    asked = blocks.join(pairs, "block").select("block", "bucket", "vec_id", "v", "norm", "floor")
    given = buckets.join(pairs, "bucket").select("block", "bucket", "vec_id", "v", "norm")
    key = ["block", "bucket"]
    schema = "query_id bigint, vec_id bigint, score bigint"
    return asked.groupBy(*key).cogroup(given.groupBy(*key)).applyInPandas(_search(k), schema)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: for each row with ``is_query`` the k rows of the greatest inner products."""
    rows = as_bytes(vectors, lambda x: np.floor(SCALE * x)).where("v IS NOT NULL AND vec_id IS NOT NULL").distinct()

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            norms = [float(np.sqrt((np.frombuffer(v) ** 2).sum())) for v in batch["v"]]
            yield batch.assign(norm=np.array(norms, float))

    rows = store(rows.mapInPandas(measured, "vec_id bigint, dim bigint, v binary, norm double"), "top-vectors")
    buckets = _dealt(rows, BUCKET, "top-buckets", "bucket")
    blocks = _dealt(rows.where(is_query), QUERIES, "top-queries", "block")
    lengths = store(buckets.groupBy("dim", "bucket").agg(F.max("norm").alias("most")), "top-lengths")
    first = lengths.groupBy("dim").agg(F.max_by("bucket", F.struct("most", "bucket")).alias("bucket"))
    heads = blocks.select("dim", "block").distinct().join(first, "dim").select("block", "bucket")
    start = store(_meet(store(heads, "top-heads"), blocks.withColumn("floor", F.lit(0.0)), buckets, k), "top-start")
    floors = _best(start, k).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("floor"))
    known = store(blocks.join(floors, "vec_id", "left").fillna(0.0, ["floor"]), "top-known")
    need = F.min(F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).otherwise(0.0)).alias("need")
    reach = known.groupBy("dim", "block").agg(need)
    done = first.withColumnRenamed("bucket", "done")
    pairs = lengths.join(done, "dim").where("bucket <> done").join(reach, "dim").where(F.col("need") <= F.col("most") * (1 + SLACK))
    rest = _meet(store(pairs.select("block", "bucket"), "top-pairs"), known, buckets, k)
    return _best(start.unionByName(rest), k).select("query_id", "rank", "vec_id", "score")
