"""Connected components of a table of links, by large-star and small-star rounds.

Every round is written to the shared folder, which cuts the lineage. A hub's links are
never gathered: minima are aggregated, and the join that carries them back has both sides
exchanged for it alone, so that AQE can split a hub. Each round is a few joins over at
most the number of links; the number of rounds grows with the logarithm of the nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapcast.plans.scratch import store


def _least(pairs: DataFrame) -> DataFrame:
    """u and the least of u and its partners, under a key that the grouping has not dealt by."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return least.select(F.bitwise_not("u").alias("key"), F.least("u", "m").alias("m"))


def _round(links: DataFrame) -> DataFrame:
    """Links (u, v), u > v, after one large-star and one small-star step."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    larger = both.where("v > u").select(F.bitwise_not("u").alias("key"), F.col("v").alias("node"))
    joined = larger.join(_least(both), "key").select(F.col("node").alias("u"), F.col("m").alias("v"))
    large = store(joined.where("u > v").distinct(), "links-large")
    keyed = large.select(F.bitwise_not("u").alias("key"), F.col("u"), F.col("v"))
    small = keyed.join(_least(large), "key")
    ends = F.explode(F.array("u", "v")).alias("u")
    return small.select(ends, F.col("m").alias("v")).where("u > v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``links`` (a, b).

    Links may be repeated, in either order, or of a node with itself.
    """
    kept = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    now = store(kept.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v") % 1_000_000_007).alias("h")).first()
        if state == before or not state["n"]:
            break
        before, now = state, store(_round(now), "links")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
