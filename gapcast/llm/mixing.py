"""Mixing of sources to target weights by Poisson replication, in DataFrame functions only.

A source's target weight and its size give the mean repetition rate of its documents.
A document's count is the inverse of the Poisson distribution with that mean at a number
in (0, 1) taken from a hash of seed and doc_id, so a rerun or a lost executor gives the
same copies. Above ``LARGEST``, where exp(-rate) nears the least double, the count is the sum
of several such draws of equal mean. Each copy has a shuffle key, another hash, and the result is in its order.

Null sources are one source of their own. Null texts have size 0; a source without any
text keeps one copy of each document. Rows with the same doc_id get the same count. Other
columns stay unless they are named copy or shuffle_key, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapcast.plans.scratch import store

HEX_DIGITS = 13
SPAN = float(16**HEX_DIGITS)
LARGEST = 700.0


def uniform(*parts: Column) -> Column:
    """A number in (0, 1) from a hash of the parts."""
    head = F.substring(F.md5(F.concat_ws("|", *parts)), 1, HEX_DIGITS)
    return (F.conv(head, 16, 10).cast("bigint").cast("double") + 0.5) / SPAN


def rates(documents: DataFrame, weights: dict[str, float] | None, power: float, size: float) -> DataFrame:
    """source, the number of draws, the rate of each, and its cumulative Poisson probabilities up to where they no longer change.

    ``weights`` are the sources' target shares of the text; without them a source's share
    goes with its size to ``power``. ``size`` is the size of the result as a multiple of the input.
    """
    chars = F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("double")
    sizes = store(documents.groupBy("source").agg(chars.alias("chars")), "source-sizes")
    if weights is None:
        wanted = sizes.withColumn("weight", F.pow("chars", F.lit(power)))
    else:
        given = documents.sparkSession.createDataFrame(list(weights.items()), "source string, weight double")
        wanted = sizes.join(given, sizes.source.eqNullSafe(given.source), "left").select(
            sizes.source, "chars", F.coalesce("weight", F.lit(0.0)).alias("weight")
        )
    totals = wanted.where("chars > 0").agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    share = size * F.col("weight") / F.lit(totals["weight"]) * F.lit(totals["chars"]) / F.col("chars")
    rate = F.when(F.col("chars") > 0, share)
    rated = wanted.select("source", F.coalesce(rate, F.lit(1.0)).alias("rate"))
    draws = F.greatest(F.ceil(F.col("rate") / LARGEST), F.lit(1)).cast("int")
    rated = rated.withColumn("draws", draws).withColumn("rate", F.col("rate") / F.col("draws"))
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    start = F.struct(F.exp(-F.col("rate")).alias("p"), F.array(F.exp(-F.col("rate"))).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("rate") / k.cast("double")
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    return rated.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), top), start, step, lambda acc: acc["cdf"]))


def mix_sources(
    documents: DataFrame, weights: dict[str, float] | None = None, seed: int = 0, power: float = 0.5, size: float = 1.0
) -> DataFrame:
    """Documents, each as often as drawn, with copy (from 1) and shuffle_key, in the order of the key."""
    kept = [c for c in documents.columns if c.lower() not in ("copy", "shuffle_key")]
    documents = documents.select(*kept)
    table = store(rates(documents, weights, power, size), "mixing-rates").withColumnRenamed("source", "rate_source")
    doc_key = F.col("doc_id").cast("string")
    drawn = documents.join(table, F.col("source").eqNullSafe(F.col("rate_source")))

    def draw(*more: Column) -> Column:
        spot = uniform(F.lit(str(seed)), doc_key, *more)
        return F.size(F.filter("cdf", lambda c: c < spot))

    # Each further draw has a hash of its own.
    further = F.sequence(F.lit(2), F.col("draws"))
    several = F.aggregate(further, draw(), lambda n, k: n + draw(F.concat(F.lit("draw "), k.cast("string"))))
    drawn = drawn.withColumn("count", F.when(F.col("draws") > 1, several).otherwise(draw()))
    copies = drawn.where("count > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("count"))).alias("copy"))
    key = F.md5(F.concat_ws("|", F.lit(f"order {seed}"), doc_key, F.col("copy").cast("string")))
    return copies.withColumn("shuffle_key", key).orderBy("shuffle_key")


ORACLE_SQL = f"""
WITH RECURSIVE sizes AS (SELECT source, CAST(coalesce(sum(length(text)), 0) AS DOUBLE) AS chars FROM documents GROUP BY source),
rated AS (SELECT source, CASE WHEN chars > 0 THEN 1.0 * pow(chars, 0.5) / (SELECT sum(pow(chars, 0.5)) FROM sizes WHERE chars > 0)
        * (SELECT sum(chars) FROM sizes) / chars ELSE 1.0 END AS rate FROM sizes),
cdf(source, rate, k, p, c) AS (
    SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rated
    UNION ALL
    SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 20)),
steps AS (SELECT source, list(c ORDER BY k) AS cs FROM cdf GROUP BY source),
drawn AS (SELECT d.doc_id, d.source, len(list_filter(cs, lambda c: c <
        (CAST('0x' || substr(md5('8|' || d.doc_id), 1, {HEX_DIGITS}) AS BIGINT) + 0.5) / {SPAN:.1f})) AS n
    FROM documents d JOIN steps s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, md5('order 8|' || doc_id || '|' || copy) AS shuffle_key
FROM (SELECT doc_id, source, unnest(range(1, n + 1)) AS copy FROM drawn)
"""
