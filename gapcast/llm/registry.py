"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from gapcast.llm import maxent, minhash, mixing, multi_index, onebit, packing, periodic_runs, prefix_trie, suffixes, templates, topk, toxicity, url_lists
from gapcast.llm.textbytes import bounded_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in ("documents", "pages"):
        bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.evaluate(url_lists.page_captures(pages), url_lists.page_events(pages))


def op2_multi_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Passages of some fifty words are shorter than what is cut, so they are counted.
    return suffixes.dedup(table(spark, sf_dir, "documents"), marked=(corpus_pipeline.PASSAGE, corpus_pipeline.GRAM)).drop("kept_text")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_html_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return templates.extract(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op8_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), seed=8)
    return mixed.select("doc_id", "source", "copy", "shuffle_key")


def op9_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score(table(spark, sf_dir, "documents"))


def op10_norm_bucket_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.summary(table(spark, sf_dir, "documents"))


def op12_onebit_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return onebit.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Query]:
    found = {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}
    return {**found, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = {"op1_url_lists": url_lists.ORACLE_SQL, "op8_poisson_mixing": mixing.ORACLE_SQL, "op13_prefix_trie": prefix_trie.ORACLE_SQL}
    if corpus_pipeline.ORACLE_SQL is not None:
        sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
