"""The training-data pipeline: stages over documents, each written as Parquet and read by the next.

Every stage but the last returns the columns of documents; repeated and null doc_ids, null
texts and extra columns pass through as the operators' docstrings say. A stage whose
input has been written deletes the intermediate tables of the stages before it, as in ``run``;
results that were not written must be by then.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapcast.llm import minhash, mixing, packing, suffixes, toxicity
from gapcast.llm.textbytes import bounded_batches
from gapcast.plans.scratch import drop_stored, store, stored_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Words of a shingle in the near-copy stage; four are for the op4 query alone.
SHINGLE = 5
#: Bytes of a passage that may stand once: fifty words of four letters and a space. The 400 bytes of the op3 query are some sixty-five words.
PASSAGE = 250
GRAM = 64

_left: list[str] = []


def _written(docs: DataFrame) -> bool:
    """Whether ``docs`` is read from files that are no stage's intermediate tables."""
    leaves = docs._jdf.queryExecution().optimizedPlan().collectLeaves()
    kinds = {leaves.apply(i).getClass().getSimpleName() for i in range(leaves.size())}
    own = [p.removeprefix("file:").lstrip("/") for p in _left]
    return kinds == {"LogicalRelation"} and not any(p in f for f in docs.inputFiles() for p in own)


def stage(function: Stage) -> Stage:
    """``function`` without the intermediate tables that earlier stages have left, if its input has been written."""

    @functools.wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if _written(docs):
            drop_stored(spark, _left)
            _left.clear()
        before = set(stored_paths())
        out = function(spark, docs, sf_dir)
        _left.extend(p for p in stored_paths() if p not in before)
        return out

    return run_stage


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised model does not reject."""
    bounded_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rest = tuple(c for c in docs.columns if c != "doc_id")
    judged = toxicity.score(docs, toxicity.fit(docs, labels), keep=rest)
    return judged.where("predicted = 0").select(*docs.columns)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, one with the smallest doc_id; rows without doc_id count as well."""
    bounded_batches(spark)
    rows = store(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*docs.columns).alias("of")), "rows")
    texts = rows.select("row", F.col("of.doc_id").cast("bigint").alias("doc_id"), F.col("of.text").alias("text"))
    copies = minhash.judged(texts, SHINGLE).where("NOT kept").select("row")
    return rows.join(copies, "row", "left_anti").select("of.*")


@stage
def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without the byte strings that stand elsewhere too; n_chars is counted anew."""
    bounded_batches(spark)
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffixes.dedup(docs, PASSAGE, GRAM, keep=rest).withColumn("text", F.col("kept_text"))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


@stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's weight asks for, in shuffled order."""
    return mixing.mix_sources(docs).select(*docs.columns)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences and offsets."""
    bounded_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeats", cut_repeats),
    ("mixing", mix),
    ("packing", pack),
]
#: Sketches, suffix arrays, a fitted model and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
