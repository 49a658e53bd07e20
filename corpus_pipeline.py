"""A training-data pipeline over the documents table: filter by language and quality, drop near copies, mix, pack.

Each stage is a function of (spark, docs, sf_dir). ``run`` writes what a stage returns as Parquet into the folder
that the executors share, and reads it again for the next stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldra.llm import language, mixing, packing, quality, simhash
from veldra.llm.scratch import Scratch, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language, or clearly in another than the declared one."""
    return language.keep_identified(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the positive-unlabelled classifier rejects."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the least doc_id of each group of near copies."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources and languages reach their target shares of tokens."""
    return mixing.mix(docs)


def packing_order(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lays the documents out along the Hilbert curve and cuts them into sequences."""
    return packing.pack(docs)


STAGES = [
    ("language ID", language_id),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", simhash_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", packing_order),
]
#: SQL can express neither the classifier's training nor Newton's method; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        since = len(Scratch.roots)
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{k}", "zstd")
        Scratch.sweep(since)
        if k:
            scratch.drop(f"stage-{k - 1}")
    return docs
