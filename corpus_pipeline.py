"""A training-corpus pipeline: toxicity, near duplicates, benchmark leaks, personal data, source mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; what it returns is written as Parquet
and read again. All but the last return the columns of documents. Each first lets go what the one before no longer needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import decontaminate, jaccard, mixing, pii, toxicity
from tidebook.llm.shared import discard, materialize, release


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, flags go."""
    release(spark)
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are alike, directly or by others, the one with the smallest id stays."""
    release(spark)
    return jaccard.distinct_documents(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item lies go."""
    release(spark)
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; personal data in it is replaced by its kind."""
    release(spark)
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The copies of documents that fill each leaf's token budget."""
    release(spark)
    return mixing.selected(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

#: A trained classifier decides what goes on: no SQL says the same.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        discard(*written)  # the stage's input, once its output is written
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
