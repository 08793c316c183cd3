"""Training-data pipeline over ``documents``: five stages, each one of the operators of ``pricefold.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet to the shared folder and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricefold.llm import decontaminate, mixing, near_dup, pii, toxicity
from pricefold.llm.common import stored, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel model rejects (score 0.5 or more) go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest doc_id."""
    return near_dup.deduplicated(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item (three quarters of its shingles) go."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Validated numbers and dates, and mail addresses, become pseudonyms; n_chars follows the text."""
    out = pii.pseudonymise(docs).select(*[F.col(f"`{c}`") for c in docs.columns])
    if "n_chars" in out.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.coalesce(F.length("text"), F.col("n_chars")).cast(kind)))
    return out


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are replicated to shares that follow the square root of their size, and shuffled."""
    return mixing.mixed_corpus(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("pii", pseudonymised),
    ("mixing", mixed),
]

#: SQL cannot express the toxicity model; tests/llm compares the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
