"""A training corpus in five stages: quality, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last
return the columns of documents. Between stages, run() writes Parquet in the shared folder and reads it
again. SQL can't express the stages; tests hold each of them against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, minhash, mixing, pii, quality
from larkspur.llm.common import durable, scratch, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.5 or more."""
    return quality.accept(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of smallest id."""
    return minhash.deduplicated(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars follows the new text."""
    length = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return pii.redact(docs).withColumn("n_chars", length).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the balanced mix takes them."""
    return mixing.mixed(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    return bpe.encode(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_copies),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: No stage can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage writes on its way goes when its result is written."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        with scratch(spark):
            docs = durable(stage(spark, docs, sf_dir), kept=True)
    return STAGES[-1][1](spark, docs, sf_dir)
