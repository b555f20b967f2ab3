"""A corpus pipeline of five stages over `documents`.

toxicity rejects toxic documents; exact dedup keeps one of equal texts; SimHash near-dedup keeps
one of each near-duplicate group; mixing repeats or drops documents to meet the sources' target
weights; the last stage encodes every text to pieces and proves that they decode to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineloom.llm import exact_dedup, mixing, simhash, toxicity, unigram
from lineloom.llm.common import spool


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_one(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def in_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return unigram.piece_rows(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("mixing", mixed),
    ("sentencepiece", in_pieces),
]

#: The stages train a model, solve for weights and hash with XXH64: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; every stage is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
