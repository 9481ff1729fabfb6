"""From documents to packed training sequences, in five stages.

Each stage is one operator of ``roadpulse.llm``; its result is written as
Parquet in the cluster's shared folder and read again as the next one's input.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadpulse.llm.common import table, written
from roadpulse.llm.mixing import mixed_documents
from roadpulse.llm.packing import pack
from roadpulse.llm.quality import good_documents
from roadpulse.llm.simhash import one_of_each
from roadpulse.llm.toxicity import clean_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return good_documents(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group: its smallest id."""
    return one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("simhash_dedup", dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: fitted classifiers, fingerprints and tokens are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
