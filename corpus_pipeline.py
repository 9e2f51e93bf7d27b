"""The corpus pipeline: quality rules, language identification, near-duplicate removal and packing.

Each stage takes the documents that its predecessor kept; all but the last return them
with all their columns.  ``run`` writes every stage's result to the shared folder and
reads it back, so a stage never runs twice.

A null text has no words and goes with the quality rules; null hosts have no verdict; a
null doc_id counts as the empty text in folds, and such documents are kept or go by
their texts; of equal rows one stays; columns of any name are carried along; of an
empty table, or one of which nothing is kept, nothing is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.llm import language_id, near_dedup, packing, quality_rules
from quillspan.llm.common import materialize
from quillspan.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no base rule and no host verdict rejects."""
    return quality_rules.quality_filter(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some language that the network is sure enough of."""
    return language_id.language_filter(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dedup.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in the sequences."""
    return packing.pack(docs, vocabulary())


STAGES = [("quality rules", quality), ("language ID", language), ("near dedup", dedup), ("packing", pack)]
#: The network of the second stage and the token ids of the last can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
