"""A training corpus from documents: language ID, exact dedup, near dedup, decontamination, packing.

Every stage works on all rows its predecessor kept. All but the last return the columns of documents. Between stages rows
are a work table in the shared folder, which cuts lineage; a stage's table goes once the next one's is written.

Defined results: a null or empty text, and one whose language the model rejects, goes at the first stage. Rows that repeat
a document are one after the second. Of equal texts the row with the largest doc_id stays, of a class of near
duplicates the one with the smallest. Texts are read whole, whatever their length. An empty table gives no pieces.
Columns besides doc_id, text and lang are carried along, whatever their names, up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ratelens.llm import decontam, exactdedup, langid, neardup, packing
from ratelens.llm.common import discard, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model accepts."""
    return langid.accepted(docs, langid.fit(langid.training_rows(docs)))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exactdedup.distinct_rows(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the smallest doc_id."""
    return neardup.distinct_rows(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark items don't contaminate."""
    return decontam.clean_rows(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens."""
    return packing.packed(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("decontamination", decontamination), ("packing", pack)]

#: SQL can't express language ID, near dedup and packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(before)  # the documents table itself isn't a work table, and stays
    return STAGES[-1][1](spark, docs, sf_dir)
