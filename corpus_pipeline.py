"""A corpus from raw documents to packed training sequences: quality rules, near duplicates, benchmark passages, secrets,
packing. Each stage works on all that the one before kept, and is written as Parquet and read again.

Every stage keeps the columns of documents, whatever they are; the last returns pieces of sequences. No stage needs
doc_id to be unique or set. An empty table runs through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, row_key, table, without
from tessera.llm.decontam import decontaminate
from tessera.llm.jaccard import keep_one
from tessera.llm.packing import pack
from tessera.llm.quality_rules import filter_quality
from tessera.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality rules reject."""
    return filter_quality(spark, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that of the smallest doc_id."""
    return keep_one(spark, docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of a benchmark item."""
    found = decontaminate(spark, docs.select(row_key(docs, "text").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark"))
    return without(docs, Scratch(spark, "benchmark").write(found.where("contaminated").select(F.col("doc_id").alias("key")).distinct(), "gone"), "text")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences."""
    return pack(docs)


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("decontamination", benchmark), ("secret_scan", secrets), ("packing", packing)]

#: Token ids and packing are beyond SQL; tests/llm hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return docs
