"""The corpus pipeline: quality rules, language identification, near-duplicate removal and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from regolith.llm import langid, neardup, packing, quality
from regolith.llm.common import small_batches, stored, table
from regolith.scratch import cleared, written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules and the perplexity bands keep."""
    small_batches(spark)
    return quality.kept_documents(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined, by a model of the documents that reach this stage."""
    small_batches(spark)
    return langid.known_documents(docs)


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return neardup.distinct_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences."""
    small_batches(spark)
    return packing.packed_documents(docs)


STAGES = [("quality", quality_stage), ("language", language_stage), ("neardup", neardup_stage), ("packing", packing_stage)]

#: No stage but the base rules can be said in SQL; the tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written as Parquet and read again by the next. What a stage
    has written besides, and the rows of the stage before it, are deleted then."""
    docs, mark = table(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        cleared(spark, mark, docs)
    return docs
