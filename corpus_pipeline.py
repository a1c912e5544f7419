"""A corpus pipeline: one operator of dispatchlake.llm per stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dispatchlake.llm import exact, ngrams, packing, pii, quality
from dispatchlake.llm.common import rows_of, rows_once, staged, tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return rows_of(docs, quality.judge(docs).where("kept"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return rows_once(docs, exact.deduplicate(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each component of linked ones."""
    return rows_of(docs, ngrams.link(docs).where("component_id <=> doc_id"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 4096 tokens, with their ids."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, capacity=4096)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("pii", mask_personal_data), ("packing", pack)]

#: Contexts of personal data and the differencing of windows are beyond SQL; the tests hold each stage against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage returns is written before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
