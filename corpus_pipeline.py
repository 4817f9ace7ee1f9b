"""A training corpus from ``documents`` in five stages, each written as Parquet and read again by the next.

Defined results: null texts count as empty; repeated rows are copies, of which exact dedup leaves one; rows of one doc_id with
different texts are different documents; rows without doc_id are judged, deduplicated and mixed like others, but belong to no group
of near copies; an empty table gives an empty corpus; further columns, whatever their names, are carried up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from playloom.llm import bpe, exact_dedup, jaccard, mixing, quality
from playloom.shared import materialize, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (operator 10)."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 2)."""
    return exact_dedup.dedup(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (operator 4)."""
    return jaccard.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of the sources takes it (operator 7)."""
    return mixing.mix(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes (operator 9)."""
    return bpe.annotate(docs)


STAGES = [
    ("quality", quality_filter),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard", jaccard_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: SQL cannot express the trained classifier nor the tokenizer; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
