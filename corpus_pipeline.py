"""The corpus pipeline: quality classifier, exact dedup, n-gram Jaccard join, source mixing, packing.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and works on all that its
predecessor kept. ``run`` applies them to ``documents``, writing every stage's result as Parquet
into the shared checkpoint folder and reading it again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm import exact_dedup, jaccard, mixing, packing, quality
from ledgerspark.llm.common import DOCUMENT_COLUMNS, staged
from ledgerspark.sources.tables import read_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose probability of the best grade is low (junk, toxic texts)."""
    return quality.select_good(docs, read_table(spark, sf_dir, "labels")).select(*DOCUMENT_COLUMNS)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.drop_duplicates(docs, stable_id=-F.col("doc_id")).select(*DOCUMENT_COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every component of near copies the document with the smallest id stays."""
    return jaccard.one_per_group(docs).select(*DOCUMENT_COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources re-weighted by the square root of their size; a document may repeat or go."""
    return mixing.mix(docs).select(*DOCUMENT_COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and place; every repeat of a document is packed."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources", mixing_stage),
    ("best-fit packing", packing_stage),
]

# SQL expresses neither the trained classifier nor the packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{k}")
    return docs
