"""The corpus pipeline: documents to packed training windows, one operator a stage.

Each stage reads all that its predecessor kept. All but the last return the columns of documents, whatever further
columns there are and whatever they are called. Nulls, empty, blank and very long texts, ties, repeated rows and an
empty table have the results that the operators' docstrings state; an empty table gives no windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from souk.llm import exact, neardup, packing, quality, secrets
from souk.llm.shared import drop, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the compression bands; the others go, null, empty and blank texts among them."""
    return quality.keep(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each text; null texts all stay."""
    return exact.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; texts without words all stay."""
    return neardup.keep(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, confirmed secrets replaced by their kind and the size set anew."""
    return secrets.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The fragments that fill the training windows; documents without tokens have none."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("pack_windows", pack_windows),
]

#: Compression ratios, near duplicates by sketches and decoded secrets have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder, read again by the next and then dropped."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
        drop(*written)
        written = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
