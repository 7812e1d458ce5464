"""The training-data operators over the driver's tables, with production parameters; SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from souk.llm import chunks, exact, html, lm, neardup, packing, pieces, quality, secrets, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, duplicate_of) of every near copy."""
    return neardup.links(_table(spark, sf_dir, "documents"))


def secret_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every confirmed secret."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The compression score of every document; in-domain: labelled of quality."""
    return lm.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, duplicate_of) of every exact copy."""
    return exact.duplicates(_table(spark, sf_dir, "documents"))


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.extracted(_table(spark, sf_dir, "pages"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, source_doc_id, span) of every passage that an earlier document has."""
    return chunks.repeats(_table(spark, sf_dir, "documents"))


def capture_histories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every capture of every page in global order."""
    return warc.histories(_table(spark, sf_dir, "pages"))


def encoded_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every document, and whether they decode to its text."""
    return pieces.encoded(_table(spark, sf_dir, "documents"))


def packed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of all documents that fill the windows."""
    return packing.pack(_table(spark, sf_dir, "documents"))


def quality_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their ratios."""
    return quality.assess(_table(spark, sf_dir, "documents")).filter("reason is null").select("doc_id", "ratio", "chunk_low", "chunk_high")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": near_duplicates,
    "op2_secret_findings": secret_findings,
    "op3_lm_scores": lm_scores,
    "op4_exact_duplicates": exact_duplicates,
    "op5_page_texts": page_texts,
    "op6_repeated_passages": repeated_passages,
    "op7_capture_histories": capture_histories,
    "op8_encoded_documents": encoded_documents,
    "op9_packed_windows": packed_windows,
    "op10_quality_kept": quality_kept,
}

ORACLES: dict[str, str] = {
    "op4_exact_duplicates": """
        SELECT doc_id, duplicate_of FROM (
            SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS duplicate_of,
                   row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n
            FROM documents WHERE text IS NOT NULL)
        WHERE n > 1""",
    "op7_capture_histories": warc.HISTORY_SQL,
}
