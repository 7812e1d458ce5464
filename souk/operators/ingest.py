"""Batch ingestion: technical envelope, quarantine, idempotent load and audit."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.functions.columns import record_hash
from souk.sources.contracts import Contract, schema_of
from souk.sources.files import CORRUPT, read_csv
from souk.sources.store import TableStore

AUDIT = schema_of("run_id string, source_name string, target string, source_file_hash string, status string, started_at timestamp, ended_at timestamp, rows_quarantined bigint, rows_written bigint, rows_read bigint, error_message string")
ERROR_CHARS = 4000


@dataclass(frozen=True)
class Audit:
    run_id: str
    source_name: str
    target: str
    source_file_hash: str
    status: str
    started_at: datetime
    ended_at: datetime
    rows_quarantined: int = 0
    rows_written: int = 0
    rows_read: int = 0
    error_message: str | None = None


def append_audit(store: TableStore, audit: Audit, name: str = "ctl_ingestion_audit") -> None:
    store.append(name, store.spark.createDataFrame([tuple(asdict(audit).values())], AUDIT))


def enrich(df: DataFrame, contract: Contract, run_id: str, file_hash: str, at: datetime, source_file=None) -> DataFrame:
    """``df`` with the record's hash over the contract's columns and where, when and by which run it came."""
    return df.withColumns(
        {
            "_record_hash": record_hash(contract.columns),
            "_source_file": F.lit(None).cast("string") if source_file is None else source_file,
            "_source_file_hash": F.lit(file_hash),
            "_run_id": F.lit(run_id),
            "_ingested_at": F.lit(at),
            "_ingestion_date": F.lit(at.date()),
            "_source_name": F.lit(contract.name),
        }
    )


def split(df: DataFrame, required: list[str], identity: list[str]) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantined): malformed rows, then rows lacking a required value, then repeats.

    Of rows with the same identity one is valid, and one stands in quarantine for the repeats with their number.
    """
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(c).isNull()
    malformed = F.col(CORRUPT).isNotNull() if CORRUPT in df.columns else F.lit(False)
    judged = df.withColumn("_quarantine_reason", F.when(malformed, "MALFORMED_RECORD").when(lacking, "MISSING_REQUIRED_FIELD"))
    same = W.partitionBy(*identity)
    numbered = judged.filter("_quarantine_reason is null").withColumn("_copy", F.row_number().over(same.orderBy(*identity))).withColumn("_duplicate_count", F.count("*").over(same))
    valid = numbered.filter("_copy = 1").drop("_quarantine_reason", "_copy", "_duplicate_count")
    repeats = numbered.filter("_copy = 2").drop("_copy").withColumn("_quarantine_reason", F.lit("DUPLICATE_RECORD"))
    return valid, judged.filter("_quarantine_reason is not null").unionByName(repeats, allowMissingColumns=True)


def ingest(spark: SparkSession, store: TableStore, path: str, contract: Contract, file_hash: str, run_id: str, target: str | None = None, quarantine: str = "bronze_quarantine", now: datetime | None = None) -> Audit:
    """Loads a file into its bronze table; a second run of the same file writes nothing. The audit is written on failure, too."""
    started, target = now or datetime.now(UTC), target or f"bronze_{contract.name}"
    try:
        raw = read_csv(spark, path, contract)
        rich = enrich(raw.withColumn("_file", F.col("_metadata.file_path")), contract, run_id, file_hash, started, F.col("_file")).drop("_file").persist()
        try:
            valid, bad = split(rich, contract.required, ["_source_file_hash", "_record_hash"])
            payload = F.to_json(F.struct(*[c for c in contract.columns]))
            kept = bad.select("_source_name", "_source_file", "_source_file_hash", "_record_hash", "_quarantine_reason", payload.alias("_payload"), F.col(CORRUPT).alias("_raw"), "_duplicate_count", "_run_id", "_ingested_at", "_ingestion_date")
            # one pass over the source, whatever the number of reasons
            read, quarantined = rich.count(), bad.count()
            store.insert_absent(quarantine, kept, ["_source_file_hash", "_record_hash", "_quarantine_reason"])
            written = store.insert_absent(target, valid.drop(CORRUPT), ["_source_file_hash", "_record_hash"])
        finally:
            rich.unpersist()
        audit = Audit(run_id, contract.name, target, file_hash, "SUCCEEDED", started, datetime.now(UTC), quarantined, written, read)
    except Exception as e:
        append_audit(store, Audit(run_id, contract.name, target, file_hash, "FAILED", started, datetime.now(UTC), error_message=f"{type(e).__name__}: {e}"[:ERROR_CHARS]))
        raise
    append_audit(store, audit)
    return audit
