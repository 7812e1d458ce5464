"""Typed CSV, archives and manifests, JSON lines, and Kafka-shaped streams."""

from __future__ import annotations

import csv
import hashlib
import json
import re
import zipfile
from datetime import UTC, datetime
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.sources.contracts import CONTRACTS, Contract, schema_of

CORRUPT = "_corrupt_record"
ENVELOPE = schema_of("value string, topic string, partition bigint, offset bigint, timestamp timestamp")


def read_csv(spark: SparkSession, path: str, contract: Contract) -> DataFrame:
    """The file with the contract's types, after its header was checked; rows that don't parse are in ``_corrupt_record``."""
    header = spark.read.option("header", True).option("inferSchema", False).csv(path)
    contract.check_header(header.columns)
    options = {"header": True, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "timestampFormat": "yyyy-MM-dd HH:mm:ss", "enforceSchema": True, "encoding": "UTF-8", "multiLine": False, "escape": '"'}
    return spark.read.schema(contract.schema(CORRUPT)).options(**options).csv(path)


def read_parquet(spark: SparkSession, *globs: str) -> DataFrame:
    """Files matched by the globs, their columns united by name."""
    return spark.read.option("mergeSchema", True).parquet(*globs)


def order_ids(spark: SparkSession, path: str, column: str = "order_id") -> DataFrame:
    """The distinct non-blank order ids of a CSV file."""
    df = spark.read.option("header", True).csv(path)
    if column not in df.columns:
        raise ValueError(f"{path} has no column {column}")
    return df.select(F.trim(column).alias("order_id")).filter("order_id <> ''").distinct()


def extract(archive: str | Path, target: str | Path) -> list[Path]:
    """The known source files of a ZIP archive, flat into ``target``. Raises on a path that leaves it, a repeated or a missing file."""
    target, wanted, found = Path(target), {c.file for c in CONTRACTS.values()}, {}
    with zipfile.ZipFile(archive) as z:
        for info in z.infolist():
            path = PurePosixPath(info.filename.replace("\\", "/"))
            if path.is_absolute() or ".." in path.parts:
                raise ValueError(f"unsafe path in the archive: {info.filename}")
            if path.name in wanted and not info.is_dir():
                if path.name in found:
                    raise ValueError(f"{path.name} is in the archive twice")
                found[path.name] = info
        if missing := sorted(wanted - found.keys()):
            raise ValueError(f"the archive lacks {', '.join(missing)}")
        target.mkdir(parents=True, exist_ok=True)
        for name, info in found.items():
            with z.open(info) as source, (target / name).open("wb") as out:
                while block := source.read(1 << 20):
                    out.write(block)
    return [target / n for n in sorted(found)]


def sha256_file(path: Path) -> str:
    with path.open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def manifest(folder: str | Path, dataset: str = "olist") -> dict:
    """Every file under the folder, sorted: path, SHA-256, size and, of CSV files, rows without the header."""
    folder, files = Path(folder), []
    for p in sorted(x for x in folder.rglob("*") if x.is_file() and x.name != "_manifest.json"):
        rows = None
        if p.suffix == ".csv":
            with p.open(newline="", encoding="utf-8") as f:
                rows = max(0, sum(1 for _ in csv.reader(f)) - 1)
        files.append({"path": p.relative_to(folder).as_posix(), "sha256": sha256_file(p), "bytes": p.stat().st_size, "rows": rows})
    return {"dataset": dataset, "generated_at": datetime.now(UTC).isoformat(), "files": files}


def manifest_hashes(m: dict, dataset: str = "olist") -> dict[str, str]:
    """{source: SHA-256}; raises unless the manifest is the dataset's, complete and well-formed."""
    if m.get("dataset") != dataset:
        raise ValueError(f"the manifest is of {m.get('dataset')!r}, not {dataset!r}")
    by_name = {PurePosixPath(f["path"]).name: f["sha256"] for f in m["files"]}
    if missing := sorted(c.file for c in CONTRACTS.values() if c.file not in by_name):
        raise ValueError(f"the manifest lacks {', '.join(missing)}")
    if bad := sorted(c.file for c in CONTRACTS.values() if len(h := by_name[c.file]) != 64 or re.search("[^0-9a-f]", h)):
        raise ValueError(f"no SHA-256: {', '.join(bad)}")
    return {c.name: by_name[c.file] for c in CONTRACTS.values()}


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", **options: str) -> DataFrame:
    """A topic as a stream; losing data fails the query. Needs Spark's Kafka package."""
    settings = {"subscribe": topic, "kafka.bootstrap.servers": servers, "failOnDataLoss": "true", "startingOffsets": starting}
    return spark.readStream.format("kafka").options(**settings, **options).load()


def file_stream(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A folder of JSON lines in the envelope that a topic has: value, topic, partition, offset, timestamp."""
    reader = spark.readStream.schema(ENVELOPE)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).json(folder)


def to_envelope(events: DataFrame, topic: str, key: str) -> DataFrame:
    """Events as (key, value: JSON, topic, ...) rows, to be written to a topic or as JSON lines; raises on an empty key."""
    good = F.when(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""), F.raise_error(F.lit(f"an event without {key}"))).otherwise(F.col(key).cast("string"))
    value = F.to_json(F.struct(*events.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSXXX"})
    return events.select(good.alias("key"), value.alias("value"), F.lit(topic).alias("topic"), F.lit(0).cast("long").alias("partition"), F.lit(0).cast("long").alias("offset"), F.lit(datetime(2026, 1, 1)).alias("timestamp"))


def publish(events: DataFrame, topic: str, key: str, servers: str | None = None, folder: str | None = None) -> None:
    """To a topic (idempotent, acknowledged by all replicas, zstd) or, for a file stream, as JSON lines into a folder."""
    rows = to_envelope(events, topic, key)
    if servers:
        settings = {"kafka.bootstrap.servers": servers, "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "zstd"}
        rows.select("key", "value", "topic").write.format("kafka").options(**settings).save()
    elif folder:
        rows.drop("key").write.mode("append").json(folder)
    else:
        raise ValueError("neither servers nor a folder")


def write_events(events: DataFrame, folder: str, partitions: int, order: str = "occurred_at") -> None:
    """JSON lines in as many files, spread by event time."""
    events.repartition(partitions, order).write.mode("overwrite").json(folder)


def write_snapshot(snapshot: dict, path: str | Path) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with Path(path).open("w", encoding="utf-8") as out:
        json.dump(snapshot, out, indent=1, ensure_ascii=False)
