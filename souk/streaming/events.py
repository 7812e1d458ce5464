"""Delivery and click streams: parse, classify, split, keep each event once."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from souk.sources.contracts import CLICK_EVENT, CLICK_TYPES, DELIVERY_EVENT, DELIVERY_RANKS, EVENT_VERSION, schema_of
from souk.sources.store import TableStore

BAD = "_malformed"
STAMP = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX"
KAFKA = {"topic": "_kafka_topic", "partition": "_kafka_partition", "offset": "_kafka_offset", "timestamp": "_kafka_timestamp"}


def _parse(stream: DataFrame, schema: T.StructType, required: list[str], rules: list[tuple[Column, str]]) -> DataFrame:
    """The envelope's columns, the parsed ``event`` and the first reason that holds, null for a valid event.

    Malformed JSON is told from a well-formed event that lacks fields by the parser's own column for it.
    """
    known = T.StructType([*schema.fields, T.StructField(BAD, T.StringType())])
    options = {"timestampFormat": STAMP, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}
    base = stream.select(*[F.col(a).alias(b) for a, b in KAFKA.items()], stream["value"].cast("string").alias("_raw_payload"))
    parsed = base.withColumn("_parsed", F.from_json("_raw_payload", known, options))
    # a value of the wrong type makes the parser keep the text too; it is malformed only if it isn't an object at all
    shapeless = F.col("_parsed").isNull() | (F.col(f"_parsed.{BAD}").isNotNull() & F.try_parse_json("_raw_payload").isNull())
    lacking = F.lit(False)
    for c in required:
        lacking = lacking | F.col(f"event.{c}").isNull()
    reason = F.when(F.col("_shapeless"), "INVALID_JSON").when(lacking, "MISSING_REQUIRED_FIELD").when(~F.col("event.schema_version").eqNullSafe(EVENT_VERSION), "UNSUPPORTED_SCHEMA_VERSION")
    for broken, name in rules:
        reason = reason.when(broken, name)
    event = F.struct(*[F.col(f"_parsed.{f.name}").alias(f.name) for f in schema.fields])
    return parsed.withColumn("_shapeless", shapeless).withColumn("event", event).drop("_parsed").withColumn("_quarantine_reason", reason).drop("_shapeless")


def parse_delivery(stream: DataFrame) -> DataFrame:
    rules = [
        (~F.coalesce(F.col("event.status").isin(*DELIVERY_RANKS), F.lit(False)), "INVALID_STATUS"),
        (~F.coalesce(F.regexp_like("event.location_state", F.lit("^[A-Z][A-Z]$")), F.lit(True)), "INVALID_STATE"),
    ]
    return _parse(stream, DELIVERY_EVENT, ["event_id", "order_id", "occurred_at", "produced_at", "sequence_number"], rules)


def parse_clicks(stream: DataFrame) -> DataFrame:
    rules = [(~F.coalesce(F.col("event.event_type").isin(*CLICK_TYPES), F.lit(False)), "INVALID_EVENT_TYPE")]
    return _parse(stream, CLICK_EVENT, ["event_id", "user_id", "occurred_at"], rules)


def valid(parsed: DataFrame) -> DataFrame:
    """The events without a reason, their fields and where they came from."""
    return parsed.filter("_quarantine_reason is null").select("event.*", *KAFKA.values())


def quarantined(parsed: DataFrame) -> DataFrame:
    """The others, as received."""
    return parsed.filter("_quarantine_reason is not null").drop("event")


def once_within(events: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Each event_id once while its state is held; later than the watermark it is dropped. State is evicted with the watermark."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def trigger(writer, mode: str, interval: str = "30 seconds"):
    """``available_now``: what there is, then stop; ``continuous``: a batch every interval."""
    modes = {"continuous": {"processingTime": interval}, "available_now": {"availableNow": True}}
    if mode not in modes:
        raise ValueError(f"unknown trigger {mode!r}")
    return writer.trigger(**modes[mode])


def start(stream: DataFrame, parse: Callable[[DataFrame], DataFrame], store: TableStore, target: str, quarantine: str, checkpoint: str, run_id: str, mode: str = "available_now", name: str | None = None, watermark: str | None = None, interval: str = "30 seconds", within: str | None = None) -> StreamingQuery:
    """One query that reads the source once and feeds both tables.

    Valid events are inserted if their event_id is absent, quarantined ones if their place in the topic is; so a
    batch that runs again, or a duplicate however late, adds nothing, and nothing is dropped as too late. With
    ``watermark`` duplicates are dropped by state before that, and events beyond it with them. Without ``within`` each
    batch reads all event ids of the table; with it (an interval, "7 DAYS") those that occurred at most so long before
    the batch's first event, and copies that lie further apart are kept.
    """
    parsed = parse(stream)
    if watermark:
        parsed = parsed.withColumn("_at", F.col("event.occurred_at")).withColumn("_id", F.coalesce("event.event_id", F.concat_ws("/", "_kafka_topic", "_kafka_partition", "_kafka_offset")))
        parsed = parsed.withWatermark("_at", watermark).dropDuplicatesWithinWatermark(["_id"]).drop("_at", "_id")

    def both(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            stamp = {"_run_id": F.lit(run_id), "_micro_batch_id": F.lit(batch_id).cast("long"), "_ingested_at": F.current_timestamp()}
            store.insert_absent(target, valid(batch).withColumns(stamp), ["event_id"], within=within and ("occurred_at", within))
            store.insert_absent(quarantine, quarantined(batch).withColumns(stamp), ["_kafka_topic", "_kafka_partition", "_kafka_offset", "_raw_payload"], within=within and ("_kafka_timestamp", within))
        finally:
            batch.unpersist()

    writer = parsed.writeStream.queryName(name or target).option("checkpointLocation", checkpoint).foreachBatch(both)
    return trigger(writer, mode, interval).start()


def supervise(store: TableStore, streams: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]], checkpoints: str, run_id: str, mode: str = "available_now", **how) -> str:
    """Starts a query for each source (its stream and parser), each into ``bronze_`` and ``quarantine_`` tables of its name, and awaits
    them all; see ``start`` and ``await_and_record``. If one can't be started, those running are stopped.
    """
    queries: dict[str, StreamingQuery] = {}
    try:
        for source, (stream, parse) in streams.items():
            queries[source] = start(stream, parse, store, f"bronze_{source}", f"quarantine_{source}", f"{checkpoints}/{source}", run_id, mode, **how)
    except Exception:
        for q in queries.values():
            q.stop()
        raise
    return await_and_record(store, queries, run_id)


@dataclass(frozen=True)
class Outcome:
    run_id: str
    query_name: str
    query_id: str
    source: str
    status: str
    recorded_at: datetime
    input_rows: int
    batch_id: int | None
    processed_rows_per_second: float
    input_rows_per_second: float
    error_message: str | None = None


OUTCOMES = schema_of("run_id string, query_name string, query_id string, source string, status string, recorded_at timestamp, input_rows bigint, batch_id bigint, processed_rows_per_second double, input_rows_per_second double, error_message string")


def outcome(query: StreamingQuery, run_id: str, source: str) -> Outcome:
    """What a query did: the rows of all its recent batches, the rates of its last one, its error if it failed."""
    last, error = query.lastProgress or {}, query.exception()
    rows = sum(int(p["numInputRows"] or 0) for p in query.recentProgress)
    rates = [float(last[k] if last and last[k] is not None else 0.0) for k in ("processedRowsPerSecond", "inputRowsPerSecond")] if last else [0.0, 0.0]
    return Outcome(run_id, query.name, str(query.id), source, "FAILED" if error else "SUCCEEDED", datetime.now(UTC), rows, last["batchId"] if last else None, *rates, str(error)[:4000] if error else None)


def await_and_record(store: TableStore, queries: dict[str, StreamingQuery], run_id: str, name: str = "ctl_streaming_runs") -> str:
    """Waits for all queries (by source), stops the others if one fails, records every outcome, then raises or returns a summary."""
    failed: Exception | None = None
    for q in queries.values():
        try:
            q.awaitTermination()
        except Exception as e:
            failed = e
            for other in queries.values():
                if other.isActive:
                    other.stop()
            break
    outcomes = [outcome(q, run_id, s) for s, q in queries.items()]
    store.append(name, store.spark.createDataFrame([tuple(asdict(o).values()) for o in outcomes], OUTCOMES))
    bad = [o.query_name for o in outcomes if o.status == "FAILED"]
    if bad or failed:
        raise RuntimeError(f"streaming queries failed: {', '.join(bad) or 'unknown'}") from failed
    return json.dumps({"input_rows": sum(o.input_rows for o in outcomes), "queries": [o.query_name for o in outcomes], "status": "SUCCEEDED", "run_id": run_id})
