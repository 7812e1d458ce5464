"""Operational health: metrics from the control tables, service levels, alerts."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.sources.contracts import schema_of
from souk.sources.store import TableStore

WARNING, CRITICAL = "WARNING", "CRITICAL"


@dataclass(frozen=True)
class Snapshot:
    observed_at: datetime
    latest_heartbeat: datetime | None
    failed_quality_checks: int
    streaming_failures: int
    quarantine_rate: float


@dataclass(frozen=True)
class Alert:
    code: str
    severity: str
    message: str
    observed: float
    threshold: float


def _utc(t: datetime) -> datetime:
    return t.replace(tzinfo=UTC) if t.tzinfo is None else t.astimezone(UTC)


def alerts(s: Snapshot, max_heartbeat_minutes: int = 20, max_quarantine_rate: float = 0.02) -> list[Alert]:
    """The service levels that the snapshot violates; no heartbeat is an infinitely old one."""
    age = float("inf") if s.latest_heartbeat is None else max(0.0, (_utc(s.observed_at) - _utc(s.latest_heartbeat)).total_seconds() / 60)
    rules = (
        ("STREAM_HEARTBEAT_STALE", CRITICAL, "no stream heartbeat within the objective", age, float(max_heartbeat_minutes)),
        ("STREAM_QUERY_FAILED", CRITICAL, "streaming queries failed in the window", float(s.streaming_failures), 0.0),
        ("QUARANTINE_RATE_HIGH", WARNING, "the share of quarantined events is above its limit", s.quarantine_rate, max_quarantine_rate),
        ("QUALITY_GATE_FAILURE", CRITICAL, "critical quality checks failed", float(s.failed_quality_checks), 0.0),
    )
    return [Alert(*r) for r in rules if r[3] > r[4]]


def metrics(outcomes: DataFrame, quarantine: DataFrame, quality: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """One row: latest heartbeat, failures, input and quarantined rows, their rate, and failed checks, in the hours up to ``as_of``.

    A source read by several queries counts once (its largest input a run); of the checks, each dataset's latest run counts.
    """
    since = as_of - F.expr(f"INTERVAL {hours} HOURS")
    recent = outcomes.filter((F.col("recorded_at") >= since) & (F.col("recorded_at") <= as_of))
    runs = recent.groupBy("run_id", "source").agg(F.max("recorded_at").alias("at"), F.count_if(F.col("status") == "FAILED").alias("failed"), F.max("input_rows").alias("rows"))
    stream = runs.agg(F.max("at").alias("latest_heartbeat"), F.coalesce(F.sum("failed"), F.lit(0)).alias("streaming_failures"), F.coalesce(F.sum("rows"), F.lit(0)).alias("input_rows"))
    held = quarantine.filter((F.col("_ingested_at") >= since) & (F.col("_ingested_at") <= as_of)).agg(F.count("*").alias("quarantined_rows"))
    last = F.max("evaluated_at").over(W.partitionBy("dataset"))
    checks = quality.filter((F.col("evaluated_at") >= since) & (F.col("evaluated_at") <= as_of)).withColumn("_last", last).filter("evaluated_at = _last").agg(F.count_if(~F.col("passed") & (F.col("severity") == "ERROR")).alias("failed_quality_checks"))
    rate = F.try_divide(F.col("quarantined_rows").cast("double"), F.col("input_rows").cast("double"))
    return stream.crossJoin(held).crossJoin(checks).withColumn("quarantine_rate", F.coalesce(rate, F.lit(0.0)))


ALERTS = schema_of("code string, severity string, message string, observed double, threshold double, run_id string, observed_at timestamp, delivery_status string")
METRICS = schema_of("latest_heartbeat timestamp, streaming_failures bigint, input_rows bigint, quarantined_rows bigint, failed_quality_checks bigint, quarantine_rate double, run_id string, observed_at timestamp")
EMPTY = {
    "ctl_streaming_runs": schema_of("run_id string, source string, status string, recorded_at timestamp, input_rows bigint"),
    "quarantine": schema_of("_ingested_at timestamp"),
    "ctl_data_quality_results": schema_of("dataset string, evaluated_at timestamp, passed boolean, severity string"),
}


def observe(store: TableStore, run_id: str, quarantines: list[str], at: datetime | None = None, hours: int = 24, max_heartbeat_minutes: int = 20, max_quarantine_rate: float = 0.02, fail_on_critical: bool = False) -> dict:
    """The operational job: metrics of the control tables up to ``at`` (now), kept in ``ctl_operational_health``, and what they
    violate in ``ctl_operational_alerts``. A table that isn't there counts as empty. Returns a summary; raises on a critical
    alert if asked to, after both are written.
    """
    at = _utc(at or datetime.now(UTC))

    def held(name: str, kind: str) -> DataFrame:
        columns = EMPTY[kind].names
        return store.read(name).select(*columns) if store.exists(name) else store.spark.createDataFrame([], EMPTY[kind])

    quarantine = store.spark.createDataFrame([], EMPTY["quarantine"])
    for name in quarantines:
        quarantine = quarantine.unionByName(held(name, "quarantine"))
    m = metrics(held("ctl_streaming_runs", "ctl_streaming_runs"), quarantine, held("ctl_data_quality_results", "ctl_data_quality_results"), F.lit(at), hours).first()
    found = alerts(Snapshot(at, m.latest_heartbeat and m.latest_heartbeat.astimezone(UTC), m.failed_quality_checks, m.streaming_failures, m.quarantine_rate), max_heartbeat_minutes, max_quarantine_rate)
    store.append("ctl_operational_health", store.spark.createDataFrame([tuple(m[n] for n in METRICS.names[:-2]) + (run_id, at)], METRICS))
    if found:
        store.append("ctl_operational_alerts", store.spark.createDataFrame([(*asdict(a).values(), run_id, at, "PENDING") for a in found], ALERTS))
    status = CRITICAL if any(a.severity == CRITICAL for a in found) else WARNING if found else "HEALTHY"
    if fail_on_critical and status == CRITICAL:
        raise RuntimeError(f"service levels violated: {', '.join(a.code for a in found)}")
    return {"run_id": run_id, "status": status, "quarantine_rate": m.quarantine_rate, "alerts": [a.code for a in found]}


def freshness(df: DataFrame, moment: str, as_of: Column, warn_hours: int = 24, error_hours: int = 48) -> DataFrame:
    """One row: the latest moment, its age in hours and pass, warn or error (an empty table: error)."""
    latest = df.agg(F.max(moment).alias("latest"))
    from souk.functions.columns import seconds_between

    age = seconds_between(as_of, F.col("latest")) / F.lit(3600.0)
    state = F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass")
    return latest.withColumn("age_hours", age).withColumn("state", state)
