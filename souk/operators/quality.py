"""Data-quality expectations, evaluated together, and the gate on their results."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.sources.contracts import schema_of
from souk.sources.store import TableStore

NOT_NULL, UNIQUE, ACCEPTED, BETWEEN = "NOT_NULL", "UNIQUE", "ACCEPTED_VALUES", "BETWEEN"
ERROR, WARN = "ERROR", "WARN"


@dataclass(frozen=True)
class Expectation:
    """A rule on a column (UNIQUE: on one or more, separated by commas)."""

    name: str
    column: str
    rule: str
    severity: str = ERROR
    max_failure_rate: float = 0.0
    accepted: tuple[Any, ...] = ()
    low: Any = None
    high: Any = None

    def __post_init__(self) -> None:
        if self.rule not in (NOT_NULL, UNIQUE, ACCEPTED, BETWEEN):
            raise ValueError(f"unknown rule {self.rule}")
        if not 0 <= self.max_failure_rate <= 1:
            raise ValueError("the failure rate must lie between 0 and 1")
        if self.rule == ACCEPTED and not self.accepted:
            raise ValueError("accepted values are needed")
        if self.rule == BETWEEN and self.low is None and self.high is None:
            raise ValueError("a bound is needed")

    def failed(self) -> Column:
        """Whether a row fails; null fails every rule."""
        c = F.col(self.column)
        if self.rule == NOT_NULL:
            return c.isNull()
        if self.rule == ACCEPTED:
            return c.isNull() | ~c.isin(*self.accepted)
        out = c.isNull()
        if self.low is not None:
            out = out | (c < F.lit(self.low))
        return out | (c > F.lit(self.high)) if self.high is not None else out


@dataclass(frozen=True)
class Result:
    run_id: str
    dataset: str
    expectation: str
    rule: str
    severity: str
    failed_rows: int
    total_rows: int
    failure_rate: float
    max_failure_rate: float
    passed: bool
    evaluated_at: datetime


RESULTS = schema_of("run_id string, dataset string, expectation string, rule string, severity string, failed_rows bigint, total_rows bigint, failure_rate double, max_failure_rate double, passed boolean, evaluated_at timestamp")


def failures(df: DataFrame, expectations: list[Expectation], dataset: str) -> DataFrame:
    """(dataset, expectation, rule, severity, max_failure_rate, failed_rows, total_rows): all row rules in one aggregate,
    a unique rule in a two-level one. Nulls count as equal, and every row of a repeated key fails."""
    rows = [e for e in expectations if e.rule != UNIQUE]
    head = "dataset string, expectation string, rule string, severity string, max_failure_rate double"

    def fixed(e: Expectation) -> list[Column]:
        values = (dataset, e.name, e.rule, e.severity, float(e.max_failure_rate))
        return [F.lit(v).alias(n.split()[0]) for v, n in zip(values, head.split(", "))]

    out = None
    if rows:
        counted = df.agg(F.count("*").alias("n"), *[F.count_if(e.failed()).alias(f"f{i}") for i, e in enumerate(rows)])
        each = F.array(*[F.struct(*fixed(e), F.col(f"f{i}").alias("failed_rows"), F.col("n").alias("total_rows")) for i, e in enumerate(rows)])
        out = counted.select(F.explode(each).alias("r")).select("r.*")
    for e in expectations:
        if e.rule == UNIQUE:
            by = df.groupBy(*[c.strip() for c in e.column.split(",")]).agg(F.count("*").alias("_n"))
            one = by.agg(F.coalesce(F.sum(F.when(F.col("_n") > 1, F.col("_n"))), F.lit(0)).alias("failed_rows"), F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows")).select(*fixed(e), "failed_rows", "total_rows")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no expectations")
    return out


def integrity(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, dataset: str, name: str, severity: str = ERROR, max_failure_rate: float = 0.0) -> DataFrame:
    """As ``failures``: child keys that the parent lacks. A null key passes, but counts among the rows."""
    known = parent.select(F.col(parent_key).alias("_k")).distinct().withColumn("_there", F.lit(True))
    met = child.select(child_key).join(known, F.col(child_key) == F.col("_k"), "left")
    return met.agg(F.count_if(F.col(child_key).isNotNull() & F.col("_there").isNull()).alias("failed_rows"), F.count("*").alias("total_rows")).select(
        F.lit(dataset).alias("dataset"), F.lit(name).alias("expectation"), F.lit("REFERENTIAL_INTEGRITY").alias("rule"), F.lit(severity).alias("severity"), F.lit(float(max_failure_rate)).alias("max_failure_rate"), "failed_rows", "total_rows",
    )


def judged(counts: DataFrame) -> DataFrame:
    """With the failure rate (0 of no rows) and whether it is within its limit."""
    rate = F.when(F.col("total_rows") == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("failed_rows").cast("double"), F.col("total_rows").cast("double")))
    return counts.withColumn("failure_rate", rate).withColumn("passed", F.col("failure_rate") <= F.col("max_failure_rate"))


def evaluate(counts: DataFrame, run_id: str, at: datetime | None = None) -> list[Result]:
    """The judged counts as results (a row a rule)."""
    at = at or datetime.now(UTC)
    return [Result(run_id, r.dataset, r.expectation, r.rule, r.severity, r.failed_rows, r.total_rows, r.failure_rate, r.max_failure_rate, r.passed, at) for r in judged(counts).collect()]


def persist(store: TableStore, results: list[Result], name: str = "ctl_data_quality_results") -> None:
    store.append(name, store.spark.createDataFrame([tuple(vars(r).values()) for r in results], RESULTS))


class QualityGateError(RuntimeError):
    pass


def gate(results: list[Result]) -> None:
    """Raises on failed expectations of severity ERROR, naming each with its rate."""
    if bad := [f"{r.dataset}.{r.expectation}={r.failure_rate:.6f}" for r in results if not r.passed and r.severity == ERROR]:
        raise QualityGateError("; ".join(bad))
