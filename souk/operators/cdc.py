"""Keyed merges as pure plans: what a table is to become, given what it is and what arrives."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.functions.columns import record_hash, require
from souk.functions.parts import spread


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Null-safe equality of the keys: a row whose key is null meets its like, however often it arrives."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def change_hash(df: DataFrame, columns: list[str] | None = None) -> Column:
    return record_hash(sorted(columns if columns is not None else [c for c in df.columns if not c.startswith("_")]))


def newest(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """One row a key: the largest sequence (null last), ties by the change hash."""
    order = W.partitionBy(*keys).orderBy(F.col(sequence).desc_nulls_last(), F.col("_change_hash").desc())
    return df.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def absent(df: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``df``, one a key, whose key ``target`` doesn't have; a null is a key like others."""
    return df.dropDuplicates(keys).alias("_s").join(target.select(*keys).alias("_t"), _same("_s", "_t", keys), "left_anti")


def current_state(df: DataFrame, target: DataFrame | None, keys: list[str], sequence: str) -> DataFrame:
    """The current-state table after ``df``: absent keys are inserted; a row is replaced where its sequence is null or not
    above the source's and their hashes differ. Nothing is deleted. One full outer join on the keys, a null being a key
    like others. A target that wasn't written by a merge gets its hashes here."""
    require(df, [*keys, sequence], "the source")
    source = newest(df.withColumn("_change_hash", change_hash(df)), keys, sequence)
    if target is None:
        return source
    columns = source.columns
    if "_change_hash" not in target.columns:
        target = target.withColumn("_change_hash", change_hash(target))
    s, t = source.select(F.struct(*columns).alias("_s")), target.select(F.struct(*columns).alias("_t"))
    newer = F.col(f"_t.{sequence}").isNull() | (F.col(f"_s.{sequence}") >= F.col(f"_t.{sequence}"))
    replace = F.col("_t").isNull() | (F.col("_s").isNotNull() & newer & (F.col("_s._change_hash") != F.col("_t._change_hash")))
    return s.join(t, _same("_s", "_t", keys), "full_outer").select(F.when(replace, F.col("_s")).otherwise(F.col("_t")).alias("r")).select("r.*")


@dataclass(frozen=True)
class History:
    """``table``: the history after the batch; ``late``: rows that came too late for it; ``changed``: rows that made a version."""

    table: DataFrame
    late: DataFrame
    changed: DataFrame


def scd2(df: DataFrame, target: DataFrame | None, keys: list[str], tracked: list[str], effective: str, run_id: str, open_start: Column | None = None) -> History:
    """Type-2 history with half-open validity [valid_from, valid_to).

    The latest row a key of the batch counts. A new key opens a version (from ``open_start`` if given, so that it
    covers what came before); a changed one closes the current version and opens the next; a change effective no
    later than the current version is late and returned, not applied; an unchanged row does nothing. A null is a key
    like others.
    """
    require(df, [*keys, *tracked, effective], "the source")
    hashed = df.withColumn("_change_hash", change_hash(df, tracked))
    picked = newest(hashed, keys, effective).select(*keys, *tracked, F.col(effective).alias("valid_from"), "_change_hash")

    def opened(rows: DataFrame, start: Column) -> DataFrame:
        return rows.select(*keys, *tracked, start.alias("valid_from"), F.lit(None).cast(dict(rows.dtypes)["valid_from"]).alias("valid_to"), F.lit(True).alias("is_current"), F.lit(run_id).alias("created_run_id"), F.lit(run_id).alias("updated_run_id"), "_change_hash")

    if target is None:
        first = opened(picked, open_start if open_start is not None else F.col("valid_from"))
        return History(first, picked.limit(0).withColumn("_quarantine_reason", F.lit("LATE_ARRIVING_SCD2_VERSION")), picked)
    opening = {c: F.col(f"_new.{c}") for c in picked.columns}
    opening |= {"valid_to": F.lit(None), "is_current": F.lit(True), "created_run_id": F.lit(run_id), "updated_run_id": F.lit(run_id)}
    if set(opening) != set(target.columns):
        raise ValueError(f"the target's columns aren't those of the history: {', '.join(sorted(set(opening) ^ set(target.columns)))}")
    # Versions and arrivals are laid end to end and meet in one window by key: a join's smaller side may be broadcast, as what compresses well looks small.
    old, new = (F.struct(*df.columns) for df in (target, picked))
    none = {c: F.lit(None).cast(df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType) for c, df in (("_old", target), ("_new", picked))}
    held = target.select(*keys, old.alias("_old"), none["_new"].alias("_new"))
    came = picked.select(*keys, none["_old"].alias("_old"), new.alias("_new"))
    of_key = W.partitionBy(*keys)

    def stamp(row: str) -> Column:
        return F.struct(f"{row}.valid_from", f"{row}._change_hash")

    met = held.unionByName(came).withColumns({"_now": F.max(F.when(F.col("_old.is_current"), stamp("_old"))).over(of_key), "_in": F.max(F.when(F.col("_new").isNotNull(), stamp("_new"))).over(of_key)})
    moved = F.col("_in").isNotNull() & F.col("_now").isNotNull() & (F.col("_in._change_hash") != F.col("_now._change_hash"))
    changed = F.coalesce(moved & (F.col("_in.valid_from") > F.col("_now.valid_from")), F.lit(False))
    fresh = F.col("_now").isNull()
    arrived, closes = F.col("_new").isNotNull(), changed & F.col("_old.is_current")
    kept = {c: F.col(f"_old.{c}") for c in target.columns}
    kept |= {"valid_to": F.when(closes, F.col("_in.valid_from")).otherwise(kept["valid_to"]), "is_current": kept["is_current"] & ~changed, "updated_run_id": F.when(closes, F.lit(run_id)).otherwise(kept["updated_run_id"])}
    if open_start is not None:
        opening["valid_from"] = F.when(fresh, open_start).otherwise(opening["valid_from"])
    table = met.filter(~arrived | changed | fresh).select(*[F.when(arrived, opening[c]).otherwise(kept[c]).alias(c) for c in target.columns])
    late = met.filter(arrived & moved & (F.col("_in.valid_from") <= F.col("_now.valid_from"))).select("_new.*").withColumn("_quarantine_reason", F.lit("LATE_ARRIVING_SCD2_VERSION"))
    return History(table, late, met.filter(arrived & (changed | fresh)).select("_new.*"))


def as_of(facts: DataFrame, versions: DataFrame, key: str, moment: str, columns: list[str]) -> DataFrame:
    """Temporal left join: each fact with the columns of the version of ``key`` valid at its moment.

    An open version ends at the end of time, so the range is a plain residual of the equi-join on the key.
    """
    v = versions.select(F.col(key).alias("_k"), F.col("valid_from").alias("_from"), F.coalesce("valid_to", F.lit("9999-12-31").cast(dict(versions.dtypes)["valid_from"])).alias("_to"), *columns)
    v = spread(v, "_k", by=facts)
    on = (facts[key] == v["_k"]) & (facts[moment] >= v["_from"]) & (facts[moment] < v["_to"])
    return facts.join(v, on, "left").drop("_k", "_from", "_to")
