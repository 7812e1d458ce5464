"""The engine's operators on small fixtures, with the results that the domain's rules give."""

import json
import os
import re
import zipfile
from datetime import UTC, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from souk.functions import parts
from souk.functions.columns import date_key, norm_text, ratio, record_hash, seconds_between, surrogate_key
from souk.operators import cdc, commerce, health, ingest, quality, silver
from souk.plans import analytics, catalog, gold, marts
from souk.sources import files, generate
from souk.sources.contracts import CONTRACTS, contract, transition_allowed
from souk.sources.store import Conflict, TableStore
from souk.streaming import events as streams

T0 = datetime(2026, 1, 1)


@pytest.fixture()
def store(spark, tmp_path):
    return TableStore(spark, f"file://{tmp_path}/tables")


def rows(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize(
    ("previous", "current", "allowed"),
    [(None, "created", True), (None, "shipped", False), ("created", "approved", True), ("created", "delivered", False), ("delivered", "in_transit", False), ("shipped", "shipped", True), ("exception", "in_transit", True), ("in_transit", "exception", True)],
)
def test_transition_rule(previous, current, allowed):
    assert transition_allowed(previous, current) is allowed


def test_contracts():
    assert len(CONTRACTS) == 9
    orders = contract("orders")
    orders.check_header(orders.columns)
    with pytest.raises(ValueError, match="out of order"):
        orders.check_header(orders.columns[::-1])
    with pytest.raises(ValueError, match="missing"):
        orders.check_header(orders.columns[1:])
    with pytest.raises(KeyError):
        contract("nothing")


def test_expressions(spark):
    df = spark.createDataFrame([(" São   PAULO ", datetime(2024, 2, 29, 23, 59, 59), datetime(2024, 3, 1)), (None, None, None)], "s string, a timestamp_ntz, b timestamp_ntz")
    got = df.select(norm_text("s").alias("n"), date_key("a").alias("d"), seconds_between(F.col("b"), F.col("a")).alias("x"), record_hash(["s"]).alias("h"), surrogate_key("s").alias("k"), ratio(F.lit(1), F.lit(3)).alias("r"), ratio(F.lit(1), F.lit(0)).alias("z")).collect()
    assert (got[0].n, got[0].d, got[0].x, got[0].r, got[0].z) == ("sao paulo", 20240229, 1, Decimal("0.333333"), None)
    assert got[1].n is None and got[1].d is None and got[1].h is not None and got[0].k >= 0
    assert [r.h for r in spark.createDataFrame([("∅",), (None,)], "s string").select(record_hash(["s"]).alias("h")).collect()][0] is not None


ORDERS = "order_id,customer_id,order_status,order_purchase_timestamp,order_approved_at,order_delivered_carrier_date,order_delivered_customer_date,order_estimated_delivery_date\n"


def test_ingest_is_idempotent_and_quarantines(spark, store, tmp_path):
    path = tmp_path / "orders.csv"
    path.write_text(ORDERS + "o1,c1,delivered,2026-01-01 10:00:00,,,,2026-01-05 00:00:00\n,c2,created,2026-01-01 10:00:00,,,,2026-01-05 00:00:00\n")
    audits = [ingest.ingest(spark, store, str(path), contract("orders"), "f" * 64, f"run{i}") for i in (1, 2)]
    assert [(a.rows_read, a.rows_written, a.rows_quarantined) for a in audits] == [(2, 1, 1), (2, 0, 1)]
    assert store.read("ctl_ingestion_audit").count() == 2 and store.read("bronze_orders").count() == 1
    assert [r._quarantine_reason for r in store.read("bronze_quarantine").collect()] == ["MISSING_REQUIRED_FIELD"]
    path.write_text("nonsense\n1\n")
    with pytest.raises(ValueError):
        ingest.ingest(spark, store, str(path), contract("orders"), "e" * 64, "run3")
    failed = store.read("ctl_ingestion_audit").filter("status = 'FAILED'").collect()
    assert len(failed) == 1 and failed[0].error_message.startswith("ValueError")


def test_ingest_malformed_and_repeated(spark, store, tmp_path):
    good = "o1,c1,delivered,2026-01-01 10:00:00,,,,2026-01-05 00:00:00\n"
    path = tmp_path / "orders.csv"
    path.write_text(ORDERS + good + good + good + "o2,c2,created,yesterday,,,,2026-01-05 00:00:00\n")
    a = ingest.ingest(spark, store, str(path), contract("orders"), "a" * 64, "r")
    assert (a.rows_read, a.rows_written, a.rows_quarantined) == (4, 1, 2)
    got = {r._quarantine_reason: r._duplicate_count for r in store.read("bronze_quarantine").collect()}
    assert got == {"MALFORMED_RECORD": None, "DUPLICATE_RECORD": 3}


def test_archive_and_manifest(tmp_path):
    archive = tmp_path / "a.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for c in CONTRACTS.values():
            z.writestr(f"data/{c.file}", "h\n1\n")
    assert len(files.extract(archive, tmp_path / "out")) == 9
    m = files.manifest(tmp_path / "out")
    assert [f["rows"] for f in m["files"]] == [1] * 9 and len(files.manifest_hashes(m)) == 9
    with pytest.raises(ValueError, match="not 'other'"):
        files.manifest_hashes(m, "other")
    with pytest.raises(ValueError, match="lacks"):
        files.manifest_hashes({"dataset": "olist", "files": m["files"][1:]})
    with zipfile.ZipFile(archive, "a") as z:
        z.writestr("../evil.csv", "x")
    with pytest.raises(ValueError, match="unsafe"):
        files.extract(archive, tmp_path / "out2")


def test_generators(spark):
    a, b = generate.delivery_events(spark, 10, 42), generate.delivery_events(spark, 10, 42)
    assert a.count() == 70 and a.select("event_id").distinct().count() == 70
    assert a.exceptAll(b).isEmpty() if "attributes" not in a.columns else a.drop("attributes").exceptAll(b.drop("attributes")).isEmpty()
    assert {len(r.event_id) for r in a.collect()} == {36}
    doubled = generate.delivery_events(spark, 50, 42, duplicates=0.5, late=0.5)
    assert 350 < doubled.count() < 700 and doubled.filter("produced_at > occurred_at + INTERVAL 1 DAY").count() > 50
    clicks = {r.event_type: r.n for r in generate.click_events(spark, 1000).groupBy("event_type").agg(F.count("*").alias("n")).collect()}
    assert clicks["page_view"] == 1000 > clicks["add_to_cart"] > clicks["checkout"] > clicks["purchase"] > 50
    with pytest.raises(ValueError):
        generate.delivery_events(spark, 0)


def test_silver_orders_and_products(spark):
    schema = contract("orders").schema()
    df = spark.createDataFrame([("o1", "c1", " Delivered", T0, T0 + timedelta(hours=2), None, T0 + timedelta(days=6), T0 + timedelta(days=5)), ("o2", "c1", "odd", T0, None, None, None, T0)], schema)
    a, b = silver.orders(df).orderBy("order_id").collect()
    assert (a.delivery_delay_days, a.is_delivered_on_time, a.approval_lead_hours, a.delivery_lead_days, a.is_delivered) == (1, False, 2.0, 6.0, True)
    assert b.is_delivered_on_time is None and b.is_valid_status is False
    p = spark.createDataFrame([("p", None, 1, 1, 1, 1, 2000, 2000, 2000)], contract("products").schema())
    r = silver.products(p).first()
    assert (r.category_name, r.volume_cm3) == ("unknown", 8_000_000_000)


def test_reconciliation_statuses(spark):
    orders = spark.createDataFrame([(c, "delivered", T0) for c in "abcdef"], "order_id string, order_status string, purchased_at timestamp")
    items = spark.createDataFrame([(c, "s", Decimal("90.00"), Decimal("10.00")) for c in "abcde"], "order_id string, seller_id string, item_amount decimal(18,2), freight_amount decimal(18,2)")
    paid = spark.createDataFrame([(c, Decimal(v), "card") for c, v in zip("abcf", ("100.01", "100.02", "99.00", "1.00"))] + [("c", Decimal("0.50"), "voucher")], "order_id string, payment_amount decimal(18,2), payment_type string")
    got = {r.order_id: r for r in commerce.reconcile(orders, items, paid).collect()}
    assert {k: v.reconciliation_status for k, v in got.items()} == {"a": "RECONCILED", "b": "OVERPAID", "c": "UNDERPAID", "d": "ORDER_WITHOUT_PAYMENT", "e": "ORDER_WITHOUT_PAYMENT", "f": "ORDER_WITHOUT_ITEMS"}
    assert got["c"].payment_method_count == 2 and got["c"].payment_difference == Decimal("-0.50")
    with pytest.raises(ValueError):
        commerce.reconcile(orders, items, paid, "-1")


def _events(spark, data):
    return spark.createDataFrame([(i, o, s, T0 + timedelta(minutes=m), T0 + timedelta(minutes=m + 5), "SP", "c", n) for n, (i, o, s, m) in enumerate(data)], "event_id string, order_id string, status string, occurred_at timestamp, produced_at timestamp, location_state string, carrier_code string, sequence_number int")


def test_transitions_and_snapshot(spark):
    events = _events(spark, [("1", "a", "created", 0), ("2", "a", "approved", 1), ("3", "a", "delivered", 2), ("4", "a", "delivered", 3), ("5", "b", "shipped", 0)])
    got = {r.event_id: r.is_valid_transition for r in commerce.transitions(events).collect()}
    assert got == {"1": True, "2": True, "3": False, "4": True, "5": False}
    orders = spark.createDataFrame([("a", "x", T0, T0 + timedelta(days=2), None, None, None), ("z", "x", T0, T0 + timedelta(days=9), None, None, None)], "order_id string, order_status string, purchased_at timestamp, estimated_delivery_at timestamp, delivered_at timestamp, delivery_delay_days int, is_delivered_on_time boolean")
    s = {r.order_id: r for r in commerce.delivery_snapshot(orders, events, F.lit(T0 + timedelta(days=1, seconds=1))).collect()}
    assert (s["a"].latest_delivery_status, s["a"].invalid_transition_count, s["a"].delivery_event_count, s["a"].is_at_risk, s["a"].event_arrival_lag_minutes) == ("delivered", 1, 4, True, 5.0)
    assert s["z"].latest_delivery_status is None and s["z"].is_at_risk is False


def test_sessions_split_above_the_gap(spark):
    at = [("1", 0, "product_view"), ("2", 5, "add_to_cart"), ("3", 40, "purchase"), ("4", 70, "page_view"), ("5", 20, "teleport")]
    df = spark.createDataFrame([(i, "u", t, T0 + timedelta(minutes=m)) for i, m, t in at], "event_id string, user_id string, event_type string, occurred_at timestamp")
    s = commerce.sessionize(df, 30).orderBy("session_sequence").collect()
    assert [(r.event_count, r.has_add_to_cart, r.has_purchase) for r in s] == [(2, True, False), (2, False, True)]
    assert s[0].device_type is None and s[1].session_duration_seconds == 1800
    with pytest.raises(ValueError):
        commerce.sessionize(df, 0)
    with pytest.raises(ValueError, match="lacks"):
        commerce.sessionize(df.drop("event_id"))


def test_current_state_rules(spark):
    schema = "k int, v string, _seq int"
    target = cdc.current_state(spark.createDataFrame([(1, "old", 5), (2, "old", None), (3, "old", 5), (4, "old", 5)], schema), None, ["k"], "_seq")
    source = spark.createDataFrame([(1, "new", 5), (1, "older", 4), (2, "new", 1), (3, "new", None), (4, "new", 4), (5, "new", None)], schema)
    got = {r.k: r.v for r in cdc.current_state(source, target, ["k"], "_seq").collect()}
    assert got == {1: "new", 2: "new", 3: "old", 4: "old", 5: "new"}


def test_scd2_versions_late_and_store(spark, store):
    day = timedelta(days=1)

    def batch(state, at):
        return spark.createDataFrame([("s", state, at)], "seller_id string, state string, effective_at timestamp")

    assert store.scd2("h", batch("SP", T0), ["seller_id"], ["state"], "effective_at", "r1").count() == 0
    store.scd2("h", batch("RJ", T0 + day), ["seller_id"], ["state"], "effective_at", "r2")
    late = store.scd2("h", batch("MG", T0 - day), ["seller_id"], ["state"], "effective_at", "r3")
    assert [r._quarantine_reason for r in late.collect()] == ["LATE_ARRIVING_SCD2_VERSION"]
    h = store.read("h").orderBy("valid_from").collect()
    assert [(r.state, r.is_current, r.valid_to) for r in h] == [("SP", False, T0 + day), ("RJ", True, None)]
    facts = spark.createDataFrame([("s", T0 - day), ("s", T0), ("s", T0 + day)], "seller_id string, at timestamp")
    joined = cdc.as_of(facts, store.read("h"), "seller_id", "at", ["state"]).orderBy("at").collect()
    assert [r.state for r in joined] == [None, "SP", "RJ"]
    opened = cdc.scd2(batch("SP", T0), None, ["seller_id"], ["state"], "effective_at", "r", open_start=F.lit(datetime(1900, 1, 1))).table.first()
    assert opened.valid_from == datetime(1900, 1, 1)


def test_store_versions_and_conflict(spark, store):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert store.overwrite("t", a) == 1 and store.append("t", spark.createDataFrame([(3, "c", 1)], "k int, v string, w int")) == 2
    assert store.read("t").count() == 3 and store.read("t", 1).count() == 2 and store.read("t").columns == ["k", "v", "w"]
    assert store.insert_absent("t", spark.createDataFrame([(3, "x", 1), (4, "d", 1), (4, "d", 1)], "k int, v string, w int"), ["k"]) == 1
    with pytest.raises(Conflict):
        store._commit("t", 2, {})
    with pytest.raises(KeyError):
        store.read("none")
    store.upsert("c", spark.range(200).select("id", F.lit(0).alias("_seq"), F.lit("a").alias("v")), ["id"], "_seq")
    before = store._manifest("c", 1)["files"]
    store.upsert("c", spark.createDataFrame([(7, 1, "b")], "id bigint, _seq int, v string"), ["id"], "_seq")
    after = store._manifest("c", 2)["files"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.read("c").count() == 200 and store.read("c").filter("v = 'b'").count() == 1


def test_store_loses_no_commit(spark, store):
    """Another writer commits while a write is under way: each ends up on top of the other's version."""
    other = TableStore(spark, store.root)

    def ids(*n):
        return spark.createDataFrame([(i, 0, "v") for i in n], "id bigint, _seq int, v string")

    store.append("t", ids(0, 1))
    commit = store._commit

    def overtaken(name, version, manifest):
        store._commit = commit
        other.append(name, ids(10, 11)) if name == "t" else other.upsert(name, ids(7), ["id"], "_seq")
        return commit(name, version, manifest)

    store._commit = overtaken
    assert store.append("t", ids(20, 21)) == 3
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 10, 11, 20, 21]
    store._commit = overtaken
    assert store.insert_absent("t", ids(10, 11, 30, None), ["id"]) == 2
    assert store.insert_absent("t", ids(30, None), ["id"]) == 0
    assert [r.n for r in store.read("t").filter("id in (10, 30) or id is null").groupBy("id").agg(F.count("*").alias("n")).orderBy("id").collect()] == [1, 2, 1]
    store.upsert("k", ids(1, None), ["id"], "_seq")
    store._commit = overtaken
    store.upsert("k", ids(2, 3, None), ["id"], "_seq")
    assert sorted(r.id or 0 for r in store.read("k").collect()) == [0, 1, 2, 3, 7]


def test_store_buckets_follow_the_table(spark, store, monkeypatch):
    """A merge over an appended table sees its rows; buckets double with the size and each key stays once."""
    from souk.sources import store as module

    rows = spark.range(500).select("id", F.lit(0).alias("_seq"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    store.append("t", rows)
    store.upsert("t", spark.createDataFrame([(7, 1, "b"), (900, 1, "new")], "id bigint, _seq int, v string"), ["id"], "_seq")
    assert store.read("t").count() == 501 == store.read("t").select("id").distinct().count() and store.read("t").filter("id = 7").first().v == "b"
    monkeypatch.setattr(module, "BUCKET_BYTES", 500)
    store.upsert("t", spark.createDataFrame([(8, 1, "c")], "id bigint, _seq int, v string"), ["id"], "_seq")
    m = store._manifest("t", store.version("t"))
    assert m["buckets"] > 32 and "-1" not in m["files"] and store.read("t").count() == 501 and store.read("t").filter("id = 8").first().v == "c"
    store.overwrite("t", rows.limit(3))
    assert store.read("t").count() == 3 and store.views("x_") == ["x_t"] and spark.table("x_t").count() == 3


def test_inserts_within_a_bound(spark, store):
    def at(*days):
        return spark.createDataFrame([(d, T0 + timedelta(days=d)) for d in days], "id int, seen timestamp")

    store.insert_absent("e", at(0, 10), ["id"], within=("seen", "2 DAYS"))
    assert store.insert_absent("e", at(10, 11), ["id"], within=("seen", "2 DAYS")) == 1
    assert sorted(r.id for r in store.read("e").collect()) == [0, 10, 11]


def test_null_keys_meet(spark):
    schema = "k int, v string, _seq int"
    target = cdc.current_state(spark.createDataFrame([(None, "old", 1), (1, "old", 1)], schema), None, ["k"], "_seq")
    got = cdc.current_state(spark.createDataFrame([(None, "new", 2)], schema), target, ["k"], "_seq").collect()
    assert sorted((r.k or 0, r.v) for r in got) == [(0, "new"), (1, "old")]
    first = cdc.scd2(spark.createDataFrame([(None, "a", T0)], "k int, v string, at timestamp"), None, ["k"], ["v"], "at", "r").table
    again = cdc.scd2(spark.createDataFrame([(None, "b", T0 + timedelta(days=1))], "k int, v string, at timestamp"), first, ["k"], ["v"], "at", "r").table
    assert sorted((r.v, r.is_current) for r in again.collect()) == [("a", False), ("b", True)]


def test_quality_and_gate(spark):
    child = spark.createDataFrame([("a", "p1", 1), ("b", "missing", 7), ("b", None, None)], "id string, product_id string, score int")
    parent = spark.createDataFrame([("p1",), ("p1",)], "product_id string")
    E = quality.Expectation
    counts = quality.failures(child, [E("nn", "score", quality.NOT_NULL), E("acc", "id", quality.ACCEPTED, accepted=("a",), max_failure_rate=0.7), E("btw", "score", quality.BETWEEN, low=0, high=5, severity=quality.WARN), E("uni", "id", quality.UNIQUE)], "d")
    got = {r.expectation: (r.failed_rows, r.passed) for r in quality.evaluate(counts, "r")}
    assert got == {"nn": (1, False), "acc": (2, True), "btw": (2, False), "uni": (2, False)}
    fk = quality.evaluate(quality.integrity(child, parent, "product_id", "product_id", "d", "fk"), "r")
    assert (fk[0].failed_rows, fk[0].total_rows) == (1, 3)
    with pytest.raises(quality.QualityGateError, match="d.fk=0.333333"):
        quality.gate(fk)
    empty = quality.evaluate(quality.failures(child.limit(0), [E("nn", "score", quality.NOT_NULL), E("uni", "id", quality.UNIQUE)], "d"), "r")
    assert all(r.passed and r.failure_rate == 0 for r in empty)
    quality.gate(empty)
    for bad in ({"rule": "ODD"}, {"rule": quality.ACCEPTED}, {"rule": quality.BETWEEN}, {"rule": quality.NOT_NULL, "max_failure_rate": 2}):
        with pytest.raises(ValueError):
            E("x", "y", **bad)


def test_hierarchies_deeper_than_the_default(spark):
    nodes = spark.createDataFrame([(str(i), str(i - 1) if i else None, f"n{i}") for i in range(104)], "category_id string, parent_category_id string, category_name string")
    assert analytics.hierarchy(nodes).agg(F.max("depth")).first()[0] == 103


def test_health():
    now = datetime(2026, 1, 1, tzinfo=UTC)
    got = health.alerts(health.Snapshot(now, now - timedelta(seconds=2400), 1, 2, 0.08))
    assert len(got) == 4 and sum(a.severity == health.CRITICAL for a in got) == 3
    assert health.alerts(health.Snapshot(now, now, 0, 0, 0.02)) == []
    assert health.alerts(health.Snapshot(now, None, 0, 0, 0.0))[0].observed == float("inf")


def _envelope(spark, values):
    return spark.createDataFrame([(v, "t", 0, i, T0) for i, v in enumerate(values)], files.ENVELOPE)


def _delivery(**changes):
    return json.dumps({"order_id": "o", "event_id": "e", "status": "created", "schema_version": "1.0.0", "produced_at": "2026-01-02T03:04:05.123456Z", "occurred_at": "2026-01-02T03:04:05Z", "location_state": "SP", "carrier_code": "c", "sequence_number": 1, "attributes": {"a": 1}} | changes)


def test_parsers(spark):
    values = [_delivery(), "{not json", None, _delivery(order_id=None), _delivery(schema_version="2"), _delivery(status="teleported"), _delivery(location_state="sp"), _delivery(extra=1), _delivery(occurred_at="soon")]
    got = [r._quarantine_reason for r in streams.parse_delivery(_envelope(spark, values)).orderBy("_kafka_offset").collect()]
    assert got == [None, "INVALID_JSON", "INVALID_JSON", "MISSING_REQUIRED_FIELD", "UNSUPPORTED_SCHEMA_VERSION", "INVALID_STATUS", "INVALID_STATE", None, "MISSING_REQUIRED_FIELD"]
    click = {"user_id": "u", "event_id": "e", "occurred_at": "2026-01-02T03:04:05Z", "event_type": "fly", "schema_version": "1.0.0"}
    assert streams.parse_clicks(_envelope(spark, [json.dumps(click)])).first()._quarantine_reason == "INVALID_EVENT_TYPE"


def test_stream_is_idempotent(spark, store, tmp_path):
    folder = str(tmp_path / "in")
    files.publish(generate.delivery_events(spark, 5), "deliveries", "order_id", folder=folder)
    spark.createDataFrame([("{bad", "deliveries", 1, 99, T0)], files.ENVELOPE).write.mode("append").json(folder)

    def once(checkpoint):
        q = streams.start(files.file_stream(spark, folder), streams.parse_delivery, store, "events", "bad", str(tmp_path / checkpoint), "r")
        return json.loads(streams.await_and_record(store, {"deliveries": q}, "r"))

    assert once("c1")["input_rows"] == 36
    assert once("c2")["status"] == "SUCCEEDED"
    assert store.read("events").count() == 35 and store.read("bad").count() == 1
    assert store.read("ctl_streaming_runs").count() == 2
    with pytest.raises(ValueError):
        streams.trigger(None, "sometimes")


def test_marts_and_measures(spark):
    dates = gold.dim_date(spark)
    assert dates.count() == 5479
    d = dates.filter("full_date = '2024-12-29'").first()
    assert (d.iso_day_of_week, d.is_weekend, str(d.week_started_at), str(d.month_ended_at)) == (7, 1, "2024-12-23", "2024-12-31")
    daily = spark.createDataFrame([(20240101, datetime(2024, 1, 1).date(), Decimal("10.00"), 2, 1, 1, 0, 1, None)], "date_key int, full_date date, gmv decimal(28,2), order_count bigint, delivered_order_count bigint, on_time_order_count bigint, failed_order_count bigint, late_order_count bigint, average_review_score decimal(18,4)")
    r = analytics.measured({"mart_executive_daily": daily, "dim_date": dates}, ["gmv", "average_ticket", "on_time_rate", "average_review"], ["calendar_year"]).first()
    assert (r.calendar_year, r.average_ticket, r.on_time_rate, r.average_review) == (2024, Decimal("5.0000"), Decimal("1.000000"), None)
    with pytest.raises(ValueError, match="several"):
        analytics.measured({}, ["gmv", "sessions"])
    f = spark.createDataFrame([(1, "o1", datetime(2024, 1, 5), False), (1, "o2", datetime(2024, 3, 1), False), (2, "o3", datetime(2024, 1, 9), True), (-1, "o4", datetime(2024, 1, 9), False)], "customer_key bigint, order_id string, purchased_at timestamp, is_terminal_failure boolean")
    assert sorted((r.months_since_first_purchase, r.retained_customer_count) for r in marts.customer_cohort(f).collect()) == [(0, 1), (2, 1)]
    x = spark.range(1).select(analytics.risk_class(F.lit(0.85)).alias("a"), analytics.risk_class(F.lit(0.86)).alias("b"), analytics.risk_class(F.lit(0.9)).alias("c"), analytics.percent_delta(F.lit(5), F.lit(0)).alias("d")).first()
    assert tuple(x) == ("critical", "warning", "healthy", 0.0)


def test_scd2_meets_without_a_join(spark, tmp_path):
    """Versions and arrivals meet in one shuffle by key: nothing is joined, so nothing is sent to the driver and broadcast."""
    day = timedelta(days=1)
    schema = "k int, v string, at timestamp"
    first = cdc.scd2(spark.createDataFrame([(k, "a", T0) for k in (None, 1, 2, 3)], schema), None, ["k"], ["v"], "at", "r1").table
    first.write.parquet(f"{tmp_path}/h")
    batch = [(None, "b", T0 + day), (1, "b", T0 + day), (1, "c", T0 + 2 * day), (2, "a", T0 + day), (3, "b", T0), (4, "n", T0 + day), (5, "n", None)]
    h = cdc.scd2(spark.createDataFrame(batch, schema), spark.read.parquet(f"{tmp_path}/h"), ["k"], ["v"], "at", "r2", F.lit(datetime(1900, 1, 1)))
    assert "Join" not in (plan := h.table._jdf.queryExecution().executedPlan().toString()) and "Broadcast" not in plan
    got = {(r.k, r.v, r.valid_from, r.valid_to, r.is_current, r.created_run_id, r.updated_run_id) for r in h.table.collect()}
    old = datetime(1900, 1, 1)
    assert h.table.count() == 8 and got == {
        (None, "a", T0, T0 + day, False, "r1", "r2"), (None, "b", T0 + day, None, True, "r2", "r2"), (1, "a", T0, T0 + 2 * day, False, "r1", "r2"), (1, "c", T0 + 2 * day, None, True, "r2", "r2"),
        (2, "a", T0, None, True, "r1", "r1"), (3, "a", T0, None, True, "r1", "r1"), (4, "n", old, None, True, "r2", "r2"), (5, "n", old, None, True, "r2", "r2"),
    }
    assert [(r.k, r.v) for r in h.late.collect()] == [(3, "b")] and {(r.k, r.v) for r in h.changed.collect()} == {(None, "b"), (1, "c"), (4, "n"), (5, "n")}
    with pytest.raises(ValueError, match="extra"):
        cdc.scd2(spark.createDataFrame(batch, schema), first.withColumn("extra", F.lit(1)), ["k"], ["v"], "at", "r2")


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["seller_risk_class", "mart_seller_scorecard", "seller_performance", "export_sellers"])
def test_parts_follow_the_size(spark, monkeypatch, name):
    """Shuffles of items have as many parts as the files ask for, however few the session has; the results stay."""

    def made():
        return catalog.QUERIES[name](spark, "/root/testdata/sf0.001")

    few = made()
    monkeypatch.setattr(parts, "PART_BYTES", 10_000)
    n = -(-parts.file_bytes(spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")) // parts.PART_BYTES)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = made()
        plan = many._jdf.queryExecution().executedPlan().toString()
        shuffles = re.findall(r"Exchange hashpartitioning\((.+), (\d+)\), (?:ENSURE|REPARTITION)", plan)
        assert n > 4 and all(int(k) >= n for keys, k in shuffles if re.search("order_?id|l_orderkey|_k#", keys)) and len(shuffles) > 5, shuffles
        got = sorted(map(repr, many.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == sorted(map(repr, few.collect()))


def test_parts_of_other_sources(spark):
    """Rows that no file holds count nothing and stay as they are."""
    df = spark.createDataFrame([(1,)], "a int")
    assert parts.file_bytes(df) == 0 and parts.spread(df, "a") is df
