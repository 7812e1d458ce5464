"""The batch pipeline from landed files to the snapshot, twice."""

import json

import pytest
from pyspark.sql import functions as F

from souk.__main__ import main
from souk.operators import health, quality
from souk.plans import batch
from souk.settings import load
from souk.sources import files, generate
from souk.sources.contracts import CONTRACTS
from souk.sources.store import TableStore

ROWS = {
    "customers": ["c1,u1,1000,São Paulo,sp", "c2,u2,2000,Rio,RJ"],
    "geolocation": ["1000,-23.5,-46.6,sao paulo,SP", "1000,-23.7,-46.8,São Paulo,SP", "2000,-22.9,-43.2,rio,RJ"],
    "order_items": ["synthetic_order_000000000001,1,p1,s1,2024-01-05 00:00:00,90.00,10.00", "synthetic_order_000000000002,1,p2,s1,2024-02-05 00:00:00,50.00,5.00"],
    "payments": ["synthetic_order_000000000001,1,credit card,1,100.00", "synthetic_order_000000000002,1,boleto,1,55.00"],
    "reviews": ["r1,synthetic_order_000000000001,5,,good,2024-01-20 00:00:00,2024-01-21 00:00:00"],
    "orders": ["synthetic_order_000000000001,c1,delivered,2024-01-02 10:00:00,2024-01-02 11:00:00,2024-01-03 00:00:00,2024-01-08 00:00:00,2024-01-10 00:00:00", "synthetic_order_000000000002,c2,shipped,2024-02-02 10:00:00,,,,2024-02-10 00:00:00"],
    "products": ["p1,beleza_saude,10,100,1,100,10,10,10", "p2,,10,100,1,100,10,10,10"],
    "sellers": ["s1,1000,São Paulo,SP"],
    "category_translation": ["beleza_saude,health_beauty"],
}


@pytest.fixture()
def landing(tmp_path):
    folder = tmp_path / "landing"
    folder.mkdir()
    for name, lines in ROWS.items():
        (folder / CONTRACTS[name].file).write_text("\n".join([",".join(CONTRACTS[name].columns), *lines]) + "\n", encoding="utf-8")
    return folder


def test_batch(spark, landing, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/store")
    for topic, key, made in (("delivery_events", "order_id", generate.delivery_events(spark, 2)), ("clickstream_events", "user_id", generate.click_events(spark, 20))):
        files.publish(made, topic, key, folder=str(tmp_path / topic))
    assert main(["stream", "--store", store.root, "--checkpoints", str(tmp_path / "c"), "--run-id", "r", "--folder", str(tmp_path), "--within", "900 DAYS"]) == 0
    assert store.read("ctl_streaming_runs").count() == 2
    out = batch.run(spark, store, str(landing), "r1", "salt", as_of=F.lit("2024-03-01").cast("timestamp"), output=str(tmp_path / "snapshot.json"))
    assert json.loads((tmp_path / "snapshot.json").read_text())["periods"] == out["periods"]
    year = next(p for p in out["periods"] if p["year"] == 2024)
    assert [m["gmv"] for m in sorted(year["monthly"], key=lambda m: m["month_number"])] == [100.0, 55.0] and year["previous"]["gmv"] == 155.0
    assert year["sellers"][0]["id"].startswith("seller-") and all(c["status"] == "passed" for c in out["quality"])
    items = store.read("fct_order_item").collect()
    assert len(items) == 2 and all(-1 not in (i.customer_key, i.seller_key, i.product_key, i.customer_geography_key) for i in items)
    assert store.read("dim_category").filter("category_name_english = 'health_beauty'").count() == 1
    assert store.read("mart_executive_daily").agg(F.sum("order_count")).first()[0] == 2
    assert store.read("mart_funnel_conversion").agg(F.sum("session_count")).first()[0] == 20
    checks = {(r.dataset, r.expectation): r.passed for r in store.read("ctl_data_quality_results").collect()}
    assert all(checks.values()) and {("fct_order_item", "seller_key_fk"), ("dim_customer", "versions_apart"), ("mart_executive_daily", "date_key_unique"), ("dim_seller", "one_current_version")} <= checks.keys()
    assert main(["export", "--store", store.root, "--salt", "salt", "--output", str(tmp_path / "again.json")]) == 0
    assert json.loads((tmp_path / "again.json").read_text())["periods"] == out["periods"]
    months = [m["month_number"] for m in year["monthly"]]
    assert [p["year"] for p in out["periods"]] == sorted((p["year"] for p in out["periods"]), reverse=True) and months == sorted(months)
    assert main(["health", "--store", store.root, "--run-id", "h1"]) == 0
    assert store.read("ctl_operational_health").first().input_rows == store.read("bronze_delivery_events").count() + store.read("bronze_clickstream_events").count()
    assert not store.exists("ctl_operational_alerts")
    store.overwrite("fct_payment", store.read("fct_payment").withColumn("payment_key", F.lit(1)))
    with pytest.raises(quality.QualityGateError, match="fct_payment.payment_key_unique"):
        batch.gold_checks(store, "r1b")
    with pytest.raises(RuntimeError, match="QUALITY_GATE_FAILURE"):
        main(["health", "--store", store.root, "--run-id", "h2", "--fail-on-critical"])
    assert [(r.code, r.run_id, r.delivery_status) for r in store.read("ctl_operational_alerts").collect()] == [("QUALITY_GATE_FAILURE", "h2", "PENDING")]
    counts = {n: store.read(n).count() for n in ("bronze_orders", "silver_orders", "silver_customers_history", "silver_delivery_snapshot")}
    batch.run(spark, store, str(landing), "r2", "salt", as_of=F.lit("2024-03-01").cast("timestamp"))
    assert counts == {n: store.read(n).count() for n in counts}
    assert store.read("ctl_ingestion_audit").filter("rows_written > 0").count() == 9


def test_settings():
    s = load({"streaming": {"max_heartbeat_minutes": 5}}, {"SOUK__QUALITY__MAX_QUARANTINE_RATE": "0.5", "SOUK__SESSION_MINUTES": "45"})
    assert (s.streaming.max_heartbeat_minutes, s.quality.max_quarantine_rate, s.session_minutes) == (5, 0.5, 45)
    with pytest.raises(ValueError, match="unknown setting streaming.odd"):
        load({"streaming": {"odd": 1}}, {})


def test_health_of_an_empty_store(spark, tmp_path):
    store = TableStore(spark, f"file://{tmp_path}/none")
    got = health.observe(store, "r", ["quarantine_x"])
    assert got["alerts"] == ["STREAM_HEARTBEAT_STALE"] and got["status"] == health.CRITICAL
    assert store.read("ctl_operational_alerts").first().observed == float("inf")


def test_events_of_given_orders(spark, tmp_path):
    (tmp_path / "o.csv").write_text("order_id,x\na,1\nb,2\n ,3\na,4\n", encoding="utf-8")
    assert main(["generate-deliveries", "--orders-csv", str(tmp_path / "o.csv"), "--duplicate-rate", "0", "--output", str(tmp_path / "e"), "--partitions", "2"]) == 0
    got = spark.read.json(str(tmp_path / "e"))
    assert got.count() == 14 == got.select("event_id").distinct().count() and {r.order_id for r in got.collect()} == {"a", "b"}
    with pytest.raises(ValueError, match="no order ids"):
        generate.delivery_events(spark, spark.createDataFrame([(None,)], "order_id string"))


def test_command_line(spark, tmp_path):
    assert main(["generate-deliveries", "--orders", "3", "--duplicate-rate", "0", "--output", str(tmp_path / "e"), "--partitions", "2"]) == 0
    assert main(["publish", "--input", str(tmp_path / "e"), "--topic", "t", "--key", "order_id", "--folder", str(tmp_path / "f")]) == 0
    assert spark.read.schema(files.ENVELOPE).json(str(tmp_path / "f")).count() == 21
