"""The batch pipeline: landed files to bronze, entities and histories, the quality gate, the star schema and marts, and a snapshot."""

from __future__ import annotations

from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.operators import commerce, ingest, quality, silver
from souk.plans import analytics, gold, marts
from souk.settings import Settings
from souk.sources import files
from souk.sources.contracts import CONTRACTS, ORDER_STATUSES
from souk.sources.store import TableStore

PLACE = ["zip_code_prefix", "city", "state"]
#: entity: (table, keys)
CURRENT = {
    "customers": ("silver_customers", ["customer_id"]), "orders": ("silver_orders", ["order_id"]), "order_items": ("silver_order_items", ["order_id", "order_item_id"]), "payments": ("silver_payments", ["order_id", "payment_sequence"]),
    "reviews": ("silver_reviews", ["review_id", "order_id"]), "category_translation": ("silver_category_translation", ["category_name"]),
}
HISTORIES = {
    "customers": ("silver_customers_history", ["customer_unique_id"], PLACE), "sellers": ("silver_sellers_history", ["seller_id"], PLACE),
    "products": ("silver_products_history", ["product_id"], ["category_name", *gold.PRODUCT]),
}
TRANSFORMS = {"customers": silver.customers, "sellers": silver.sellers, "products": silver.products, "orders": silver.orders, "order_items": silver.order_items, "payments": silver.payments, "reviews": silver.reviews, "category_translation": silver.category_translation}


def bronze(spark: SparkSession, store: TableStore, landing: str, run_id: str, hashes: dict[str, str]) -> list[ingest.Audit]:
    return [ingest.ingest(spark, store, f"{landing}/{c.file}", c, hashes[name], run_id) for name, c in CONTRACTS.items()]


def entities(store: TableStore, run_id: str) -> None:
    """Current-state and history merges. The first version of a key is open to the past, as its facts are older than its load."""
    frames = {name: f(store.read(f"bronze_{name}")) for name, f in TRANSFORMS.items()}
    for name, (table, keys) in CURRENT.items():
        store.upsert(table, frames[name], keys, "_ingested_at")
    for name, (table, keys, tracked) in HISTORIES.items():
        late = store.scd2(table, frames[name], keys, tracked, "_ingested_at", run_id, open_start=F.lit(datetime(1900, 1, 1)))
        if not late.isEmpty():
            store.append(f"quarantine_late_{name}", late)
    store.upsert("silver_geography", silver.geography(store.read("bronze_geolocation")).withColumn("_effective_at", F.current_timestamp()), ["zip_code_prefix"], "_effective_at")


def derived(store: TableStore, settings: Settings, as_of: Column) -> None:
    """Reconciliation, and the delivery snapshot and sessions where their events were streamed in."""
    orders = store.read("silver_orders")
    store.upsert("silver_financial_reconciliation", commerce.reconcile(orders, store.read("silver_order_items"), store.read("silver_payments"), settings.payment_tolerance).withColumn("_reconciled_at", F.current_timestamp()), ["order_id"], "_reconciled_at")
    if store.exists("bronze_delivery_events"):
        store.upsert("silver_delivery_event_history", store.read("bronze_delivery_events"), ["event_id"], "produced_at")
        store.upsert("silver_delivery_snapshot", commerce.delivery_snapshot(orders, store.read("silver_delivery_event_history"), as_of), ["order_id"], "latest_event_received_at")
    if store.exists("bronze_clickstream_events"):
        store.overwrite("silver_clickstream_sessions", commerce.sessionize(store.read("bronze_clickstream_events"), settings.session_minutes))


def gate(store: TableStore, run_id: str) -> list[quality.Result]:
    """Evaluates the suite, keeps its results and raises on errors."""
    e, items = quality.Expectation, store.read("silver_order_items")
    orders = quality.failures(store.read("silver_orders"), [e("order_id_not_null", "order_id", quality.NOT_NULL), e("order_id_unique", "order_id", quality.UNIQUE), e("valid_order_status", "order_status", quality.ACCEPTED, accepted=ORDER_STATUSES)], "silver_orders")
    lines = quality.failures(items, [e("order_id_not_null", "order_id", quality.NOT_NULL), e("valid_item_amount", "has_valid_amount", quality.ACCEPTED, accepted=(True,))], "silver_order_items")
    keys = [quality.integrity(items, store.read(f"silver_{p}s_history"), f"{p}_id", f"{p}_id", "silver_order_items", f"{p}_fk") for p in ("product", "seller")]
    paid = quality.failures(store.read("silver_financial_reconciliation"), [e("payment_reconciliation", "is_payment_reconciled", quality.ACCEPTED, quality.WARN, 0.05, accepted=(True,))], "silver_financial_reconciliation")
    counts = orders
    for more in (lines, *keys, paid):
        counts = counts.unionByName(more)
    results = quality.evaluate(counts, run_id)
    quality.persist(store, results)
    quality.gate(results)
    return results


def star(store: TableStore) -> dict[str, DataFrame]:
    """Writes dimensions, facts and marts in their order and returns them."""
    spark, made = store.spark, {}

    def put(name: str, df: DataFrame) -> DataFrame:
        store.overwrite(name, df)
        made[name] = store.read(name)
        return made[name]

    orders, items, payments, customers = (store.read(f"silver_{n}") for n in ("orders", "order_items", "payments", "customers"))
    dates = put("dim_date", gold.dim_date(spark))
    customer, seller = put("dim_customer", gold.dim_customer(store.read("silver_customers_history"))), put("dim_seller", gold.dim_seller(store.read("silver_sellers_history")))
    product = put("dim_product", gold.dim_product(store.read("silver_products_history")))
    category = put("dim_category", gold.dim_category(store.read("silver_products_history"), store.read("silver_category_translation")))
    put("bridge_category_hierarchy", gold.bridge_category(category))
    put("dim_order_status", gold.dim_order_status(spark))
    geography = put("dim_geography", gold.dim_geography(store.read("silver_geography")))
    fact = put("fct_order_item", gold.fct_order_item(items, orders, customers, customer, seller, product, geography))
    paid = put("fct_payment", gold.fct_payment(payments, orders, customers, customer))
    reviews = put("fct_review", gold.fct_review(store.read("silver_reviews"), orders))
    put("fct_order_reconciliation", gold.fct_order_reconciliation(store.read("silver_financial_reconciliation")))
    put("mart_executive_daily", marts.executive_daily(dates, fact, paid, reviews))
    put("mart_seller_scorecard", marts.seller_scorecard(fact))
    put("mart_customer_cohort", marts.customer_cohort(fact))
    if store.exists("silver_delivery_snapshot"):
        put("mart_delivery_sla", marts.delivery_sla(put("fct_delivery", gold.fct_delivery(store.read("silver_delivery_snapshot"), orders))))
    if store.exists("silver_clickstream_sessions"):
        put("mart_funnel_conversion", marts.funnel_conversion(put("fct_funnel_session", gold.fct_funnel_session(store.read("silver_clickstream_sessions")))))
    return made


#: table: (expectations, or (its key, the dimension, the dimension's key)); run where the table is there.
_E = quality.Expectation
_KEYS = {
    "dim_date": "date_key", "dim_customer": "customer_key", "dim_seller": "seller_key", "dim_product": "product_key", "dim_category": "category_key", "dim_geography": "geography_key", "dim_order_status": "order_status_key",
    "fct_order_item": "order_item_key", "fct_payment": "payment_key", "fct_delivery": "delivery_key", "fct_review": "review_key", "fct_funnel_session": "session_key", "fct_order_reconciliation": "reconciliation_key",
}
_ALSO = {
    "dim_customer": [_E("customer_unique_id_not_null", "customer_unique_id", quality.NOT_NULL)], "bridge_category_hierarchy": [_E("pair_unique", "ancestor_category_key, descendant_category_key", quality.UNIQUE)],
    "fct_delivery": [_E("order_id_not_null", "order_id", quality.NOT_NULL), _E("order_id_unique", "order_id", quality.UNIQUE), _E("transitions_valid", "invalid_transition_count", quality.BETWEEN, quality.WARN, low=0, high=0)],
    "fct_order_reconciliation": [_E("order_id_not_null", "order_id", quality.NOT_NULL), _E("order_id_unique", "order_id", quality.UNIQUE)], "fct_order_item": [_E("item_amount_not_negative", "item_amount", quality.BETWEEN, low=0), _E("freight_amount_not_negative", "freight_amount", quality.BETWEEN, low=0)],
    "mart_executive_daily": [_E("date_key_not_null", "date_key", quality.NOT_NULL), _E("date_key_unique", "date_key", quality.UNIQUE)], "mart_seller_scorecard": [_E("seller_key_unique", "seller_key", quality.UNIQUE)],
    "mart_delivery_sla": [_E("grain_unique", "date_key, carrier_code, location_state", quality.UNIQUE)], "mart_funnel_conversion": [_E("grain_unique", "date_key, device_type, traffic_source", quality.UNIQUE)], "mart_customer_cohort": [_E("grain_unique", "cohort_month, months_since_first_purchase", quality.UNIQUE)],
}
_REFERENCES = (
    ("fct_order_item", "customer_key", "dim_customer", "customer_key"), ("fct_order_item", "seller_key", "dim_seller", "seller_key"), ("fct_order_item", "product_key", "dim_product", "product_key"),
    ("fct_order_item", "purchase_date_key", "dim_date", "date_key"), ("fct_payment", "customer_key", "dim_customer", "customer_key"), ("dim_product", "category_key", "dim_category", "category_key"),
)


def gold_checks(store: TableStore, run_id: str) -> list[quality.Result]:
    """Checks the star schema and its marts: keys there and unique, references whole, versions that don't overlap, one current
    version a seller, no negative amounts, and, as a warning, transitions. Keeps the results and raises on errors."""
    counts = []
    for name in sorted(_KEYS.keys() | _ALSO.keys()):
        if store.exists(name):
            key = _KEYS.get(name)
            rules = [_E(f"{key}_not_null", key, quality.NOT_NULL), _E(f"{key}_unique", key, quality.UNIQUE)] if key else []
            counts.append(quality.failures(store.read(name), rules + _ALSO.get(name, []), name))
    for child, key, parent, parent_key in _REFERENCES:
        counts.append(quality.integrity(store.read(child), store.read(parent), key, parent_key, child, f"{key}_fk"))
    for name, who in (("dim_customer", "customer_unique_id"), ("dim_seller", "seller_id")):
        versions = store.read(name).filter(f"{who} <> 'UNKNOWN'")
        before = F.lag("valid_to").over(W.partitionBy(who).orderBy("valid_from"))
        apart = versions.withColumn("apart", ~F.coalesce(before > F.col("valid_from"), F.lit(False)))
        counts.append(quality.failures(apart, [_E("versions_apart", "apart", quality.ACCEPTED, accepted=(True,))], name))
        counts.append(quality.failures(versions.filter("is_current"), [_E("one_current_version", who, quality.UNIQUE)], name))
    whole = counts[0]
    for more in counts[1:]:
        whole = whole.unionByName(more)
    results = quality.evaluate(whole, run_id)
    quality.persist(store, results)
    quality.gate(results)
    return results


def export(store: TableStore, salt: str, output: str) -> dict:
    """The snapshot of the marts as they are stored, written."""
    out = snapshot(store, salt)
    files.write_snapshot(out, output)
    return out


def snapshot(store: TableStore, salt: str, sellers: int | None = None) -> dict:
    """The dashboard's figures by year; a few hundred rows, but for the sellers, who can be limited to the best of each year."""
    daily, fact, dates = (store.read(n) for n in ("mart_executive_daily", "fct_order_item", "dim_date"))
    monthly = analytics.export_monthly(daily).filter("orders > 0")
    best = analytics.export_sellers(fact, store.read("dim_seller"), salt)
    parts = {"monthly": monthly, "sellers": analytics.top_by(best, "year", "gmv", sellers) if sellers else best}
    if store.exists("mart_delivery_sla"):
        parts["regions"] = analytics.export_regions(fact, store.read("dim_geography"), store.read("mart_delivery_sla"), dates)
    if store.exists("mart_funnel_conversion"):
        parts["channels"] = analytics.export_channels(store.read("mart_funnel_conversion"), dates)
    years: dict[int, dict] = {}
    for name, df in parts.items():
        for row in df.collect():
            r = row.asDict()
            years.setdefault(r.pop("year"), {}).setdefault(name, []).append({k: float(v) if hasattr(v, "quantize") else v for k, v in r.items()})
    for row in analytics.export_previous(monthly).collect():
        years[row.year]["previous"] = {k.removeprefix("previous_"): float(v) for k, v in row.asDict().items() if k != "year"}
    checks = store.read("ctl_data_quality_results") if store.exists("ctl_data_quality_results") else None
    found = [] if checks is None else [{"name": f"{r.dataset}.{r.expectation}", "status": "passed" if r.passed else "failed", "coverage": 1 - r.failure_rate, "failedRows": r.failed_rows} for r in analytics.latest_checks(checks).collect()]
    return {"metadata": {"generatedAt": datetime.now(UTC).isoformat(), "sources": sorted(parts)}, "periods": [{"year": y, **years[y]} for y in sorted(years, reverse=True)], "quality": found}


def run(spark: SparkSession, store: TableStore, landing: str, run_id: str, salt: str, settings: Settings | None = None, as_of: Column | None = None, output: str | None = None) -> dict:
    """All of it over a landing folder with its manifest; returns the snapshot, and writes it if asked to."""
    settings = settings or Settings()
    hashes = files.manifest_hashes(files.manifest(Path(landing)))
    bronze(spark, store, landing, run_id, hashes)
    entities(store, run_id)
    derived(store, settings, as_of if as_of is not None else F.current_timestamp())
    gate(store, run_id)
    star(store)
    gold_checks(store, run_id)
    return export(store, salt, output) if output else snapshot(store, salt)
