"""Every query by name, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.columns import norm_text, record_hash, surrogate_key
from souk.operators import cdc, commerce, health, ingest, quality
from souk.plans import analytics, gold
from souk.plans.adapter import Market, ntz
from souk.sources import generate
from souk.sources.contracts import ORDER_STATUSES
from souk.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SALT = "salt"
REGION = "N0"


def query(f: Callable[[Market], DataFrame]) -> Callable[[Market], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Market(spark, sf_dir))
    return f


def _plain(name: str, attribute: str, *dropped: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: getattr(Market(spark, sf_dir), attribute).drop(*dropped)


for _name, _attribute in {
    "silver_customers": "customers", "silver_sellers": "sellers", "silver_products": "products", "silver_orders": "orders", "silver_order_items": "items", "silver_payments": "payments",
    "silver_reviews": "reviews", "silver_category": "translation", "geo_median_mode": "geography", "stg_customers": "customers", "financial_reconciliation": "reconciled", "delivery_snapshot": "snapshot", "sessionize": "sessions",
    "dim_date": "dim_date", "dim_customer": "dim_customer", "dim_seller": "dim_seller", "dim_product": "dim_product", "dim_category": "dim_category", "dim_geography": "dim_geography",
    "fct_order_item": "fct_order_item", "fct_payment": "fct_payment", "fct_delivery": "fct_delivery", "fct_review": "fct_review", "fct_funnel_session": "fct_funnel_session", "fct_order_reconciliation": "fct_order_reconciliation",
    "mart_executive_daily": "mart_executive_daily", "mart_seller_scorecard": "mart_seller_scorecard", "mart_delivery_sla": "mart_delivery_sla", "mart_funnel_conversion": "mart_funnel_conversion", "mart_customer_cohort": "mart_customer_cohort",
}.items():
    _plain(_name, _attribute)
_plain("stg_orders", "orders", "is_valid_status")
_plain("stg_order_items", "items", "has_valid_amount")
_plain("stg_payments", "payments", "has_valid_payment")
_plain("stg_reviews", "reviews", "has_valid_score")


# expressions


@query
def norm_text_(m: Market) -> DataFrame:
    return m.table("part").select("p_partkey", norm_text(F.concat(F.lit("  ÀÇÃO "), "p_type", F.lit("   "), "p_name", F.lit(" "))).alias("normal"))


QUERIES["norm_text"] = QUERIES.pop("norm_text_")


@query
def record_hash_(m: Market) -> DataFrame:
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    return m.table("orders").select("o_orderkey", record_hash([F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderstatus"), day, F.lit(None)]).alias("record_hash"))


QUERIES["record_hash"] = QUERIES.pop("record_hash_")


@query
def surrogate_key_(m: Market) -> DataFrame:
    return m.table("customer").select("c_custkey", surrogate_key(F.lit("customer"), "c_custkey", "c_name").alias("customer_key"))


QUERIES["surrogate_key"] = QUERIES.pop("surrogate_key_")


# keyed merges and quarantine


@query
def anti_join_new_rows(m: Market) -> DataFrame:
    lines, keys = m.table("lineitem"), ["l_orderkey", "l_linenumber"]
    return cdc.absent(lines.select(*keys), lines.filter(F.col("l_shipdate") < ntz("1997-01-01")), keys)


@query
def dedup_quarantine(m: Market) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber"]
    _, bad = ingest.split(m.table("lineitem").select(*keys), keys, keys)
    return bad.select(*keys, "_duplicate_count")


@query
def quarantine_split(m: Market) -> DataFrame:
    lines = m.table("lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linestatus") != "F", F.lit(1)).alias("required"), F.when(F.col("l_returnflag") == "R", "raw").alias("_corrupt_record"))
    valid, bad = ingest.split(lines, ["required"], ["l_orderkey", "l_linenumber"])
    reasons = valid.select(F.lit("VALID").alias("_quarantine_reason")).unionByName(bad.select("_quarantine_reason"))
    return reasons.groupBy("_quarantine_reason").agg(F.count("*").alias("n"))


@query
def cdc_current_state(m: Market) -> DataFrame:
    k, balance = F.col("c_custkey"), F.col("c_acctbal")
    c = m.table("customer")
    old = F.when(k % 7 == 0, None).when(k % 2 == 0, 1).otherwise(10).cast("int").alias("_seq")
    target = cdc.current_state(c.filter(k % 3 != 1).select("c_custkey", balance.alias("balance"), old), None, ["c_custkey"], "_seq")
    source = c.filter(k % 3 != 2).select("c_custkey", F.explode(F.array(F.struct((balance + 1).alias("balance"), F.lit(3).alias("_seq")), F.struct((balance + k % 4).alias("balance"), F.lit(5).alias("_seq")))).alias("r")).select("c_custkey", "r.*")
    return cdc.current_state(source, target, ["c_custkey"], "_seq").drop("_change_hash")


@query
def scd2_apply(m: Market) -> DataFrame:
    return m.seller_loads.table.drop("_change_hash")


@query
def scd2_late(m: Market) -> DataFrame:
    return m.seller_loads.late.drop("_change_hash")


@query
def scd2_overlap_check(m: Market) -> DataFrame:
    from pyspark.sql import Window as W

    before = F.lag("valid_to").over(W.partitionBy("customer_unique_id").orderBy("valid_from"))
    return m.dim_customer.filter("customer_key <> -1").select("customer_unique_id", "valid_from", "valid_to", before.alias("previous_valid_to")).filter("previous_valid_to > valid_from")


@query
def negative_amount_check(m: Market) -> DataFrame:
    return m.fct_order_item.select("order_item_key", "item_amount", "freight_amount").filter("item_amount < 0 or freight_amount < 0")


@query
def one_current_seller_check(m: Market) -> DataFrame:
    return m.dim_seller.filter("seller_key <> -1 and is_current").groupBy("seller_id").agg(F.count("*").alias("n")).filter("n <> 1")


@query
def invalid_transition_check(m: Market) -> DataFrame:
    return m.fct_delivery.select("order_id", "invalid_transition_count").filter("invalid_transition_count > 0")


@query
def temporal_join(m: Market) -> DataFrame:
    facts = m.items.select("order_id", "seller_id").join(m.orders.select("order_id", "purchased_at"), "order_id")
    versions = m.seller_loads.table.withColumn("version_from", F.col("valid_from"))
    return cdc.as_of(facts, versions, "seller_id", "purchased_at", ["state", "version_from"]).select("order_id", "seller_id", "state", F.col("version_from").alias("valid_from"))


# life cycle and sessions


@query
def transition_check(m: Market) -> DataFrame:
    return commerce.transitions(m.delivery_events)


@query
def latest_per_key(m: Market) -> DataFrame:
    return commerce.latest(m.delivery_events, ["order_id"], [F.desc("occurred_at"), F.desc("sequence_number"), F.desc("produced_at")])


@query
def sessionize_30m(m: Market) -> DataFrame:
    return commerce.sessionize(m.clicks, 30)


# schema and hierarchy


@query
def dim_order_status(m: Market) -> DataFrame:
    return gold.dim_order_status(m.spark)


@query
def bridge_category_hierarchy(m: Market) -> DataFrame:
    return gold.bridge_category(m.dim_category)


@query
def category_closure(m: Market) -> DataFrame:
    return analytics.category_links(gold.bridge_category(m.dim_category), m.dim_category)


def _nodes(m: Market) -> DataFrame:
    r = m.table("region").select(F.concat(F.lit("r"), "r_regionkey").alias("category_id"), F.lit(None).cast("string").alias("parent_category_id"), F.col("r_name").alias("category_name"))
    n = m.table("nation").select(F.concat(F.lit("n"), "n_nationkey"), F.concat(F.lit("r"), "n_regionkey"), "n_name")
    s = m.table("supplier").groupBy((F.col("s_suppkey") % 50).alias("g")).agg(F.min_by("s_nationkey", "s_suppkey").alias("nation"))
    return r.union(n).union(s.select(F.concat(F.lit("s"), "g"), F.concat(F.lit("n"), "nation"), F.concat(F.lit("group "), "g")))


@query
def recursive_hierarchy(m: Market) -> DataFrame:
    return analytics.hierarchy(_nodes(m))


@query
def hierarchy_closure(m: Market) -> DataFrame:
    return analytics.closure(_nodes(m))


# analytics, measures, exports


@query
def seller_performance(m: Market) -> DataFrame:
    return analytics.seller_performance(m.sold("seller"))


@query
def delay_streaks(m: Market) -> DataFrame:
    return analytics.delay_streaks(m.fct_delivery)


@query
def funnel_rates(m: Market) -> DataFrame:
    return analytics.funnel_rates(m.fct_funnel_session)


@query
def measure_daily(m: Market) -> DataFrame:
    names = ["gmv", "orders", "average_ticket", "on_time_rate", "failure_rate", "average_review"]
    return analytics.measured({"mart_executive_daily": m.mart_executive_daily, "dim_date": m.dim_date}, names, ["calendar_year"])


@query
def measure_sla(m: Market) -> DataFrame:
    return analytics.measured({"mart_delivery_sla": m.mart_delivery_sla, "dim_date": m.dim_date}, ["orders_at_risk", "late_orders", "average_delay"], ["carrier_code"])


@query
def measure_funnel(m: Market) -> DataFrame:
    return analytics.measured({"mart_funnel_conversion": m.mart_funnel_conversion, "dim_date": m.dim_date}, ["sessions", "purchases", "conversion"], ["traffic_source"])


@query
def measure_seller(m: Market) -> DataFrame:
    return analytics.measured({"mart_seller_scorecard": m.mart_seller_scorecard, "dim_seller": m.dim_seller}, ["seller_gmv", "seller_orders", "seller_on_time_rate"], ["state"])


@query
def measure_cumulative_gmv(m: Market) -> DataFrame:
    return analytics.cumulative_gmv(m.mart_executive_daily)


@query
def export_monthly(m: Market) -> DataFrame:
    return analytics.export_monthly(m.mart_executive_daily)


def _regions(m: Market) -> DataFrame:
    return analytics.export_regions(m.sold("customer", "geography"), m.dim_geography, m.mart_delivery_sla, m.dim_date)


def _sellers(m: Market) -> DataFrame:
    return analytics.export_sellers(m.sold("seller"), m.dim_seller, SALT)


@query
def export_regions(m: Market) -> DataFrame:
    return _regions(m)


@query
def export_sellers(m: Market) -> DataFrame:
    return _sellers(m)


@query
def export_top_sellers(m: Market) -> DataFrame:
    """The dashboard's list: each year's six best sellers."""
    return analytics.top_by(_sellers(m), "year", "gmv", 6).select("year", "id", "gmv")


@query
def export_worst_regions(m: Market) -> DataFrame:
    """The dashboard's table: each year's states, the worst service level first."""
    return analytics.worst_first(_regions(m))


@query
def region_share(m: Market) -> DataFrame:
    return analytics.region_share(_regions(m), REGION)


@query
def quality_score(m: Market) -> DataFrame:
    """Over checks made of the events: a dataset a user, the rate of failure by the event's id."""
    checks = m.table("events").select(F.col("user_id").alias("dataset"), F.col("ts").alias("evaluated_at"), ((F.col("event_id") % 4) / F.lit(4.0)).alias("failure_rate"))
    return analytics.quality_score(checks)


@query
def export_channels(m: Market) -> DataFrame:
    return analytics.export_channels(m.mart_funnel_conversion, gold.dim_date(m.spark))


@query
def export_previous(m: Market) -> DataFrame:
    return analytics.export_previous(analytics.export_monthly(m.mart_executive_daily))


@query
def seller_risk_class(m: Market) -> DataFrame:
    return m.mart_seller_scorecard.select("seller_key", "on_time_delivery_rate", analytics.risk_class(F.col("on_time_delivery_rate")).alias("risk"))


@query
def seller_alias(m: Market) -> DataFrame:
    return m.table("supplier").select("s_suppkey", analytics.seller_alias(F.col("s_suppkey"), SALT).alias("alias"))


@query
def kpi_delta(m: Market) -> DataFrame:
    monthly = analytics.export_monthly(m.mart_executive_daily)
    yearly = monthly.groupBy("year").agg(F.sum("gmv").cast("decimal(28,2)").alias("gmv"))
    before = analytics.export_previous(monthly).select("year", "previous_gmv")
    return yearly.join(before, "year").select("year", "gmv", "previous_gmv", analytics.percent_delta(F.col("gmv"), F.col("previous_gmv")).alias("delta"))


# quality and operations

E = quality.Expectation
_ID = E("order_id_not_null", "order_id", quality.NOT_NULL)
_STATUS = E("valid_order_status", "order_status", quality.ACCEPTED, accepted=ORDER_STATUSES)
_ONE = E("order_id_unique", "order_id", quality.UNIQUE)


@query
def dq_not_null(m: Market) -> DataFrame:
    return quality.judged(quality.failures(m.orders, [_ID, E("delivered_not_null", "delivered_at", quality.NOT_NULL, quality.WARN, 0.5)], "silver_orders"))


@query
def dq_accepted_values(m: Market) -> DataFrame:
    return quality.judged(quality.failures(m.orders, [_STATUS], "silver_orders"))


@query
def dq_between(m: Market) -> DataFrame:
    return quality.judged(quality.failures(m.reviews, [E("score_range", "review_score", quality.BETWEEN, low=1, high=5)], "silver_reviews"))


@query
def dq_unique(m: Market) -> DataFrame:
    items = quality.failures(m.items, [E("item_unique", "order_id, order_item_id", quality.UNIQUE)], "silver_order_items")
    return quality.judged(quality.failures(m.orders, [_ONE], "silver_orders").unionByName(items))


def _products_fk(m: Market) -> DataFrame:
    return quality.integrity(m.items, m.products, "product_id", "product_id", "silver_order_items", "product_fk")


@query
def ref_integrity(m: Market) -> DataFrame:
    some = m.customers.filter(F.col("customer_id").cast("int") % 4 == 0)
    return quality.judged(_products_fk(m).unionByName(quality.integrity(m.orders, some, "customer_id", "customer_id", "silver_orders", "moved_customer_fk")))


@query
def dq_suite(m: Market) -> DataFrame:
    """The gate before the star schema."""
    counts = quality.failures(m.orders, [_ID, _ONE, _STATUS], "silver_orders")
    counts = counts.unionByName(quality.failures(m.items, [E("valid_item_amount", "has_valid_amount", quality.ACCEPTED, accepted=(True,))], "silver_order_items"))
    counts = counts.unionByName(_products_fk(m)).unionByName(quality.integrity(m.items, m.sellers, "seller_id", "seller_id", "silver_order_items", "seller_fk"))
    paid = E("payment_reconciliation", "is_payment_reconciled", quality.ACCEPTED, quality.WARN, 0.05, accepted=(True,))
    return quality.judged(counts.unionByName(quality.failures(m.reconciled, [paid], "silver_financial_reconciliation")))


@query
def operational_health(m: Market) -> DataFrame:
    e = m.table("events")
    failed = F.col("event_type") == "error"
    outcomes = e.select(F.concat(F.lit("run"), F.col("event_id") % 7).alias("run_id"), F.when(F.col("event_id") % 2 == 0, "a").otherwise("b").alias("source"), F.col("ts").alias("recorded_at"), F.when(failed, "FAILED").otherwise("SUCCEEDED").alias("status"), (F.col("event_id") % 100).alias("input_rows"))
    checks = e.select(F.col("user_id").alias("dataset"), F.col("ts").alias("evaluated_at"), (~failed).alias("passed"), F.lit("ERROR").alias("severity"))
    return health.metrics(outcomes, e.filter(failed).select(F.col("ts").alias("_ingested_at")), checks, ntz("2024-01-15"))


@query
def freshness(m: Market) -> DataFrame:
    return health.freshness(m.table("events"), "ts", ntz("2024-02-01 12:00:00"))


# streams and generators


def _payloads(m: Market, fields: dict[str, F.Column], broken: F.Column, invalid: F.Column) -> DataFrame:
    value = F.when(invalid, F.lit("{not json")).otherwise(F.to_json(F.struct(*[c.alias(n) for n, c in fields.items()])))
    return m.table("events").select(value.alias("value"), F.lit("topic").alias("topic"), F.lit(0).cast("long").alias("partition"), F.col("event_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))


def _stamp(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


@query
def stream_parse_delivery(m: Market) -> DataFrame:
    """A batch of payloads, each of the kind that its id says, through the stream's parser."""
    k = F.col("event_id") % 7
    fields = {
        "schema_version": F.when(k == 2, "9.9.9").otherwise("1.0.0"), "event_id": F.when(k != 1, F.col("event_id").cast("string")), "order_id": F.col("user_id").cast("string"), "status": F.when(k == 3, "teleported").otherwise("created"),
        "occurred_at": _stamp("ts"), "produced_at": _stamp("ts"), "location_state": F.when(k == 4, "sp").otherwise("SP"), "carrier_code": F.lit("correios"), "sequence_number": F.lit(1),
    }
    parsed = streams.parse_delivery(_payloads(m, fields, k == 1, k == 0))
    return parsed.select(F.col("_kafka_offset").alias("event_id"), "_quarantine_reason", F.col("event.occurred_at").cast("timestamp_ntz").alias("occurred_at"))


@query
def stream_parse_clicks(m: Market) -> DataFrame:
    k = F.col("event_id") % 5
    fields = {
        "schema_version": F.when(k == 2, "9.9.9").otherwise("1.0.0"), "event_id": F.when(k != 1, F.col("event_id").cast("string")), "user_id": F.col("user_id").cast("string"),
        "event_type": F.when(k == 3, "teleport").otherwise("page_view"), "occurred_at": _stamp("ts"),
    }
    parsed = streams.parse_clicks(_payloads(m, fields, k == 1, k == 0))
    return parsed.select(F.col("_kafka_offset").alias("event_id"), "_quarantine_reason", F.col("event.occurred_at").cast("timestamp_ntz").alias("occurred_at"))


@query
def stream_dedup(m: Market) -> DataFrame:
    """A stream over the folder's events, each id once, run to its end into a table in memory."""
    import uuid

    name = f"souk_once_{uuid.uuid4().hex}"
    events = m.spark.readStream.schema(m.table("events").schema).option("pathGlobFilter", "*").parquet(_folder(m))
    once = streams.once_within(events.select((F.col("event_id") % 500).alias("event_id"), F.col("ts").cast("timestamp").alias("occurred_at")), "60 days")
    q = once.select("event_id").writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return m.spark.table(name)


def _folder(m: Market) -> str:
    path = f"{m.dir}/events.parquet"
    jpath = m.spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(m.spark._jsc.hadoopConfiguration())
    return path if fs.getFileStatus(jpath).isDirectory() else f"{m.dir}/events.parque[t]"


@query
def gen_delivery_events(m: Market) -> DataFrame:
    return generate.delivery_events(m.spark, 1000)


@query
def gen_delivery_counts(m: Market) -> DataFrame:
    """What doesn't hang on hashes: the events of each status, their places and their times."""
    made = generate.delivery_events(m.spark, 1000)
    seconds = F.unix_seconds("occurred_at") - F.unix_seconds(F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return made.groupBy("status", "sequence_number").agg(F.count("*").alias("events"), F.countDistinct("order_id").alias("orders"), F.min(seconds).alias("first_second"), F.max(seconds).alias("last_second"), F.max(F.unix_seconds("produced_at") - F.unix_seconds("occurred_at")).alias("lag"))


@query
def gen_click_counts(m: Market) -> DataFrame:
    """What doesn't hang on hashes: each user's steps run without a gap, a minute and a half apart."""
    made = generate.click_events(m.spark, 1000)
    per = made.groupBy("user_id").agg(F.count("*").alias("n"), F.min("occurred_at").alias("a"), F.max("occurred_at").alias("b"), F.count_if(F.col("event_type") == "page_view").alias("views"))
    spread = F.col("views") == 1, (F.unix_seconds("b") - F.unix_seconds("a")) == 90 * (F.col("n") - 1)
    return per.agg(F.count("*").alias("users"), F.count_if(spread[0]).alias("with_view"), F.count_if(spread[1]).alias("in_step"))


@query
def gen_clickstream(m: Market) -> DataFrame:
    return generate.click_events(m.spark, 1000)
