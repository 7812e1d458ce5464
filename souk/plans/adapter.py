"""Marketplace-shaped sources, entities, star schema and marts over the driver's order tables.

Every frame is a plan built on first use; nothing is computed or kept.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.parts import spread
from souk.operators import cdc, commerce, silver
from souk.plans import gold, marts

SPINE = ("1995-01-01", "2001-12-31")
AS_OF = "2000-01-01 00:00:00"


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


class Market:
    """The tables of one folder as a marketplace."""

    def __init__(self, spark: SparkSession, sf_dir: str, session_minutes: int = 720):
        self.spark, self.dir, self.minutes = spark, sf_dir, session_minutes

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # raw sources

    @cached_property
    def raw_customers(self) -> DataFrame:
        k = F.col("c_custkey").cast("string")
        return self.table("customer").select(k.alias("customer_id"), F.concat(F.lit("u"), k).alias("customer_unique_id"), F.col("c_nationkey").alias("customer_zip_code_prefix"), F.col("c_mktsegment").alias("customer_city"), F.concat(F.lit(" n"), "c_nationkey").alias("customer_state"))

    @cached_property
    def raw_sellers(self) -> DataFrame:
        return self.table("supplier").select(F.col("s_suppkey").cast("string").alias("seller_id"), F.col("s_nationkey").alias("seller_zip_code_prefix"), F.concat(F.lit(" São  "), "s_name").alias("seller_city"), F.concat(F.lit("n"), "s_nationkey").alias("seller_state"))

    @cached_property
    def raw_products(self) -> DataFrame:
        size = F.col("p_size")
        return self.table("part").select(
            F.col("p_partkey").cast("string").alias("product_id"), F.when(F.col("p_partkey") % 50 != 0, F.col("p_type")).alias("product_category_name"), F.length("p_name").alias("product_name_lenght"), F.length("p_brand").alias("product_description_lenght"),
            (size % 7).alias("product_photos_qty"), (size * 10).alias("product_weight_g"), size.alias("product_length_cm"), (size + 1).alias("product_height_cm"), (size + 2).alias("product_width_cm"),
        )

    @cached_property
    def raw_orders(self) -> DataFrame:
        shipped = spread(self.table("lineitem"), "l_orderkey").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.max("l_shipdate").alias("last_ship"))
        status = F.when(F.col("o_orderkey") % 50 == 0, "canceled").when(F.col("o_orderstatus") == "F", "delivered").when(F.col("o_orderstatus") == "O", "shipped").otherwise("processing")
        joined = self.table("orders").join(shipped, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("status", status)
        return joined.select(
            F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_custkey").cast("string").alias("customer_id"), F.concat(F.lit(" "), F.initcap("status")).alias("order_status"), F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.expr("o_orderdate + make_dt_interval(0, cast(o_orderkey % 48 as int))").alias("order_approved_at"), F.col("first_ship").alias("order_delivered_carrier_date"),
            F.when(F.col("status") == "delivered", F.col("last_ship")).alias("order_delivered_customer_date"), F.expr("o_orderdate + INTERVAL 720 DAYS").alias("order_estimated_delivery_date"),
        )

    @cached_property
    def raw_items(self) -> DataFrame:
        price = F.col("l_extendedprice").cast("decimal(18,2)")
        return self.table("lineitem").select(
            F.col("l_orderkey").cast("string").alias("order_id"), F.col("l_linenumber").alias("order_item_id"), F.col("l_partkey").cast("string").alias("product_id"), F.col("l_suppkey").cast("string").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"), price.alias("price"), (price * F.col("l_tax").cast("decimal(4,2)")).cast("decimal(18,2)").alias("freight_value"),
        )

    @cached_property
    def raw_payments(self) -> DataFrame:
        return self.table("orders").filter("o_orderkey % 10 <> 0").select(F.col("o_orderkey").cast("string").alias("order_id"), F.lit(1).alias("payment_sequential"), F.col("o_orderpriority").alias("payment_type"), (F.col("o_orderkey") % 12).alias("payment_installments"), F.col("o_totalprice").cast("decimal(18,2)").alias("payment_value"))

    @cached_property
    def raw_reviews(self) -> DataFrame:
        k = F.col("o_orderkey")
        return self.table("orders").filter("o_orderkey % 4 = 0").select(
            F.concat(F.lit("r"), k).alias("review_id"), k.cast("string").alias("order_id"), (k % 6).alias("review_score"), F.concat(F.lit(" "), "o_orderpriority").alias("review_comment_title"), F.when(k % 3 != 0, F.concat("o_orderpriority", F.lit("  "))).alias("review_comment_message"),
            F.expr("o_orderdate + INTERVAL 30 DAYS").alias("review_creation_date"), F.expr("o_orderdate + INTERVAL 32 DAYS").alias("review_answer_timestamp"),
        )

    @cached_property
    def raw_geolocation(self) -> DataFrame:
        return self.table("customer").select(F.col("c_nationkey").alias("geolocation_zip_code_prefix"), (F.col("c_acctbal") / 100).alias("geolocation_lat"), (F.col("c_acctbal") / -50).alias("geolocation_lng"), F.col("c_mktsegment").alias("geolocation_city"), F.concat(F.lit("n"), F.col("c_nationkey") % 5).alias("geolocation_state"))

    @cached_property
    def raw_translation(self) -> DataFrame:
        return self.table("part").select(F.col("p_type").alias("product_category_name"), F.concat(F.lit("English "), "p_type").alias("product_category_name_english")).distinct()

    # entities

    @cached_property
    def customers(self) -> DataFrame:
        return silver.customers(self.raw_customers)

    @cached_property
    def sellers(self) -> DataFrame:
        return silver.sellers(self.raw_sellers)

    @cached_property
    def products(self) -> DataFrame:
        return silver.products(self.raw_products)

    @cached_property
    def orders(self) -> DataFrame:
        return silver.orders(self.raw_orders)

    @cached_property
    def items(self) -> DataFrame:
        return silver.order_items(self.raw_items)

    @cached_property
    def payments(self) -> DataFrame:
        return silver.payments(self.raw_payments)

    @cached_property
    def reviews(self) -> DataFrame:
        return silver.reviews(self.raw_reviews)

    @cached_property
    def translation(self) -> DataFrame:
        return silver.category_translation(self.raw_translation)

    @cached_property
    def geography(self) -> DataFrame:
        return silver.geography(self.raw_geolocation)

    @cached_property
    def clicks(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        kind = F.create_map(*[F.lit(x) for x in ("view", "product_view", "click", "add_to_cart", "signup", "checkout", "purchase", "purchase", "error", "error")])[F.col("event_type")]
        return self.table("events").select("event_id", "user_id", kind.alias("event_type"), F.col("ts").alias("occurred_at"), k.alias("product_id"), F.concat(F.lit("d"), k % 3).alias("device_type"), F.concat(F.lit("s"), k % 4).alias("traffic_source"))

    @cached_property
    def delivery_events(self) -> DataFrame:
        """Each event is of the order whose id is that of its user; carriers and states follow the user."""
        status = F.create_map(*[F.lit(x) for x in ("view", "created", "click", "approved", "signup", "invoiced", "purchase", "shipped", "error", "exception")])[F.col("event_type")]
        return self.table("events").select(
            F.col("event_id").cast("string").alias("event_id"), F.col("user_id").cast("string").alias("order_id"), status.alias("status"), F.col("ts").alias("occurred_at"), F.expr("ts + make_dt_interval(0, 0, cast(get_json_object(props, '$.k') as int))").alias("produced_at"),
            F.concat(F.lit("S"), F.col("user_id") % 5).alias("location_state"), F.concat(F.lit("carrier_"), F.col("user_id") % 3).alias("carrier_code"), F.col("event_id").cast("int").alias("sequence_number"),
        )

    @cached_property
    def sessions(self) -> DataFrame:
        return commerce.sessionize(self.clicks, self.minutes)

    @cached_property
    def reconciled(self) -> DataFrame:
        return commerce.reconcile(self.orders, self.items, self.payments)

    @cached_property
    def snapshot(self) -> DataFrame:
        return commerce.delivery_snapshot(self.orders, self.delivery_events, ntz(AS_OF))

    # histories

    PLACE = ["zip_code_prefix", "city", "state"]

    @cached_property
    def seller_batch(self) -> DataFrame:
        """The second load: every fifth seller moved in 1998; of the others every seventh says so for 1989, too late."""
        k = F.col("seller_id").cast("int")
        moved = self.sellers.filter((k % 5 == 0) | (k % 7 == 0))
        return moved.withColumn("state", F.concat("state", F.lit("2"))).withColumn("effective_at", F.when(k % 5 == 0, ntz("1998-01-01")).otherwise(ntz("1989-01-01")))

    @cached_property
    def seller_loads(self) -> cdc.History:
        first = cdc.scd2(self.sellers.withColumn("effective_at", ntz("1990-01-01")), None, ["seller_id"], self.PLACE, "effective_at", "r1").table
        return cdc.scd2(self.seller_batch, first, ["seller_id"], self.PLACE, "effective_at", "r2")

    @cached_property
    def customer_history(self) -> DataFrame:
        key = ["customer_unique_id"]
        base = self.customers.drop("customer_id")
        first = cdc.scd2(base.withColumn("effective_at", ntz("1990-01-01")), None, key, self.PLACE, "effective_at", "r1").table
        moved = base.filter(F.substring("customer_unique_id", 2, 20).cast("int") % 4 == 0).withColumn("city", F.lit("moved")).withColumn("effective_at", ntz("1997-06-01"))
        return cdc.scd2(moved, first, key, self.PLACE, "effective_at", "r2").table

    @cached_property
    def product_history(self) -> DataFrame:
        return cdc.scd2(self.products.withColumn("effective_at", ntz("1990-01-01")), None, ["product_id"], ["category_name", *gold.PRODUCT], "effective_at", "r1").table

    # star schema

    @cached_property
    def dim_date(self) -> DataFrame:
        return gold.dim_date(self.spark, *SPINE)

    @cached_property
    def dim_customer(self) -> DataFrame:
        return gold.dim_customer(self.customer_history)

    @cached_property
    def dim_seller(self) -> DataFrame:
        return gold.dim_seller(self.seller_loads.table)

    @cached_property
    def dim_product(self) -> DataFrame:
        return gold.dim_product(self.product_history)

    @cached_property
    def dim_category(self) -> DataFrame:
        return gold.dim_category(self.product_history, self.translation)

    @cached_property
    def dim_geography(self) -> DataFrame:
        return gold.dim_geography(self.geography)

    @cached_property
    def fct_order_item(self) -> DataFrame:
        return gold.fct_order_item(self.items, self.orders, self.customers, self.dim_customer, self.dim_seller, self.dim_product, self.dim_geography)

    def sold(self, *dimensions: str) -> DataFrame:
        """Items as in ``fct_order_item``, with the keys of these dimensions alone (the geography needs the customer)."""
        return gold.fct_order_item(self.items, self.orders, self.customers, *[getattr(self, f"dim_{d}") if d in dimensions else None for d in ("customer", "seller", "product", "geography")])

    @cached_property
    def fct_payment(self) -> DataFrame:
        return gold.fct_payment(self.payments, self.orders, self.customers, self.dim_customer)

    @cached_property
    def fct_delivery(self) -> DataFrame:
        return gold.fct_delivery(self.snapshot, self.orders)

    @cached_property
    def fct_review(self) -> DataFrame:
        return gold.fct_review(self.reviews, self.orders)

    @cached_property
    def fct_funnel_session(self) -> DataFrame:
        return gold.fct_funnel_session(self.sessions)

    @cached_property
    def fct_order_reconciliation(self) -> DataFrame:
        return gold.fct_order_reconciliation(self.reconciled)

    # marts

    @cached_property
    def mart_executive_daily(self) -> DataFrame:
        return marts.executive_daily(self.dim_date, self.sold(), gold.fct_payment(self.payments, self.orders, self.customers, None), self.fct_review)

    @cached_property
    def mart_seller_scorecard(self) -> DataFrame:
        return marts.seller_scorecard(self.sold("seller"))

    @cached_property
    def mart_delivery_sla(self) -> DataFrame:
        return marts.delivery_sla(self.fct_delivery)

    @cached_property
    def mart_funnel_conversion(self) -> DataFrame:
        return marts.funnel_conversion(self.fct_funnel_session)

    @cached_property
    def mart_customer_cohort(self) -> DataFrame:
        return marts.customer_cohort(self.sold("customer"))
