"""The star schema: dimensions with their unknown members, and facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.functions.columns import date_key, surrogate_key
from souk.functions.parts import spread
from souk.operators.cdc import as_of
from souk.sources.contracts import ORDER_STATUS_ROWS

UNKNOWN = -1
SPINE = ("2016-01-01", "2030-12-31")


def _with_unknown(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """``df`` and one row more, the values cast to its types, null where none is given."""
    row = df.sparkSession.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema.fields])
    return df.unionByName(row)


def dim_date(spark: SparkSession, start: str = SPINE[0], end: str = SPINE[1]) -> DataFrame:
    d = F.col("full_date")
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))).alias("full_date"))
    monday = F.weekday(d)
    return days.select(
        date_key(d).alias("date_key"), "full_date", F.year(d).alias("calendar_year"), F.quarter(d).alias("calendar_quarter"), F.month(d).alias("calendar_month"),
        F.dayofmonth(d).alias("day_of_month"), F.dayofyear(d).alias("day_of_year"), (monday + 1).alias("iso_day_of_week"), F.date_sub(d, monday).alias("week_started_at"),
        F.last_day(d).alias("month_ended_at"), (monday >= 5).cast("int").alias("is_weekend"),
    )


_VERSION = {"valid_from": "1900-01-01 00:00:00", "is_current": True, "created_run_id": "system", "updated_run_id": "system"}


def _party(history: DataFrame, who: str, key: str) -> DataFrame:
    made = history.select(
        surrogate_key(F.lit(who), key, F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss")).alias(f"{who}_key"), key, "zip_code_prefix", "city", "state", "valid_from", "valid_to", "is_current", "created_run_id", "updated_run_id",
    )
    return _with_unknown(made, {f"{who}_key": UNKNOWN, key: "UNKNOWN", "city": "unknown", "state": "NA"} | _VERSION)


def dim_customer(history: DataFrame) -> DataFrame:
    return _party(history, "customer", "customer_unique_id")


def dim_seller(history: DataFrame) -> DataFrame:
    return _party(history, "seller", "seller_id")


PRODUCT = (*(f"product_{c}" for c in ("photos_quantity", "name_length", "description_length")), *"volume_cm3 width_cm height_cm length_cm weight_g".split())


def category_key(name: Column | str) -> Column:
    """The key of a category; ``unknown`` is the unknown member."""
    c = F.col(name) if isinstance(name, str) else name
    return F.when(c.isNull() | (c == "unknown"), F.lit(UNKNOWN).cast("long")).otherwise(surrogate_key(F.lit("category"), c))


def dim_product(history: DataFrame) -> DataFrame:
    made = history.select(
        surrogate_key(F.lit("product"), "product_id", F.date_format("valid_from", "yyyy-MM-dd HH:mm:ss")).alias("product_key"), category_key("category_name").alias("category_key"), "product_id", "category_name", *PRODUCT, "valid_from", "valid_to", "is_current", "created_run_id", "updated_run_id",
    )
    return _with_unknown(made, {"product_key": UNKNOWN, "category_key": UNKNOWN, "product_id": "UNKNOWN", "category_name": "unknown"} | _VERSION)


def dim_category(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Distinct names, one unknown member, and the English name where there is a translation."""
    names = products.select("category_name").filter("category_name is not null and category_name <> 'unknown'").distinct()
    english = translation.groupBy("category_name").agg(F.min("category_name_english").alias("category_name_english"))
    made = names.join(english, "category_name", "left").select(category_key("category_name").alias("category_key"), "category_name", "category_name_english")
    return _with_unknown(made, {"category_key": UNKNOWN, "category_name": "unknown"})


def bridge_category(categories: DataFrame) -> DataFrame:
    """Self links: the taxonomy is flat."""
    return categories.select(F.col("category_key").alias("ancestor_category_key"), F.col("category_key").alias("descendant_category_key"), F.lit(0).alias("depth"), F.lit(True).alias("is_self"))


def dim_geography(geography: DataFrame) -> DataFrame:
    made = geography.select(surrogate_key(F.lit("geography"), "zip_code_prefix").alias("geography_key"), "zip_code_prefix", "latitude", "longitude", "city", "state", "source_coordinate_count")
    return _with_unknown(made, {"geography_key": UNKNOWN, "city": "unknown", "state": "NA", "source_coordinate_count": 0})


def dim_order_status(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ORDER_STATUS_ROWS, "order_status_key int, order_status string, status_group string")


def staged(df: DataFrame, dropped: tuple[str, ...]) -> DataFrame:
    """A staging projection: the entity without its checks."""
    return df.drop(*dropped)


def _known(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(UNKNOWN).cast("long")).alias(c)


def _status_key(c: str) -> Column:
    pairs = [F.lit(x) for k, s, _ in ORDER_STATUS_ROWS if k > 0 for x in (s, k)]
    return F.coalesce(F.create_map(*pairs)[F.col(c)], F.lit(UNKNOWN))


def _bought_by(orders: DataFrame, customers: DataFrame) -> DataFrame:
    return orders.join(customers.select("customer_id", "customer_unique_id"), "customer_id", "left")


def fct_order_item(items: DataFrame, orders: DataFrame, customers: DataFrame, customer: DataFrame | None, seller: DataFrame | None, product: DataFrame | None, geography: DataFrame | None) -> DataFrame:
    """Each item with the versions of its customer, seller and product valid when it was bought, and that customer's geography.

    Orders meet their customer's version before the items, so that join is as long as the orders. A dimension that is
    None isn't joined and its key left out: for what doesn't need it, as a range join can't be pruned.
    """
    keys = [k for k, d in (("customer_key", customer), ("seller_key", seller), ("product_key", product), ("customer_geography_key", geography)) if d is not None]
    o = orders
    if customer is not None or geography is not None:
        if customer is None:
            raise ValueError("the geography is that of the customer's version")
        o = as_of(_bought_by(orders, customers), customer, "customer_unique_id", "purchased_at", ["customer_key", "zip_code_prefix"])
    if geography is not None:
        o = o.join(geography.filter("zip_code_prefix is not null").select("zip_code_prefix", F.col("geography_key").alias("customer_geography_key")), "zip_code_prefix", "left")
    held = [k for k in ("customer_key", "customer_geography_key") if k in keys]
    o = o.select("order_id", *held, "purchased_at", "delivered_at", "estimated_delivery_at", "delivery_lead_days", "delivery_delay_days", "is_delivered_on_time", "is_delivered", "is_terminal_failure", "order_status")
    i = items.select("order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_at", "item_amount", "freight_amount", "gross_amount")
    i = i.join(spread(o, "order_id", by=i), "order_id")
    if seller is not None:
        i = as_of(i, seller, "seller_id", "purchased_at", ["seller_key"])
    if product is not None:
        i = as_of(i, product, "product_id", "purchased_at", ["product_key"])
    return i.select(
        surrogate_key(F.lit("order_item"), "order_id", "order_item_id").alias("order_item_key"), "order_id", "order_item_id",
        *map(_known, keys), date_key("purchased_at").alias("purchase_date_key"), _status_key("order_status").alias("order_status_key"),
        "purchased_at", "delivered_at", "estimated_delivery_at", "delivery_lead_days", "delivery_delay_days", "is_delivered_on_time", "is_delivered", "is_terminal_failure", "shipping_limit_at", "item_amount", "freight_amount", "gross_amount",
    )


def fct_payment(payments: DataFrame, orders: DataFrame, customers: DataFrame, customer: DataFrame | None) -> DataFrame:
    """Each payment with its customer's version; without ``customer`` that isn't joined and its key left out."""
    o, keys = orders, []
    if customer is not None:
        o, keys = as_of(_bought_by(orders, customers), customer, "customer_unique_id", "purchased_at", ["customer_key"]), ["customer_key"]
    return payments.join(o.select("order_id", *keys, "purchased_at"), "order_id").select(
        surrogate_key(F.lit("payment"), "order_id", "payment_sequence").alias("payment_key"), "order_id", "payment_sequence", *map(_known, keys), date_key("purchased_at").alias("purchase_date_key"), "payment_type", "installments", "payment_amount", "purchased_at",
    )


def fct_delivery(snapshot: DataFrame, orders: DataFrame) -> DataFrame:
    s = snapshot.select("order_id", "latest_delivery_status", "latest_event_at", "latest_event_received_at", "location_state", "carrier_code", "is_at_risk", "invalid_transition_count", "delivery_event_count", "event_arrival_lag_minutes")
    return s.join(orders, "order_id").select(
        surrogate_key(F.lit("delivery"), "order_id").alias("delivery_key"), "order_id", date_key("purchased_at").alias("purchase_date_key"), date_key("delivered_at").alias("delivered_date_key"), "order_status",
        "latest_delivery_status", "latest_event_at", "latest_event_received_at", "location_state", "carrier_code", "purchased_at", "estimated_delivery_at", "delivered_at", "delivery_lead_days", "delivery_delay_days",
        "is_delivered_on_time", "is_at_risk", "invalid_transition_count", "delivery_event_count", "event_arrival_lag_minutes",
    )


def fct_review(reviews: DataFrame, orders: DataFrame) -> DataFrame:
    return reviews.join(orders.select("order_id", "delivery_delay_days", "is_delivered_on_time"), "order_id").select(
        surrogate_key(F.lit("review"), "review_id", "order_id").alias("review_key"), "review_id", "order_id", date_key("review_created_at").alias("review_date_key"), "review_score", "review_title", "review_message", "review_created_at", "review_answered_at", "delivery_delay_days", "is_delivered_on_time",
    )


def fct_funnel_session(sessions: DataFrame) -> DataFrame:
    return sessions.select(
        surrogate_key(F.lit("session"), "session_id").alias("session_key"), "session_id", "user_id", date_key("session_started_at").alias("session_date_key"), "session_started_at", "session_ended_at", "session_duration_seconds",
        "event_count", "distinct_product_count", "has_product_view", "has_add_to_cart", "has_checkout", "has_purchase", "device_type", "traffic_source",
    )


def fct_order_reconciliation(reconciled: DataFrame) -> DataFrame:
    return reconciled.select(
        surrogate_key(F.lit("reconciliation"), "order_id").alias("reconciliation_key"), "order_id", date_key("purchased_at").alias("purchase_date_key"), "order_status", "purchased_at", "item_amount", "freight_amount",
        "expected_payment_amount", "actual_payment_amount", "payment_difference", "item_count", "seller_count", "payment_record_count", "payment_method_count", "is_payment_reconciled", "reconciliation_status",
    )
