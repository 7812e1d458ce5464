"""Daily and entity marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.functions.columns import divided, mean4, money, ratio
from souk.functions.parts import spread


def executive_daily(dates: DataFrame, items: DataFrame, payments: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """A row for every day of the spine; days without sales have zeros, without reviews a null average.

    Items are rolled up to orders first: the flags are the order's own, so its distinct counts become plain ones
    (no expanded rows), and the second aggregate is as long as the orders. Reviews count on the day they were written.
    """
    flags = [F.max(c).alias(c) for c in ("is_delivered", "is_terminal_failure", "is_delivered_on_time")]
    per = items.groupBy("purchase_date_key", "order_id").agg(*[money(F.sum(c)).alias(c) for c in ("item_amount", "freight_amount", "gross_amount")], *flags)
    sales = per.groupBy(F.col("purchase_date_key").alias("date_key")).agg(
        F.count("*").alias("order_count"), money(F.sum("item_amount")).alias("item_revenue"), money(F.sum("freight_amount")).alias("freight_revenue"), money(F.sum("gross_amount")).alias("gmv"),
        F.count_if("is_delivered").alias("delivered_order_count"), F.count_if("is_terminal_failure").alias("failed_order_count"), F.count_if("is_delivered_on_time").alias("on_time_order_count"), F.count_if(~F.col("is_delivered_on_time")).alias("late_order_count"),
    )
    paid = payments.groupBy(F.col("purchase_date_key").alias("date_key")).agg(money(F.sum("payment_amount")).alias("payment_amount"))
    out = dates.select("date_key", "full_date").join(sales, "date_key", "left").join(paid, "date_key", "left")
    if reviews is None:
        out = out.withColumn("average_review_score", F.lit(None).cast("decimal(18,4)"))
    else:
        out = out.join(reviews.groupBy(F.col("review_date_key").alias("date_key")).agg(mean4(F.col("review_score")).alias("average_review_score")), "date_key", "left")
    counts = ("order_count", "delivered_order_count", "failed_order_count", "on_time_order_count", "late_order_count")
    amounts = ("item_revenue", "freight_revenue", "gmv", "payment_amount")
    zeros = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in counts} | {c: money(F.coalesce(F.col(c), F.lit(0).cast("decimal(28,2)"))) for c in amounts}
    return out.withColumns(zeros).select("date_key", "full_date", "order_count", *amounts, *counts[1:], "average_review_score")


def seller_scorecard(items: DataFrame) -> DataFrame:
    """A row for each seller version. Its orders are rolled up first, with the sums that the averages need."""
    per = spread(items, "order_id").groupBy("seller_key", "order_id").agg(
        *[money(F.sum(c)).alias(c) for c in ("item_amount", "freight_amount", "gross_amount")],
        F.sum("delivery_delay_days").alias("delay"), F.count("delivery_delay_days").alias("delays"), F.max("is_delivered").alias("delivered"), F.max("is_delivered_on_time").alias("on_time"), F.max("purchased_at").alias("at"),
    )
    return per.groupBy("seller_key").agg(
        F.count("*").alias("order_count"), money(F.sum("item_amount")).alias("item_revenue"), money(F.sum("freight_amount")).alias("freight_revenue"), money(F.sum("gross_amount")).alias("gmv"),
        divided(F.sum("delay"), F.sum("delays"), 4, "decimal(18,4)").alias("average_delay_days"),
        ratio(F.count_if("on_time"), F.count_if("delivered")).alias("on_time_delivery_rate"), F.max("at").alias("last_order_at"),
    )


def delivery_sla(deliveries: DataFrame) -> DataFrame:
    """Day, carrier, state; orders without events under null."""
    return deliveries.groupBy(F.col("purchase_date_key").alias("date_key"), "carrier_code", "location_state").agg(
        F.count("*").alias("order_count"), F.count_if("is_at_risk").alias("at_risk_order_count"), F.count_if("is_delivered_on_time").alias("on_time_order_count"), F.count_if(~F.col("is_delivered_on_time")).alias("late_order_count"),
        mean4(F.col("delivery_lead_days")).alias("average_delivery_lead_days"), mean4(F.col("delivery_delay_days")).alias("average_delivery_delay_days"), F.coalesce(F.sum("invalid_transition_count"), F.lit(0)).alias("invalid_transition_count"),
    )


def funnel_conversion(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(F.col("session_date_key").alias("date_key"), "device_type", "traffic_source").agg(
        F.count("*").alias("session_count"), F.count_if("has_product_view").alias("product_view_sessions"), F.count_if("has_add_to_cart").alias("cart_sessions"), F.count_if("has_checkout").alias("checkout_sessions"), F.count_if("has_purchase").alias("purchase_sessions"),
    )


def customer_cohort(items: DataFrame) -> DataFrame:
    """Customers active so many months after their first purchase. The first purchase is a window minimum, not a self-join, and
    months are made distinct before the count, so both share the partitioning by customer."""
    active = items.filter("customer_key <> -1 and not is_terminal_failure").select("customer_key", F.trunc(F.to_date("purchased_at"), "month").alias("month")).distinct()
    first = F.min("month").over(W.partitionBy("customer_key"))
    months = (F.year("month") - F.year("cohort_month")) * 12 + F.month("month") - F.month("cohort_month")
    return active.withColumn("cohort_month", first).groupBy("cohort_month", months.alias("months_since_first_purchase")).agg(F.count("*").alias("retained_customer_count"))
