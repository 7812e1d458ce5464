"""Conformed entities from the raw sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.functions.columns import norm_text, seconds_between
from souk.sources.contracts import ORDER_STATUSES

TECHNICAL = frozenset(f"_{c}" for c in "run_id ingested_at source_file_hash record_hash".split())
_KINDS = {"text": norm_text, "trim": F.trim, "code": lambda c: F.upper(F.trim(c)), "money": lambda c: F.col(c).cast("decimal(18,2)"), "int": lambda c: F.col(c).cast("int"), "double": lambda c: F.col(c).cast("double"), "as": F.col}


def shaped(df: DataFrame, spec: str, *more: Column, prefix: str = "") -> DataFrame:
    """A projection written as lines ``target kind source``; a line of one name keeps that column.

    ``prefix`` goes before each source. Then come ``more`` and the technical columns that ``df`` has.
    """
    out = []
    for line in filter(None, (x.strip() for x in spec.splitlines())):
        if " " not in line:
            out.append(F.col(line))
            continue
        target, kind, source = line.split()
        out.append(_KINDS[kind](prefix + source).alias(target))
    return df.select(*out, *more, *[c for c in df.columns if c in TECHNICAL])


_PLACE = """
    zip_code_prefix int zip_code_prefix
    city text city
    state code state"""


def customers(df: DataFrame) -> DataFrame:
    keys = [F.col(f"customer_{k}") for k in ("id", "unique_id")]
    return shaped(df, _PLACE, *keys, prefix="customer_")


def sellers(df: DataFrame) -> DataFrame:
    return shaped(df, _PLACE, F.col("seller_id"), prefix="seller_")


def products(df: DataFrame) -> DataFrame:
    """A missing category is ``unknown``; the volume is computed in longs, as the product of three ints may not fit one."""
    sides = [F.col(f"product_{s}_cm").cast("long") for s in ("length", "height", "width")]
    measures = """
        weight_g int weight_g
        length_cm int length_cm
        height_cm int height_cm
        width_cm int width_cm
        product_photos_quantity int photos_qty
        product_name_length int name_lenght
        product_description_length int description_lenght"""
    name = F.coalesce(norm_text("product_category_name"), F.lit("unknown"))
    return shaped(df, measures, F.col("product_id"), name.alias("category_name"), (sides[0] * sides[1] * sides[2]).alias("volume_cm3"), prefix="product_")


def orders(df: DataFrame) -> DataFrame:
    """Lead times, delay in calendar days, and whether delivery was on time: null while it isn't delivered."""
    moments = """
        purchased_at as order_purchase_timestamp
        approved_at as order_approved_at
        delivered_at as order_delivered_customer_date
        estimated_delivery_at as order_estimated_delivery_date
        handed_to_carrier_at as order_delivered_carrier_date
        order_id
        customer_id"""
    known = shaped(df, moments, F.lower(F.trim("order_status")).alias("order_status"))
    due, at = F.col("estimated_delivery_at"), F.col("delivered_at")
    since = {c: seconds_between(F.col(c), F.col("purchased_at")) for c in ("approved_at", "delivered_at")}
    late = known.withColumns({"delivery_delay_days": F.datediff(F.to_date(at), F.to_date(due)), "approval_lead_hours": since["approved_at"] / F.lit(3600.0), "delivery_lead_days": since["delivered_at"] / F.lit(86400.0)})
    failed = F.col("order_status").isin("unavailable", "canceled")
    flags = {"is_delivered": F.col("order_status") == "delivered", "is_terminal_failure": failed, "is_valid_status": F.col("order_status").isin(*ORDER_STATUSES), "is_delivered_on_time": F.col("delivery_delay_days") <= 0}
    return late.withColumns(flags)


def order_items(df: DataFrame) -> DataFrame:
    lines = """
        order_id
        order_item_id int order_item_id
        seller_id
        product_id
        item_amount money price
        freight_amount money freight_value
        shipping_limit_at as shipping_limit_date"""
    both = [F.col("item_amount"), F.col("freight_amount")]
    return shaped(df, lines).withColumns({"gross_amount": (both[0] + both[1]).cast("decimal(18,2)"), "has_valid_amount": F.least(*both) >= 0})


def payments(df: DataFrame) -> DataFrame:
    lines = """
        payment_amount money value
        payment_sequence int sequential
        installments int installments
        payment_type text type"""
    valid = (F.col("installments") >= 0) & (F.col("payment_amount") >= 0)
    return shaped(df, lines, F.col("order_id"), prefix="payment_").withColumn("has_valid_payment", valid)


def reviews(df: DataFrame) -> DataFrame:
    lines = """
        review_title trim comment_title
        review_message trim comment_message
        review_score int score
        review_answered_at as answer_timestamp
        review_created_at as creation_date"""
    return shaped(df, lines, F.col("order_id"), F.col("review_id"), prefix="review_").withColumn("has_valid_score", F.col("review_score").between(1, 5))


def category_translation(df: DataFrame) -> DataFrame:
    return shaped(df, "category_name_english text name_english\ncategory_name text name", prefix="product_category_")


def geography(df: DataFrame) -> DataFrame:
    """A row for each zip prefix: lower medians of the coordinates (1 in 10,000), the most frequent city and state (ties: the least)."""
    points = shaped(df, _PLACE + "\nlongitude double lng\nlatitude double lat", prefix="geolocation_")
    middle = {c: F.percentile_approx(c, 0.5, 10_000) for c in ("longitude", "latitude")}
    usual = {c: F.mode(c, True) for c in ("state", "city")}
    return points.groupBy("zip_code_prefix").agg(F.count("*").alias("source_coordinate_count"), *[v.alias(k) for k, v in (middle | usual).items()])
