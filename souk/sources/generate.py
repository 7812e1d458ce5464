"""Distributed generators of delivery and click events; the same arguments give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from souk.sources.contracts import EVENT_VERSION, STEPS

STATES = ("SP", "RJ", "MG", "RS", "PR", "BA", "SC")
CARRIERS = ("correios", "transportadora_sul", "rapido_sudeste", "logistica_norte")
DEVICES = ("mobile", "desktop", "tablet")
SOURCES = ("organic", "paid_search", "social", "email", "direct")


def _pick(values: tuple[str, ...], h: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(h, F.lit(len(values))) + 1).cast("int"))


def _uuid(*parts: Column | str) -> Column:
    """A name-based identifier in the form of a UUID, from SHA-256."""
    digest = F.sha2(F.concat_ws(":", F.lit("souk"), *parts), 256)
    return F.regexp_replace(digest, "^(.{8})(.{4}).(.{3}).(.{3})(.{12}).*$", "$1-$2-5$3-a$4-$5")


def _share(seed: int, what: str, *parts: str) -> Column:
    """A number in [0, 1) from the parts' hash."""
    return F.pmod(F.xxhash64(*parts, F.lit(what), F.lit(seed)), F.lit(1_000_000)) / F.lit(1_000_000.0)


def delivery_events(spark: SparkSession, orders: int | DataFrame, seed: int = 42, base: str = "2026-01-01 00:00:00", partitions: int | None = None, duplicates: float = 0.0, late: float = 0.0) -> DataFrame:
    """Seven events an order along the happy path; shares of them are sent again under a new id, or produced two days late.

    ``orders``: how many, named by number, or a DataFrame of existing ids (order_id), which start within a year by their hash.
    """
    if isinstance(orders, DataFrame):
        given = orders.select(F.col("order_id").cast("string").alias("order_id")).filter("order_id is not null").distinct()
        if given.isEmpty():
            raise ValueError("there are no order ids")
        named = given.select(F.pmod(F.xxhash64("order_id", F.lit(seed)), F.lit(175_200)).alias("id"), "order_id")
        named = named.repartition(partitions, "order_id") if partitions else named
    elif orders <= 0:
        raise ValueError("the number of orders must be positive")
    else:
        named = spark.range(1, 1 + orders, numPartitions=partitions).select("id", F.format_string("synthetic_order_%012d", "id").alias("order_id"))
    rows = named.select("id", "order_id", F.posexplode(F.array(*map(F.lit, STEPS))).alias("step", "status"))
    rows = rows.withColumn("sequence_number", 1 + F.col("step"))
    minutes = 360 * F.col("sequence_number") + 3 * F.col("id")
    at = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(base))) + 60 * minutes)
    delay = F.when(_share(seed, "late", "order_id", "sequence_number") < late, F.expr("INTERVAL 2 DAYS")).otherwise(F.expr("INTERVAL 5 MINUTES"))
    h, origin = F.xxhash64("order_id", F.lit(seed)), {"generator_seed": str(seed), "synthetic": "true"}
    made = rows.select(
        _uuid("order_id", F.col("sequence_number").cast("string")).alias("event_id"), F.lit(EVENT_VERSION).alias("schema_version"), "status", "order_id", (at + delay).alias("produced_at"), at.alias("occurred_at"),
        _pick(CARRIERS, F.shiftright(h, 8)).alias("carrier_code"), _pick(STATES, h).alias("location_state"), F.create_map(*[F.lit(x) for kv in origin.items() for x in kv]).alias("attributes"), "sequence_number",
    )
    if not duplicates:
        return made
    again = made.filter(_share(seed, "again", "order_id", "sequence_number") < duplicates)
    return made.unionByName(again.withColumn("event_id", _uuid("order_id", F.col("sequence_number").cast("string"), F.lit("again"))))


def click_events(spark: SparkSession, users: int, seed: int = 42, base: str = "2026-01-01 00:00:00", partitions: int | None = None) -> DataFrame:
    """A funnel for each user: a page and a product view, then 70 %, 50 % and 40 % go on to cart, checkout and purchase."""
    if users <= 0:
        raise ValueError("the number of users must be positive")
    ids = spark.range(1, users + 1, numPartitions=partitions).select(F.format_string("user_%08d", "id").alias("user_id"), "id")
    cart, checkout, buy = (_share(seed, w, "user_id") < p for w, p in (("cart", 0.7), ("checkout", 0.5), ("buy", 0.4)))
    steps = F.array_compact(F.array(F.lit("page_view"), F.lit("product_view"), F.when(cart, "add_to_cart"), F.when(cart & checkout, "checkout"), F.when(cart & checkout & buy, "purchase")))
    rows = ids.select("*", F.posexplode(steps).alias("step", "event_type"))
    h = F.xxhash64("user_id", F.lit(seed))
    at = F.timestamp_seconds(F.unix_seconds(F.to_timestamp(F.lit(base))) + F.col("id") * 60 + F.col("step") * 90)
    return rows.select(
        F.lit(EVENT_VERSION).alias("schema_version"), _uuid("user_id", F.col("step").cast("string"), F.lit("click")).alias("event_id"), "user_id", F.lit(None).cast("string").alias("anonymous_id"),
        F.lit(None).cast("string").alias("session_source_id"), "event_type", at.alias("occurred_at"), F.format_string("product_%06d", F.pmod(h, F.lit(5000))).alias("product_id"),
        F.when(F.col("event_type") == "purchase", F.format_string("synthetic_order_%012d", "id")).alias("order_id"), _pick(DEVICES, F.shiftright(h, 16)).alias("device_type"), _pick(SOURCES, F.shiftright(h, 24)).alias("traffic_source"),
    )
