"""Reconciliation, delivery life cycle and click sessions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.functions.columns import require, seconds_between
from souk.sources.contracts import CLICK_TYPES, DELIVERY_RANKS, STEPS, TRANSITIONS


def reconcile(orders: DataFrame, items: DataFrame, payments: DataFrame, tolerance: Decimal | str = "0.01") -> DataFrame:
    """What each order should have been paid and was. Both sides are summed before the joins, so that neither multiplies the other.

    The status is the first that holds: ORDER_WITHOUT_ITEMS, ORDER_WITHOUT_PAYMENT, RECONCILED (within the
    tolerance), OVERPAID, UNDERPAID. ``is_payment_reconciled`` regards the amounts only.
    """
    if (tolerance := Decimal(tolerance)) < 0:
        raise ValueError("the tolerance can't be negative")

    def per_order(df: DataFrame, amounts: dict[str, str], rows: str, distinct: tuple[str, str]) -> DataFrame:
        sums = [F.sum(c).alias(n) for n, c in amounts.items()]
        return df.groupBy("order_id").agg(F.count_distinct(distinct[1]).alias(distinct[0]), F.count("*").alias(rows), *sums)

    due = per_order(items, {c: c for c in ("freight_amount", "item_amount")}, "item_count", ("seller_count", "seller_id"))
    paid = per_order(payments, {"actual_payment_amount": "payment_amount"}, "payment_record_count", ("payment_method_count", "payment_type"))
    zero = F.lit(0).cast("decimal(28,2)")
    joined = orders.select("purchased_at", "order_status", "order_id").join(due, "order_id", "left").join(paid, "order_id", "left")
    amounts = {c: F.coalesce(F.col(c), zero).cast("decimal(28,2)") for c in ("item_amount", "freight_amount", "actual_payment_amount")}
    counts = {c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("item_count", "seller_count", "payment_record_count", "payment_method_count")}
    summed = joined.withColumns(amounts | counts)
    expected = (F.col("item_amount") + F.col("freight_amount")).cast("decimal(28,2)")
    difference = (F.col("actual_payment_amount") - F.col("expected_payment_amount")).cast("decimal(28,2)")
    within = F.abs("payment_difference") <= F.lit(tolerance)
    status = (
        F.when(F.col("item_count") == 0, "ORDER_WITHOUT_ITEMS").when(F.col("payment_record_count") == 0, "ORDER_WITHOUT_PAYMENT")
        .when(F.col("is_payment_reconciled"), "RECONCILED").when(F.col("payment_difference") > 0, "OVERPAID").otherwise("UNDERPAID")
    )
    steps = {"expected_payment_amount": expected, "payment_difference": difference, "is_payment_reconciled": within, "reconciliation_status": status}
    for name, value in steps.items():
        summed = summed.withColumn(name, value)
    return summed


def transitions(events: DataFrame) -> DataFrame:
    """Each delivery event with the order's previous status, whether the step is allowed, and the status's rank."""
    previous = F.lag("status").over(W.partitionBy("order_id").orderBy("occurred_at", "sequence_number", "produced_at"))
    pair = F.concat_ws(">", "previous_status", "status")
    pairs = [f"{a}>{b}" for a, b in TRANSITIONS] + [f"{s}>{s}" for s in DELIVERY_RANKS]
    # a first status has no pair; only the first step may be one
    allowed = F.coalesce(F.col("previous_status") == F.col("status"), F.col("status") == STEPS[0]) | pair.isin(*sorted(pairs))
    rank = F.create_map(*[F.lit(x) for kv in DELIVERY_RANKS.items() for x in kv])[F.col("status")]
    return events.withColumn("status_rank", rank).withColumn("previous_status", previous).withColumn("is_valid_transition", allowed)


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given; a rank limit, which Spark applies before the shuffle too."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rank = 1").drop("_rank")


def delivery_snapshot(orders: DataFrame, events: DataFrame, as_of: Column) -> DataFrame:
    """Where each order stands: its latest event, its events and invalid steps, and whether it is at risk as of a moment.

    One shuffle of the events: the steps, the counts and the latest event share the partitioning by order.
    """
    kept = {"latest_delivery_status": "status", "latest_event_received_at": "produced_at", "latest_event_at": "occurred_at", "carrier_code": "carrier_code", "location_state": "location_state"}
    last = F.max_by(F.struct(*kept.values()), F.struct("occurred_at", "sequence_number", "produced_at"))
    seen = transitions(events).groupBy("order_id").agg(last.alias("last"), F.count("*").alias("delivery_event_count"), F.count_if(~F.col("is_valid_transition")).alias("invalid_transition_count"))
    per = seen.select("order_id", *[F.col(f"last.{c}").alias(n) for n, c in kept.items()], "delivery_event_count", "invalid_transition_count")
    wanted = "order_id purchased_at delivered_at estimated_delivery_at order_status is_delivered_on_time delivery_delay_days".split()
    day_before = F.col("estimated_delivery_at") - F.make_dt_interval(F.lit(1))
    lag = seconds_between(F.col("latest_event_received_at"), F.col("latest_event_at")) / F.lit(60.0)
    risk = (as_of > day_before) & F.isnull("delivered_at")
    return orders.select(*wanted).join(per, "order_id", "left").withColumns({"event_arrival_lag_minutes": lag, "is_at_risk": risk})


def sessionize(events: DataFrame, inactivity_minutes: int = 30) -> DataFrame:
    """Sessions of a user's events: a gap of more whole seconds than the minutes given begins a new one.

    Unknown event types are dropped first; missing optional columns are null. The session's id is SHA-256 of
    "user:sequence". Sessionizing and rolling up share one shuffle by user.
    """
    if inactivity_minutes <= 0:
        raise ValueError("the inactivity must be positive")
    require(events, ("event_id", "user_id", "event_type", "occurred_at"), "events")
    for c in {"traffic_source", "device_type", "product_id"} - set(events.columns):
        events = events.withColumn(c, F.lit(None).cast("string"))
    moment = ("occurred_at", "event_id")
    by_user = W.partitionBy("user_id").orderBy(*moment)
    before = F.lag("occurred_at").over(by_user)
    fresh = before.isNull() | (seconds_between(F.col("occurred_at"), before) > inactivity_minutes * 60)
    known = events.filter(F.col("event_type").isin(*CLICK_TYPES)).withColumn("_new", fresh.cast("int"))
    numbered = known.withColumn("session_sequence", F.sum("_new").over(by_user.rowsBetween(W.unboundedPreceding, 0)))
    first = F.struct(*moment)
    facts = {"session_ended_at": F.max("occurred_at"), "session_started_at": F.min("occurred_at"), "distinct_product_count": F.count_distinct("product_id"), "event_count": F.count("*")}
    facts |= {f"has_{t}": F.bool_or(F.col("event_type") == t) for t in CLICK_TYPES[1:]} | {c: F.min_by(c, first) for c in ("traffic_source", "device_type")}
    rolled = numbered.groupBy("user_id", "session_sequence").agg(*[v.alias(k) for k, v in facts.items()])
    name = F.concat_ws(":", *[F.col(c).cast("string") for c in ("user_id", "session_sequence")])
    return rolled.withColumns({"session_id": F.sha2(name, 256), "session_duration_seconds": seconds_between(F.col("session_ended_at"), F.col("session_started_at"))})
