"""Analytical queries, measures over marts, dashboard roll-ups and their arithmetic."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from souk.functions.columns import divided, mean4, money, ratio
from souk.functions.parts import spread


def seller_performance(items: DataFrame, top: int = 20) -> DataFrame:
    """Each month's best sellers by revenue, with sums and means over the seller's last three rows (not months)."""
    month = F.trunc(F.to_date("purchased_at"), "month").alias("order_month")
    per = spread(items, "order_id").groupBy("seller_key", month, "order_id").agg(money(F.sum("gross_amount")).alias("gmv"), F.sum("delivery_delay_days").alias("delay"), F.count("delivery_delay_days").alias("delays"))
    monthly = per.groupBy("seller_key", "order_month").agg(
        F.count("*").alias("order_count"), money(F.sum("gmv")).alias("gmv"), divided(F.sum("delay"), F.sum("delays"), 4, "decimal(18,4)").alias("average_delay_days"),
    )
    last3 = W.partitionBy("seller_key").orderBy("order_month").rowsBetween(-2, 0)
    rolling_delay = divided(F.sum("average_delay_days").over(last3), F.count("average_delay_days").over(last3), 4, "decimal(18,4)")
    rolled = monthly.withColumn("rolling_3m_gmv", money(F.sum("gmv").over(last3))).withColumn("rolling_3m_delay", rolling_delay)
    return rolled.withColumn("revenue_rank", F.dense_rank().over(W.partitionBy("order_month").orderBy(F.desc("gmv")))).filter(F.col("revenue_rank") <= top)


def delay_streaks(deliveries: DataFrame, least: int = 3) -> DataFrame:
    """Gaps and islands: runs of at least so many consecutive days on which a carrier delivered late."""
    days = deliveries.filter("is_delivered_on_time = false and delivered_at is not null").select("carrier_code", F.to_date("delivered_at").alias("day")).distinct()
    island = F.date_sub(F.col("day"), F.row_number().over(W.partitionBy("carrier_code").orderBy("day")))
    runs = days.withColumn("island", island).groupBy("carrier_code", "island").agg(F.min("day").alias("delay_streak_started_at"), F.max("day").alias("delay_streak_ended_at"), F.count("*").alias("consecutive_delay_days"))
    return runs.filter(F.col("consecutive_delay_days") >= least).drop("island")


def funnel_rates(sessions: DataFrame) -> DataFrame:
    daily = sessions.groupBy("session_date_key").agg(F.count("*").alias("sessions"), F.count_if("has_add_to_cart").alias("carts"), F.count_if("has_purchase").alias("purchases"))
    return daily.withColumn("cart_rate", ratio(F.col("carts"), F.col("sessions"))).withColumn("cart_to_purchase_rate", ratio(F.col("purchases"), F.col("carts")))


def category_links(bridge: DataFrame, categories: DataFrame) -> DataFrame:
    """The closure table with names for its keys."""
    a, d = (categories.select(F.col("category_key").alias(f"{w}_category_key"), F.col("category_name").alias(f"{w}_category")) for w in ("ancestor", "descendant"))
    return bridge.join(a, "ancestor_category_key").join(d, "descendant_category_key").select("ancestor_category", "descendant_category", "depth")


#: Levels of a hierarchy: a deeper one holds a cycle, and raises.
LEVELS = 10_000


def _recursive(nodes: DataFrame, view: str) -> None:
    """Registers the nodes, and lifts the session's limit on a recursion's rows, which a large tree would meet."""
    nodes.createOrReplaceTempView(view)
    nodes.sparkSession.conf.set("spark.sql.cteRecursionRowLimit", "-1")


def hierarchy(nodes: DataFrame, view: str = "souk_hierarchy_nodes") -> DataFrame:
    """(category_id, parent_category_id, category_name, depth, category_path) from the roots down; a recursive query."""
    _recursive(nodes, view)
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE tree MAX RECURSION LEVEL {LEVELS} AS (
            SELECT category_id, parent_category_id, category_name, 0 AS depth, category_name AS category_path FROM {view} WHERE parent_category_id IS NULL
            UNION ALL
            SELECT c.category_id, c.parent_category_id, c.category_name, p.depth + 1, concat(p.category_path, ' > ', c.category_name)
            FROM {view} c JOIN tree p ON c.parent_category_id = p.category_id
        ) SELECT * FROM tree""")


def closure(nodes: DataFrame, view: str = "souk_closure_nodes") -> DataFrame:
    """(ancestor_id, descendant_id, depth) of a hierarchy of up to ``LEVELS``, self links included."""
    _recursive(nodes, view)
    return nodes.sparkSession.sql(f"""
        WITH RECURSIVE links MAX RECURSION LEVEL {LEVELS} AS (
            SELECT category_id AS ancestor_id, category_id AS descendant_id, 0 AS depth FROM {view}
            UNION ALL
            SELECT l.ancestor_id, c.category_id, l.depth + 1 FROM links l JOIN {view} c ON c.parent_category_id = l.descendant_id
        ) SELECT * FROM links""")


@dataclass(frozen=True)
class Measure:
    """A named aggregate over a mart, to be computed at any grain of its dimensions."""

    name: str
    mart: str
    value: Column


def measures() -> dict[str, Measure]:
    """The measure registry."""

    def share(a: str, b: str) -> Column:
        return ratio(F.sum(a), F.sum(b))

    daily, sla, funnel, seller = "mart_executive_daily", "mart_delivery_sla", "mart_funnel_conversion", "mart_seller_scorecard"
    weighted = divided(F.sum((F.col("on_time_delivery_rate") * F.col("order_count")).cast("decimal(28,6)")), F.sum("order_count"), 6, "decimal(9,6)")
    every = (
        Measure("gmv", daily, money(F.sum("gmv"))), Measure("orders", daily, F.sum("order_count")),
        Measure("average_ticket", daily, divided(F.sum("gmv"), F.sum("order_count"), 4, "decimal(18,4)")),
        Measure("on_time_rate", daily, share("on_time_order_count", "delivered_order_count")), Measure("failure_rate", daily, share("failed_order_count", "order_count")),
        Measure("average_review", daily, mean4(F.col("average_review_score"))),
        Measure("orders_at_risk", sla, F.sum("at_risk_order_count")), Measure("late_orders", sla, F.sum("late_order_count")), Measure("average_delay", sla, mean4(F.col("average_delivery_delay_days"))),
        Measure("sessions", funnel, F.sum("session_count")), Measure("purchases", funnel, F.sum("purchase_sessions")), Measure("conversion", funnel, share("purchase_sessions", "session_count")),
        Measure("seller_gmv", seller, money(F.sum("gmv"))), Measure("seller_orders", seller, F.sum("order_count")), Measure("seller_on_time_rate", seller, weighted),
    )
    return {m.name: m for m in every}


#: (mart, its column, dimension, the dimension's key): many rows of the mart to one of the dimension
RELATIONS = (
    ("mart_executive_daily", "date_key", "dim_date", "date_key"),
    ("mart_delivery_sla", "date_key", "dim_date", "date_key"),
    ("mart_funnel_conversion", "date_key", "dim_date", "date_key"),
    ("mart_seller_scorecard", "seller_key", "dim_seller", "seller_key"),
)


def measured(tables: dict[str, DataFrame], names: Iterable[str], by: Iterable[str] = ()) -> DataFrame:
    """Measures of one mart by columns of it or of a related dimension."""
    registry, names, by = measures(), list(names), list(by)
    if len(marts := {registry[n].mart for n in names}) != 1:
        raise ValueError("measures of several marts")
    mart = marts.pop()
    df = tables[mart]
    for m, c, dimension, key in RELATIONS:
        if m == mart and (wanted := [b for b in by if b not in df.columns and b in tables[dimension].columns]):
            df = df.join(tables[dimension].select(F.col(key).alias("_k"), *wanted), df[c] == F.col("_k"), "left").drop("_k")
    return df.groupBy(*by).agg(*[registry[n].value.alias(n) for n in names])


def cumulative_gmv(daily: DataFrame) -> DataFrame:
    """The running total of revenue over the days: one ordered window, as long as the calendar whatever the sales."""
    upto = W.orderBy("full_date").rowsBetween(W.unboundedPreceding, 0)
    return daily.select("full_date", "gmv").withColumn("cumulative_gmv", money(F.sum("gmv").over(upto)))


def export_monthly(daily: DataFrame) -> DataFrame:
    return daily.groupBy(F.year("full_date").alias("year"), F.month("full_date").alias("month_number")).agg(
        money(F.sum("gmv")).alias("gmv"), F.sum("order_count").alias("orders"), ratio(F.sum("on_time_order_count"), F.sum("delivered_order_count")).alias("sla"), mean4(F.col("average_review_score")).alias("review"),
    ).orderBy(F.desc("year"), "month_number")


def export_regions(items: DataFrame, geography: DataFrame, sla: DataFrame, dates: DataFrame) -> DataFrame:
    """Sales by year and state, the latest year and the largest first; zeros where logistics has none."""
    per = items.groupBy(F.year("purchased_at").alias("year"), "customer_geography_key", "order_id").agg(money(F.sum("gross_amount")).alias("gmv"))
    sales = per.join(geography.select("geography_key", "state"), F.col("customer_geography_key") == F.col("geography_key")).groupBy("year", "state").agg(money(F.sum("gmv")).alias("gmv"), F.count("*").alias("orders"))
    moved = sla.join(dates.select("date_key", F.col("calendar_year").alias("year")), "date_key").groupBy("year", F.col("location_state").alias("state")).agg(
        F.sum("at_risk_order_count").alias("at_risk"), F.sum("late_order_count").alias("late"), ratio(F.sum("on_time_order_count"), F.sum("order_count")).alias("sla"),
    )
    zero = {"at_risk": F.coalesce("at_risk", F.lit(0)), "late": F.coalesce("late", F.lit(0)), "sla": F.coalesce("sla", F.lit(0).cast("decimal(9,6)"))}
    return sales.join(moved, ["year", "state"], "left").withColumns(zero).orderBy(F.desc("year"), F.desc("gmv"), "state")


def worst_first(regions: DataFrame) -> DataFrame:
    """The regions of each year by rising service level."""
    return regions.orderBy(F.desc("year"), "sla", "state")


def export_sellers(items: DataFrame, sellers: DataFrame, salt: str) -> DataFrame:
    """Sales by year and seller under an alias, the latest year and the largest first; here an undelivered item counts as not on time."""
    per = spread(items, "order_id").groupBy(F.year("purchased_at").alias("year"), "seller_key", "order_id").agg(
        money(F.sum("gross_amount")).alias("gmv"), F.count("*").alias("n"), F.count_if("is_delivered_on_time").alias("on_time"), F.sum("delivery_delay_days").alias("delay"), F.count("delivery_delay_days").alias("delays"),
    )
    rolled = per.groupBy("year", "seller_key").agg(
        money(F.sum("gmv")).alias("gmv"), F.count("*").alias("orders"), ratio(F.sum("on_time"), F.sum("n")).alias("sla"),
        F.coalesce(divided(F.sum("delay"), F.sum("delays"), 4, "decimal(18,4)"), F.lit(0).cast("decimal(18,4)")).alias("avg_delay"),
    )
    return rolled.join(sellers.select("seller_key", "state"), "seller_key").select("year", seller_alias(F.col("seller_key"), salt).alias("id"), "state", "gmv", "orders", "sla", "avg_delay").orderBy(F.desc("year"), F.desc("gmv"), "id")


def export_channels(funnel: DataFrame, dates: DataFrame) -> DataFrame:
    return funnel.join(dates.select("date_key", "calendar_year"), "date_key").groupBy(F.col("calendar_year").alias("year"), F.col("traffic_source").alias("source")).agg(
        F.sum("session_count").alias("sessions"), F.sum("product_view_sessions").alias("views"), F.sum("cart_sessions").alias("carts"), F.sum("checkout_sessions").alias("checkouts"), F.sum("purchase_sessions").alias("purchases"),
    ).orderBy(F.desc("year"), F.desc("sessions"), "source")


def export_previous(monthly: DataFrame) -> DataFrame:
    """Each year with the year before it to compare with, or with itself if there is none. Rates weigh by orders."""
    w = [divided(F.sum((F.coalesce(F.col(c), F.lit(0)) * F.col("orders")).cast("decimal(28,6)")), F.sum("orders"), 6, "decimal(9,6)") for c in ("sla", "review")]
    yearly = monthly.groupBy("year").agg(
        money(F.sum("gmv")).alias("gmv"), F.sum("orders").alias("orders"), F.coalesce(divided(F.sum("gmv"), F.sum("orders"), 4, "decimal(18,4)"), F.lit(0).cast("decimal(18,4)")).alias("ticket"),
        F.coalesce(w[0], F.lit(0).cast("decimal(9,6)")).alias("sla"), F.coalesce(w[1], F.lit(0).cast("decimal(9,6)")).alias("review"),
    )
    before = yearly.select((F.col("year") + 1).alias("year"), *[F.col(c).alias(f"b_{c}") for c in yearly.columns[1:]], F.lit(True).alias("there"))
    return yearly.join(before, "year", "left").select("year", *[F.when(F.col("there"), F.col(f"b_{c}")).otherwise(F.col(c)).alias(f"previous_{c}") for c in yearly.columns[1:]])


def seller_alias(key: Column, salt: str) -> Column:
    return F.concat(F.lit("seller-"), F.substring(F.sha2(F.concat(F.lit(f"{salt}:"), key.cast("string")), 256), 1, 8))


def risk_class(sla: Column) -> Column:
    """critical below 0.86, warning below 0.90, else healthy."""
    return F.when(sla < 0.86, "critical").when(sla < 0.90, "warning").otherwise("healthy")


def percent_delta(current: Column, previous: Column) -> Column:
    """The change in percent; 0 where there was nothing before."""
    return F.when(previous == 0, F.lit(0.0)).otherwise(F.try_divide((current - previous).cast("double"), previous.cast("double")) * 100)


def top_by(df: DataFrame, group: str, measure: str, n: int) -> DataFrame:
    """The n rows of each group with the largest measure (ties beyond are cut by the other columns)."""
    order = W.partitionBy(group).orderBy(F.desc(measure), *[c for c in df.columns if c not in (group, measure)])
    return df.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank")


def latest_checks(results: DataFrame) -> DataFrame:
    """The results of each dataset's latest evaluation."""
    return results.withColumn("_last", F.max("evaluated_at").over(W.partitionBy("dataset"))).filter("evaluated_at = _last").drop("_last")


def region_share(regions: DataFrame, state: str) -> DataFrame:
    """A state's part of each year's revenue."""
    return regions.groupBy("year").agg(ratio_of_money(F.sum(F.when(F.col("state") == state, F.col("gmv"))), F.sum("gmv")).alias("share"))


def ratio_of_money(a: Column, b: Column) -> Column:
    """a / b of amounts, to six places; null where b is 0 or null."""
    return F.try_divide(a.cast("double"), b.cast("double")).cast("decimal(9,6)")


def quality_score(results: DataFrame) -> DataFrame:
    """One row: the mean share of rows that pass, over each dataset's latest checks."""
    return latest_checks(results).agg(F.avg(1 - F.col("failure_rate")).alias("score"))
