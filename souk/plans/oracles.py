"""DuckDB SQL for the catalogue's queries, written over the driver's tables and not derived from the plans."""

from __future__ import annotations

import re


def sk(*parts: str) -> str:
    joined = ", ".join(f"coalesce(CAST({p} AS VARCHAR), '∅')" for p in parts)
    u = f"CAST(CAST('0x' || substr(sha256(concat_ws('|', {joined})), 1, 16) AS UBIGINT) AS HUGEINT)"
    return f"CAST(least({u}, 18446744073709551616 - {u}) % 9223372036854775808 AS BIGINT)"


def dk(x: str) -> str:
    return f"CAST(strftime({x}, '%Y%m%d') AS INTEGER)"


def norm(x: str) -> str:
    return f"regexp_replace(translate(lower(trim({x})), 'áàâãäéèêëíìîïóòôõöúùûüç', 'aaaaaeeeeiiiiooooouuuuc'), '\\s+', ' ', 'g')"


def div(a: str, n: str, scale: int, kind: str) -> str:
    """a / n of decimals, exact and rounded half up, in whole numbers."""
    s, d = f"CAST(({a}) * {10**scale} AS HUGEINT)", f"nullif(CAST({n} AS HUGEINT), 0)"
    return f"CAST(CAST(sign({s}) * ((abs({s}) * 2 + {d}) // (2 * {d})) AS DECIMAL(24,0)) * {10**-scale:.{scale}f} AS {kind})"


def rate(a: str, b: str) -> str:
    return div(a, b, 6, "DECIMAL(9,6)")


def mean(x: str, kind: str = "DECIMAL(18,4)") -> str:
    return div(f"sum(CAST({x} AS DECIMAL(18,4)))", f"count({x})", 4, kind)


def money(x: str) -> str:
    return f"CAST({x} AS DECIMAL(28,2))"


def ver(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def sha(*parts: str) -> str:
    return "sha256(" + " || chr(31) || ".join(f"coalesce(CAST({p} AS VARCHAR), '∅')" for p in parts) + ")"


_PARTY = "'system' AS created_run_id, 'system' AS updated_run_id"
_PATH = "created approved invoiced shipped in_transit out_for_delivery delivered".split()
_PAIRS = [*zip(_PATH, _PATH[1:]), *((s, "exception") for s in _PATH[3:6]), *(("exception", s) for s in _PATH[4:6])]
_ALLOWED = ", ".join(f"'{a}>{b}'" for a, b in _PAIRS)



def _sessions(minutes: int) -> str:
    return f"""
        SELECT sha256(CAST(user_id AS VARCHAR) || ':' || CAST(n AS VARCHAR)) AS session_id, user_id, CAST(n AS BIGINT) AS session_sequence,
               min(occurred_at) AS session_started_at, max(occurred_at) AS session_ended_at, date_diff('second', min(occurred_at), max(occurred_at)) AS session_duration_seconds,
               count(*) AS event_count, count(DISTINCT product_id) AS distinct_product_count,
               bool_or(event_type = 'product_view') AS has_product_view, bool_or(event_type = 'add_to_cart') AS has_add_to_cart, bool_or(event_type = 'checkout') AS has_checkout, bool_or(event_type = 'purchase') AS has_purchase,
               first(device_type ORDER BY occurred_at, event_id) AS device_type, first(traffic_source ORDER BY occurred_at, event_id) AS traffic_source
        FROM (SELECT *, sum(CASE WHEN gap IS NULL OR gap > {minutes * 60} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id) AS n
              FROM (SELECT *, date_diff('second', lag(occurred_at) OVER (PARTITION BY user_id ORDER BY occurred_at, event_id), occurred_at) AS gap
                    FROM clicks WHERE event_type <> 'error'))
        GROUP BY user_id, n"""


#: Named subqueries; a query pulls in those it mentions.
PARTS: dict[str, str] = {
    "s_customers": f"SELECT CAST(c_custkey AS VARCHAR) AS customer_id, 'u' || c_custkey AS customer_unique_id, c_nationkey AS zip_code_prefix, {norm('c_mktsegment')} AS city, upper(trim(' n' || c_nationkey)) AS state FROM customer",
    "s_sellers": f"SELECT CAST(s_suppkey AS VARCHAR) AS seller_id, s_nationkey AS zip_code_prefix, {norm("' São  ' || s_name")} AS city, 'N' || s_nationkey AS state FROM supplier",
    "s_products": f"""SELECT CAST(p_partkey AS VARCHAR) AS product_id, coalesce({norm("CASE WHEN p_partkey % 50 <> 0 THEN p_type END")}, 'unknown') AS category_name,
        CAST(length(p_name) AS INTEGER) AS product_name_length, CAST(length(p_brand) AS INTEGER) AS product_description_length, CAST(p_size % 7 AS INTEGER) AS product_photos_quantity, CAST(p_size * 10 AS INTEGER) AS weight_g,
        CAST(p_size AS INTEGER) AS length_cm, CAST(p_size + 1 AS INTEGER) AS height_cm, CAST(p_size + 2 AS INTEGER) AS width_cm, CAST(p_size AS BIGINT) * (p_size + 1) * (p_size + 2) AS volume_cm3 FROM part""",
    "ships": "SELECT l_orderkey, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_orderkey",
    "base_orders": """SELECT *, CASE WHEN o_orderkey % 50 = 0 THEN 'canceled' WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'shipped' ELSE 'processing' END AS status FROM orders LEFT JOIN ships ON l_orderkey = o_orderkey""",
    "timed_orders": """SELECT CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_custkey AS VARCHAR) AS customer_id, status AS order_status, o_orderdate AS purchased_at, o_orderdate + to_hours(CAST(o_orderkey % 48 AS INTEGER)) AS approved_at,
        first_ship AS handed_to_carrier_at, CASE WHEN status = 'delivered' THEN last_ship END AS delivered_at, o_orderdate + INTERVAL 720 DAY AS estimated_delivery_at FROM base_orders""",
    "s_orders": """SELECT *, date_diff('second', purchased_at, approved_at) / CAST(3600 AS DOUBLE) AS approval_lead_hours, date_diff('second', purchased_at, delivered_at) / CAST(86400 AS DOUBLE) AS delivery_lead_days,
        CAST(date_diff('day', estimated_delivery_at, delivered_at) AS INTEGER) AS delivery_delay_days, date_diff('day', estimated_delivery_at, delivered_at) <= 0 AS is_delivered_on_time,
        true AS is_valid_status, order_status = 'delivered' AS is_delivered, order_status = 'canceled' AS is_terminal_failure FROM timed_orders""",
    "priced": "SELECT *, CAST(l_extendedprice AS DECIMAL(18,2)) AS price FROM lineitem",
    "taxed": "SELECT *, CAST(price * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(18,2)) AS freight FROM priced",
    "s_items": "SELECT CAST(l_orderkey AS VARCHAR) AS order_id, l_linenumber AS order_item_id, CAST(l_partkey AS VARCHAR) AS product_id, CAST(l_suppkey AS VARCHAR) AS seller_id, l_shipdate AS shipping_limit_at, price AS item_amount, freight AS freight_amount, CAST(price + freight AS DECIMAL(18,2)) AS gross_amount, price >= 0 AND freight >= 0 AS has_valid_amount FROM taxed",
    "s_payments": f"SELECT CAST(o_orderkey AS VARCHAR) AS order_id, 1 AS payment_sequence, {norm('o_orderpriority')} AS payment_type, CAST(o_orderkey % 12 AS INTEGER) AS installments, CAST(o_totalprice AS DECIMAL(18,2)) AS payment_amount, CAST(o_totalprice AS DECIMAL(18,2)) >= 0 AS has_valid_payment FROM orders WHERE o_orderkey % 10 <> 0",
    "s_reviews": "SELECT 'r' || o_orderkey AS review_id, CAST(o_orderkey AS VARCHAR) AS order_id, CAST(o_orderkey % 6 AS INTEGER) AS review_score, trim(' ' || o_orderpriority) AS review_title, CASE WHEN o_orderkey % 3 <> 0 THEN trim(o_orderpriority || '  ') END AS review_message, o_orderdate + INTERVAL 30 DAY AS review_created_at, o_orderdate + INTERVAL 32 DAY AS review_answered_at, o_orderkey % 6 BETWEEN 1 AND 5 AS has_valid_score FROM orders WHERE o_orderkey % 4 = 0",
    "s_translation": f"SELECT DISTINCT {norm('p_type')} AS category_name, {norm("'English ' || p_type")} AS category_name_english FROM part",
    "geo_rows": f"SELECT c_nationkey AS zip, c_acctbal / 100 AS lat, c_acctbal / -50 AS lng, {norm('c_mktsegment')} AS city, 'N' || (c_nationkey % 5) AS state FROM customer",
    "city_counts": "SELECT zip, city, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, city) AS n FROM geo_rows GROUP BY zip, city",
    "s_geography": "SELECT g.zip AS zip_code_prefix, quantile_disc(lat, 0.5) AS latitude, quantile_disc(lng, 0.5) AS longitude, any_value(c.city) AS city, any_value(state) AS state, count(*) AS source_coordinate_count FROM geo_rows g JOIN city_counts c ON c.zip = g.zip AND c.n = 1 GROUP BY g.zip",
    "clicks": """SELECT event_id, user_id, ts AS occurred_at, CASE event_type WHEN 'view' THEN 'product_view' WHEN 'click' THEN 'add_to_cart' WHEN 'signup' THEN 'checkout' ELSE event_type END AS event_type,
        CAST(json_extract_string(props, '$.k') AS INTEGER) AS product_id, 'd' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 3) AS device_type, 's' || (CAST(json_extract_string(props, '$.k') AS INTEGER) % 4) AS traffic_source FROM events""",
    "deliveries": """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS order_id, CASE event_type WHEN 'view' THEN 'created' WHEN 'click' THEN 'approved' WHEN 'signup' THEN 'invoiced' WHEN 'purchase' THEN 'shipped' ELSE 'exception' END AS status,
        ts AS occurred_at, ts + to_minutes(CAST(json_extract_string(props, '$.k') AS INTEGER)) AS produced_at, 'S' || (user_id % 5) AS location_state, 'carrier_' || (user_id % 3) AS carrier_code, CAST(event_id AS INTEGER) AS sequence_number FROM events""",
    "stepped": "SELECT *, lag(status) OVER (PARTITION BY order_id ORDER BY occurred_at, sequence_number, produced_at) AS previous_status FROM deliveries",
    "classified": f"""SELECT *, CASE WHEN previous_status IS NULL THEN status = 'created' WHEN previous_status = status THEN true ELSE previous_status || '>' || status IN ({_ALLOWED}) END AS is_valid_transition,
        CASE status WHEN 'created' THEN 10 WHEN 'approved' THEN 20 WHEN 'invoiced' THEN 30 WHEN 'shipped' THEN 40 ELSE 90 END AS status_rank FROM stepped""",
    "last_event": "SELECT * FROM deliveries QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY occurred_at DESC, sequence_number DESC, produced_at DESC) = 1",
    "step_counts": "SELECT order_id, count(*) FILTER (NOT is_valid_transition) AS invalid_transition_count, count(*) AS delivery_event_count FROM classified GROUP BY order_id",
    "snapshot": """SELECT o.order_id, o.order_status, o.purchased_at, o.estimated_delivery_at, o.delivered_at, o.delivery_delay_days, o.is_delivered_on_time, l.status AS latest_delivery_status, l.occurred_at AS latest_event_at, l.produced_at AS latest_event_received_at,
        l.location_state, l.carrier_code, c.invalid_transition_count, c.delivery_event_count, o.delivered_at IS NULL AND TIMESTAMP '2000-01-01' > o.estimated_delivery_at - INTERVAL 1 DAY AS is_at_risk,
        date_diff('second', l.occurred_at, l.produced_at) / CAST(60 AS DOUBLE) AS event_arrival_lag_minutes FROM s_orders o LEFT JOIN last_event l USING (order_id) LEFT JOIN step_counts c USING (order_id)""",
    "due": "SELECT order_id, sum(item_amount) AS item_amount, sum(freight_amount) AS freight_amount, count(*) AS item_count, count(DISTINCT seller_id) AS seller_count FROM s_items GROUP BY order_id",
    "paid": "SELECT order_id, sum(payment_amount) AS amount, count(*) AS n, count(DISTINCT payment_type) AS methods FROM s_payments GROUP BY order_id",
    "owed": f"""SELECT o.order_id, o.order_status, o.purchased_at, {money('coalesce(d.item_amount, 0)')} AS item_amount, {money('coalesce(d.freight_amount, 0)')} AS freight_amount, coalesce(d.item_count, 0) AS item_count, coalesce(d.seller_count, 0) AS seller_count,
        {money('coalesce(p.amount, 0)')} AS actual_payment_amount, coalesce(p.n, 0) AS payment_record_count, coalesce(p.methods, 0) AS payment_method_count, {money('coalesce(d.item_amount, 0) + coalesce(d.freight_amount, 0)')} AS expected_payment_amount
        FROM s_orders o LEFT JOIN due d USING (order_id) LEFT JOIN paid p USING (order_id)""",
    "reconciled": f"""SELECT *, {money('actual_payment_amount - expected_payment_amount')} AS payment_difference, abs(actual_payment_amount - expected_payment_amount) <= 0.01 AS is_payment_reconciled,
        CASE WHEN item_count = 0 THEN 'ORDER_WITHOUT_ITEMS' WHEN payment_record_count = 0 THEN 'ORDER_WITHOUT_PAYMENT' WHEN abs(actual_payment_amount - expected_payment_amount) <= 0.01 THEN 'RECONCILED'
             WHEN actual_payment_amount > expected_payment_amount THEN 'OVERPAID' ELSE 'UNDERPAID' END AS reconciliation_status FROM owed""",
    "sessions": _sessions(720),
    "seller_versions": """SELECT seller_id, zip_code_prefix, city, state, TIMESTAMP '1990-01-01' AS valid_from, CASE WHEN CAST(seller_id AS INTEGER) % 5 = 0 THEN TIMESTAMP '1998-01-01' END AS valid_to, CAST(seller_id AS INTEGER) % 5 <> 0 AS is_current, 'r1' AS created_run_id,
            CASE WHEN CAST(seller_id AS INTEGER) % 5 = 0 THEN 'r2' ELSE 'r1' END AS updated_run_id FROM s_sellers
        UNION ALL SELECT seller_id, zip_code_prefix, city, state || '2', TIMESTAMP '1998-01-01', NULL, true, 'r2', 'r2' FROM s_sellers WHERE CAST(seller_id AS INTEGER) % 5 = 0""",
    "customer_versions": """SELECT customer_unique_id, zip_code_prefix, city, state, TIMESTAMP '1990-01-01' AS valid_from, CASE WHEN CAST(customer_id AS INTEGER) % 4 = 0 THEN TIMESTAMP '1997-06-01' END AS valid_to, CAST(customer_id AS INTEGER) % 4 <> 0 AS is_current, 'r1' AS created_run_id,
            CASE WHEN CAST(customer_id AS INTEGER) % 4 = 0 THEN 'r2' ELSE 'r1' END AS updated_run_id FROM s_customers
        UNION ALL SELECT customer_unique_id, zip_code_prefix, 'moved', state, TIMESTAMP '1997-06-01', NULL, true, 'r2', 'r2' FROM s_customers WHERE CAST(customer_id AS INTEGER) % 4 = 0""",
    "d_date": f"""SELECT {dk('d')} AS date_key, d AS full_date, CAST(year(d) AS INTEGER) AS calendar_year, CAST(quarter(d) AS INTEGER) AS calendar_quarter, CAST(month(d) AS INTEGER) AS calendar_month, CAST(day(d) AS INTEGER) AS day_of_month, CAST(dayofyear(d) AS INTEGER) AS day_of_year,
        CAST(isodow(d) AS INTEGER) AS iso_day_of_week, CAST(date_trunc('week', d) AS DATE) AS week_started_at, CAST(last_day(d) AS DATE) AS month_ended_at, CASE WHEN isodow(d) >= 6 THEN 1 ELSE 0 END AS is_weekend
        FROM (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-31', INTERVAL 1 DAY)) AS DATE) AS d)""",
    "d_customer": f"SELECT {sk("'customer'", 'customer_unique_id', ver('valid_from'))} AS customer_key, * FROM customer_versions UNION ALL SELECT -1, 'UNKNOWN', NULL, 'unknown', 'NA', TIMESTAMP '1900-01-01', NULL, true, {_PARTY}",
    "d_seller": f"SELECT {sk("'seller'", 'seller_id', ver('valid_from'))} AS seller_key, * FROM seller_versions UNION ALL SELECT -1, 'UNKNOWN', NULL, 'unknown', 'NA', TIMESTAMP '1900-01-01', NULL, true, {_PARTY}",
    "d_product": f"""SELECT {sk("'product'", 'product_id', "'1990-01-01 00:00:00'")} AS product_key, CASE WHEN category_name = 'unknown' THEN -1 ELSE {sk("'category'", 'category_name')} END AS category_key, product_id, category_name, product_photos_quantity, product_name_length, product_description_length,
            volume_cm3, width_cm, height_cm, length_cm, weight_g, TIMESTAMP '1990-01-01' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, true AS is_current, 'r1' AS created_run_id, 'r1' AS updated_run_id FROM s_products
        UNION ALL SELECT -1, -1, 'UNKNOWN', 'unknown', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, TIMESTAMP '1900-01-01', NULL, true, {_PARTY}""",
    "d_category": f"SELECT {sk("'category'", 'category_name')} AS category_key, category_name, category_name_english FROM (SELECT DISTINCT category_name FROM s_products WHERE category_name <> 'unknown') LEFT JOIN s_translation USING (category_name) UNION ALL SELECT -1, 'unknown', NULL",
    "d_geography": f"SELECT {sk("'geography'", 'zip_code_prefix')} AS geography_key, * FROM s_geography UNION ALL SELECT -1, NULL, NULL, NULL, 'unknown', 'NA', 0",
    "f_item": f"""SELECT {sk("'order_item'", 'i.order_id', 'i.order_item_id')} AS order_item_key, i.order_id, i.order_item_id, coalesce(dc.customer_key, -1) AS customer_key, coalesce(ds.seller_key, -1) AS seller_key, coalesce(dp.product_key, -1) AS product_key,
        coalesce(dg.geography_key, -1) AS customer_geography_key, {dk('o.purchased_at')} AS purchase_date_key, CASE o.order_status WHEN 'canceled' THEN 80 WHEN 'delivered' THEN 60 WHEN 'shipped' THEN 50 ELSE 40 END AS order_status_key,
        i.gross_amount, i.freight_amount, i.item_amount, i.shipping_limit_at, o.is_terminal_failure, o.is_delivered, o.is_delivered_on_time, o.delivery_delay_days, o.delivery_lead_days, o.estimated_delivery_at, o.delivered_at, o.purchased_at
        FROM s_items i JOIN s_orders o ON i.order_id = o.order_id LEFT JOIN s_customers cm ON o.customer_id = cm.customer_id
        LEFT JOIN d_customer dc ON cm.customer_unique_id = dc.customer_unique_id AND o.purchased_at >= dc.valid_from AND (o.purchased_at < dc.valid_to OR dc.valid_to IS NULL)
        LEFT JOIN d_seller ds ON i.seller_id = ds.seller_id AND o.purchased_at >= ds.valid_from AND (o.purchased_at < ds.valid_to OR ds.valid_to IS NULL)
        LEFT JOIN d_product dp ON i.product_id = dp.product_id AND o.purchased_at >= dp.valid_from AND (o.purchased_at < dp.valid_to OR dp.valid_to IS NULL)
        LEFT JOIN d_geography dg ON dc.zip_code_prefix = dg.zip_code_prefix""",
    "f_payment": f"""SELECT {sk("'payment'", 'p.order_id', 'p.payment_sequence')} AS payment_key, p.order_id, p.payment_sequence, coalesce(dc.customer_key, -1) AS customer_key, {dk('o.purchased_at')} AS purchase_date_key, o.purchased_at, p.payment_amount, p.installments, p.payment_type
        FROM s_payments p JOIN s_orders o ON p.order_id = o.order_id LEFT JOIN s_customers cm ON o.customer_id = cm.customer_id
        LEFT JOIN d_customer dc ON cm.customer_unique_id = dc.customer_unique_id AND o.purchased_at >= dc.valid_from AND (o.purchased_at < dc.valid_to OR dc.valid_to IS NULL)""",
    "f_delivery": f"""SELECT {sk("'delivery'", 'o.order_id')} AS delivery_key, o.order_id, {dk('o.purchased_at')} AS purchase_date_key, {dk('o.delivered_at')} AS delivered_date_key, d.carrier_code, d.location_state, d.latest_event_received_at, d.latest_event_at, d.latest_delivery_status, o.order_status,
        d.event_arrival_lag_minutes, d.delivery_event_count, d.invalid_transition_count, d.is_at_risk, o.is_delivered_on_time, o.delivery_delay_days, o.delivery_lead_days, o.delivered_at, o.estimated_delivery_at, o.purchased_at FROM snapshot d JOIN s_orders o ON d.order_id = o.order_id""",
    "f_review": f"SELECT {sk("'review'", 'r.review_id', 'r.order_id')} AS review_key, r.review_id, r.order_id, {dk('r.review_created_at')} AS review_date_key, o.is_delivered_on_time, o.delivery_delay_days, r.review_answered_at, r.review_created_at, r.review_message, r.review_title, r.review_score FROM s_reviews r JOIN s_orders o ON r.order_id = o.order_id",
    "f_session": f"SELECT {sk("'session'", 'session_id')} AS session_key, session_id, user_id, {dk('session_started_at')} AS session_date_key, traffic_source, device_type, has_purchase, has_checkout, has_add_to_cart, has_product_view, distinct_product_count, event_count, session_duration_seconds, session_ended_at, session_started_at FROM sessions",
    "f_reconciliation": f"SELECT {sk("'reconciliation'", 'order_id')} AS reconciliation_key, order_id, {dk('purchased_at')} AS purchase_date_key, reconciliation_status, is_payment_reconciled, payment_method_count, payment_record_count, seller_count, item_count, payment_difference, actual_payment_amount, expected_payment_amount, freight_amount, item_amount, purchased_at, order_status FROM reconciled",
    "day_sales": """SELECT purchase_date_key AS date_key, count(DISTINCT order_id) AS order_count, sum(item_amount) AS item_revenue, sum(freight_amount) AS freight_revenue, sum(gross_amount) AS gmv, count(DISTINCT CASE WHEN is_delivered THEN order_id END) AS delivered_order_count,
        count(DISTINCT CASE WHEN is_terminal_failure THEN order_id END) AS failed_order_count, count(DISTINCT CASE WHEN is_delivered_on_time THEN order_id END) AS on_time_order_count, count(DISTINCT CASE WHEN NOT is_delivered_on_time THEN order_id END) AS late_order_count FROM f_item GROUP BY 1""",
    "day_paid": "SELECT purchase_date_key AS date_key, sum(payment_amount) AS payment_amount FROM f_payment GROUP BY 1",
    "day_reviews": f"SELECT review_date_key AS date_key, {mean('review_score')} AS average_review_score FROM f_review GROUP BY 1",
    "m_daily": f"""SELECT d.date_key, d.full_date, coalesce(s.order_count, 0) AS order_count, {money('coalesce(s.item_revenue, 0)')} AS item_revenue, {money('coalesce(s.freight_revenue, 0)')} AS freight_revenue, {money('coalesce(s.gmv, 0)')} AS gmv, {money('coalesce(p.payment_amount, 0)')} AS payment_amount,
        coalesce(s.delivered_order_count, 0) AS delivered_order_count, coalesce(s.failed_order_count, 0) AS failed_order_count, coalesce(s.on_time_order_count, 0) AS on_time_order_count, coalesce(s.late_order_count, 0) AS late_order_count, r.average_review_score
        FROM d_date d LEFT JOIN day_sales s USING (date_key) LEFT JOIN day_paid p USING (date_key) LEFT JOIN day_reviews r USING (date_key)""",
    "m_seller": f"""SELECT seller_key, count(DISTINCT order_id) AS order_count, {money('sum(item_amount)')} AS item_revenue, {money('sum(freight_amount)')} AS freight_revenue, {money('sum(gross_amount)')} AS gmv, {mean('delivery_delay_days')} AS average_delay_days,
        {rate('count(DISTINCT CASE WHEN is_delivered_on_time THEN order_id END)', 'count(DISTINCT CASE WHEN is_delivered THEN order_id END)')} AS on_time_delivery_rate, max(purchased_at) AS last_order_at FROM f_item GROUP BY seller_key""",
    "m_sla": f"""SELECT purchase_date_key AS date_key, carrier_code, location_state, count(*) AS order_count, count(*) FILTER (is_at_risk) AS at_risk_order_count, count(*) FILTER (is_delivered_on_time) AS on_time_order_count, count(*) FILTER (NOT is_delivered_on_time) AS late_order_count,
        {mean('delivery_lead_days')} AS average_delivery_lead_days, {mean('delivery_delay_days')} AS average_delivery_delay_days, CAST(coalesce(sum(invalid_transition_count), 0) AS BIGINT) AS invalid_transition_count FROM f_delivery GROUP BY 1, 2, 3""",
    "m_funnel": "SELECT session_date_key AS date_key, device_type, traffic_source, count(*) AS session_count, count(*) FILTER (has_product_view) AS product_view_sessions, count(*) FILTER (has_add_to_cart) AS cart_sessions, count(*) FILTER (has_checkout) AS checkout_sessions, count(*) FILTER (has_purchase) AS purchase_sessions FROM f_session GROUP BY 1, 2, 3",
    "first_buys": "SELECT customer_key, CAST(date_trunc('month', min(purchased_at)) AS DATE) AS cohort_month FROM f_item WHERE customer_key <> -1 AND NOT is_terminal_failure GROUP BY customer_key",
    "m_cohort": """SELECT cohort_month, CAST(date_diff('month', cohort_month, CAST(purchased_at AS DATE)) AS INTEGER) AS months_since_first_purchase, count(DISTINCT customer_key) AS retained_customer_count
        FROM f_item JOIN first_buys USING (customer_key) WHERE NOT is_terminal_failure GROUP BY 1, 2""",
    "nodes": "SELECT 'r' || r_regionkey AS category_id, CAST(NULL AS VARCHAR) AS parent_category_id, r_name AS category_name FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation UNION ALL SELECT DISTINCT 's' || (s_suppkey % 50), 'n' || first(s_nationkey ORDER BY s_suppkey), 'group ' || (s_suppkey % 50) FROM supplier GROUP BY s_suppkey % 50",
    "e_monthly": f"SELECT CAST(year(full_date) AS INTEGER) AS year, CAST(month(full_date) AS INTEGER) AS month_number, {money('sum(gmv)')} AS gmv, CAST(sum(order_count) AS BIGINT) AS orders, {rate('sum(on_time_order_count)', 'sum(delivered_order_count)')} AS sla, {mean('average_review_score')} AS review FROM m_daily GROUP BY 1, 2",
    "e_regions": f"""SELECT s.state, s.year, s.orders, s.gmv, coalesce(l.at_risk, 0) AS at_risk, coalesce(l.late, 0) AS late, coalesce(l.sla, CAST(0 AS DECIMAL(9,6))) AS sla FROM (
        SELECT CAST(year(purchased_at) AS INTEGER) AS year, g.state, {money('sum(gross_amount)')} AS gmv, count(DISTINCT order_id) AS orders FROM f_item JOIN d_geography g ON customer_geography_key = geography_key GROUP BY 1, 2) s LEFT JOIN (
        SELECT calendar_year AS year, location_state AS state, CAST(sum(at_risk_order_count) AS BIGINT) AS at_risk, CAST(sum(late_order_count) AS BIGINT) AS late, {rate('sum(on_time_order_count)', 'sum(order_count)')} AS sla FROM m_sla JOIN d_date USING (date_key) GROUP BY 1, 2) l ON l.year = s.year AND l.state = s.state""",
    "e_sellers": f"""SELECT year, 'seller-' || substr(sha256('salt:' || seller_key), 1, 8) AS id, state, gmv, orders, sla, avg_delay FROM (
        SELECT CAST(year(purchased_at) AS INTEGER) AS year, seller_key, {money('sum(gross_amount)')} AS gmv, count(DISTINCT order_id) AS orders, {rate('count(*) FILTER (is_delivered_on_time)', 'count(*)')} AS sla, coalesce({mean('delivery_delay_days')}, 0) AS avg_delay FROM f_item GROUP BY 1, 2) JOIN d_seller USING (seller_key)""",
    "outcomes": "SELECT 'run' || (event_id % 7) AS run_id, CASE WHEN event_id % 2 = 0 THEN 'a' ELSE 'b' END AS source, ts AS recorded_at, CASE WHEN event_type = 'error' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, event_id % 100 AS input_rows FROM events",
}


def q(sql: str) -> str:
    """``sql`` after the parts that it and they mention, in the order of ``PARTS``."""
    needed: set[str] = set()

    def add(text: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                add(PARTS[name])

    add(sql)
    head = ", ".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in needed)
    if not head:
        return sql
    if sql.lstrip().upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {sql.lstrip()[14:]}"
    return f"WITH {head} {sql}"


def _dq(dataset: str, name: str, rule: str, failed: str, table: str, severity: str = "ERROR", limit: float = 0.0) -> str:
    return f"SELECT '{dataset}' AS dataset, '{name}' AS expectation, '{rule}' AS rule, '{severity}' AS severity, CAST({limit} AS DOUBLE) AS max_failure_rate, CAST({failed} AS BIGINT) AS failed_rows, (SELECT count(*) FROM {table}) AS total_rows"


def _judged(*parts: str) -> str:
    return "SELECT *, CASE WHEN total_rows = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(failed_rows AS DOUBLE) / total_rows END AS failure_rate, CASE WHEN total_rows = 0 THEN true ELSE CAST(failed_rows AS DOUBLE) / total_rows <= max_failure_rate END AS passed FROM (" + " UNION ALL ".join(parts) + ")"


_NN = _dq("silver_orders", "order_id_not_null", "NOT_NULL", "(SELECT count(*) FROM s_orders WHERE order_id IS NULL)", "s_orders")
_NN2 = _dq("silver_orders", "delivered_not_null", "NOT_NULL", "(SELECT count(*) FROM s_orders WHERE delivered_at IS NULL)", "s_orders", "WARN", 0.5)
_ACC = _dq("silver_orders", "valid_order_status", "ACCEPTED_VALUES", "(SELECT count(*) FROM s_orders WHERE order_status NOT IN ('created','approved','invoiced','processing','shipped','delivered','unavailable','canceled'))", "s_orders")
_BET = _dq("silver_reviews", "score_range", "BETWEEN", "(SELECT count(*) FROM s_reviews WHERE review_score NOT BETWEEN 1 AND 5)", "s_reviews")
_UNI = _dq("silver_orders", "order_id_unique", "UNIQUE", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM s_orders GROUP BY order_id) WHERE n > 1)", "s_orders")
_UNI2 = _dq("silver_order_items", "item_unique", "UNIQUE", "(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM s_items GROUP BY order_id, order_item_id) WHERE n > 1)", "s_items")
_AMT = _dq("silver_order_items", "valid_item_amount", "ACCEPTED_VALUES", "(SELECT count(*) FROM s_items WHERE NOT has_valid_amount)", "s_items")
_FK1 = _dq("silver_order_items", "product_fk", "REFERENTIAL_INTEGRITY", "(SELECT count(*) FROM s_items WHERE product_id NOT IN (SELECT product_id FROM s_products))", "s_items")
_FK2 = _dq("silver_order_items", "seller_fk", "REFERENTIAL_INTEGRITY", "(SELECT count(*) FROM s_items WHERE seller_id NOT IN (SELECT seller_id FROM s_sellers))", "s_items")
_FK3 = _dq("silver_orders", "moved_customer_fk", "REFERENTIAL_INTEGRITY", "(SELECT count(*) FROM s_orders WHERE customer_id NOT IN (SELECT customer_id FROM s_customers WHERE CAST(customer_id AS INTEGER) % 4 = 0))", "s_orders")
_REC = _dq("silver_financial_reconciliation", "payment_reconciliation", "ACCEPTED_VALUES", "(SELECT count(*) FROM reconciled WHERE NOT is_payment_reconciled)", "reconciled", "WARN", 0.05)

_RAW_ORDER = ("CAST(o_orderkey AS VARCHAR)", "CAST(o_custkey AS VARCHAR)", "o_orderstatus", "strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')")
_ROLL = "ROWS BETWEEN 2 PRECEDING AND CURRENT ROW"

ORACLES: dict[str, str] = {
    "silver_customers": "SELECT * FROM s_customers",
    "silver_sellers": "SELECT * FROM s_sellers",
    "silver_products": "SELECT * FROM s_products",
    "silver_orders": "SELECT * FROM s_orders",
    "silver_order_items": "SELECT * FROM s_items",
    "silver_payments": "SELECT * FROM s_payments",
    "silver_reviews": "SELECT * FROM s_reviews",
    "silver_category": "SELECT * FROM s_translation",
    "geo_median_mode": "SELECT * FROM s_geography",
    "norm_text": f"SELECT p_partkey, {norm("'  ÀÇÃO ' || p_type || '   ' || p_name || ' '")} AS normal FROM part",
    "record_hash": f"SELECT o_orderkey, {sha(*_RAW_ORDER, 'NULL')} AS record_hash FROM orders",
    "surrogate_key": f"SELECT c_custkey, {sk("'customer'", 'c_custkey', 'c_name')} AS customer_key FROM customer",
    "stg_orders": "SELECT * EXCLUDE (is_valid_status) FROM s_orders",
    "stg_order_items": "SELECT * EXCLUDE (has_valid_amount) FROM s_items",
    "stg_payments": "SELECT * EXCLUDE (has_valid_payment) FROM s_payments",
    "stg_reviews": "SELECT * EXCLUDE (has_valid_score) FROM s_reviews",
    "stg_customers": "SELECT * FROM s_customers",
    "anti_join_new_rows": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem t WHERE t.l_shipdate < TIMESTAMP '1997-01-01' AND t.l_orderkey = l.l_orderkey AND t.l_linenumber = l.l_linenumber)",
    "dedup_quarantine": "SELECT l_orderkey, l_linenumber, count(*) AS _duplicate_count FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "quarantine_split": "SELECT _quarantine_reason, count(*) AS n FROM (SELECT CASE WHEN l_returnflag = 'R' THEN 'MALFORMED_RECORD' WHEN l_linestatus = 'F' THEN 'MISSING_REQUIRED_FIELD' WHEN row_number() OVER (PARTITION BY l_returnflag = 'R', l_linestatus = 'F', l_orderkey, l_linenumber) = 1 THEN 'VALID' WHEN row_number() OVER (PARTITION BY l_returnflag = 'R', l_linestatus = 'F', l_orderkey, l_linenumber) = 2 THEN 'DUPLICATE_RECORD' END AS _quarantine_reason FROM lineitem) WHERE _quarantine_reason IS NOT NULL GROUP BY 1",
    "cdc_current_state": """SELECT c_custkey, CASE WHEN taken THEN c_acctbal + c_custkey % 4 ELSE c_acctbal END AS balance, CAST(CASE WHEN taken THEN 5 ELSE seq END AS INTEGER) AS _seq FROM (
        SELECT *, c_custkey % 3 = 1 OR (c_custkey % 3 = 0 AND c_custkey % 4 <> 0 AND (seq IS NULL OR seq <= 5)) AS taken FROM (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN 1 ELSE 10 END AS seq FROM customer))""",
    "scd2_apply": "SELECT * FROM seller_versions",
    "scd2_late": "SELECT seller_id, zip_code_prefix, city, state || '2' AS state, TIMESTAMP '1989-01-01' AS valid_from, 'LATE_ARRIVING_SCD2_VERSION' AS _quarantine_reason FROM s_sellers WHERE CAST(seller_id AS INTEGER) % 7 = 0 AND CAST(seller_id AS INTEGER) % 5 <> 0",
    "scd2_overlap_check": "SELECT customer_unique_id, valid_from, valid_to, previous_valid_to FROM (SELECT *, lag(valid_to) OVER (PARTITION BY customer_unique_id ORDER BY valid_from) AS previous_valid_to FROM d_customer WHERE customer_key <> -1) WHERE previous_valid_to > valid_from",
    "negative_amount_check": "SELECT order_item_key, item_amount, freight_amount FROM f_item WHERE item_amount < 0 OR freight_amount < 0",
    "one_current_seller_check": "SELECT seller_id, count(*) AS n FROM d_seller WHERE seller_key <> -1 AND is_current GROUP BY 1 HAVING count(*) <> 1",
    "invalid_transition_check": "SELECT order_id, invalid_transition_count FROM f_delivery WHERE coalesce(invalid_transition_count, 0) > 0",
    "temporal_join": "SELECT o.order_id, i.seller_id, v.state, v.valid_from FROM s_items i JOIN s_orders o USING (order_id) LEFT JOIN seller_versions v ON v.seller_id = i.seller_id AND o.purchased_at >= v.valid_from AND (o.purchased_at < v.valid_to OR v.valid_to IS NULL)",
    "financial_reconciliation": "SELECT * FROM reconciled",
    "transition_check": "SELECT * FROM classified",
    "latest_per_key": "SELECT * FROM last_event",
    "delivery_snapshot": "SELECT * FROM snapshot",
    "sessionize": "SELECT * FROM sessions",
    "sessionize_30m": _sessions(30),
    "dim_date": "SELECT * FROM d_date",
    "dim_customer": "SELECT * FROM d_customer",
    "dim_seller": "SELECT * FROM d_seller",
    "dim_product": "SELECT * FROM d_product",
    "dim_category": "SELECT * FROM d_category",
    "dim_geography": "SELECT * FROM d_geography",
    "dim_order_status": "SELECT CAST(CASE WHEN i = 9 THEN -1 ELSE i * 10 END AS INTEGER) AS order_status_key, s AS order_status, CASE WHEN i <= 4 THEN 'open' WHEN i = 5 THEN 'in_transit' WHEN i = 6 THEN 'success' WHEN i <= 8 THEN 'failure' ELSE 'unknown' END AS status_group FROM (SELECT unnest(string_split('created approved invoiced processing shipped delivered unavailable canceled unknown', ' ')) AS s, generate_subscripts(string_split('created approved invoiced processing shipped delivered unavailable canceled unknown', ' '), 1) AS i)",
    "bridge_category_hierarchy": "SELECT category_key AS ancestor_category_key, category_key AS descendant_category_key, 0 AS depth, true AS is_self FROM d_category",
    "category_closure": "SELECT category_name AS ancestor_category, category_name AS descendant_category, 0 AS depth FROM d_category",
    "hierarchy_closure": "WITH RECURSIVE links AS (SELECT category_id AS ancestor_id, category_id AS descendant_id, 0 AS depth FROM nodes UNION ALL SELECT l.ancestor_id, c.category_id, l.depth + 1 FROM links l JOIN nodes c ON c.parent_category_id = l.descendant_id) SELECT * FROM links",
    "recursive_hierarchy": "WITH RECURSIVE tree AS (SELECT category_id, parent_category_id, category_name, 0 AS depth, category_name AS category_path FROM nodes WHERE parent_category_id IS NULL UNION ALL SELECT c.category_id, c.parent_category_id, c.category_name, p.depth + 1, p.category_path || ' > ' || c.category_name FROM nodes c JOIN tree p ON c.parent_category_id = p.category_id) SELECT * FROM tree",
    "fct_order_item": "SELECT * FROM f_item",
    "fct_payment": "SELECT * FROM f_payment",
    "fct_delivery": "SELECT * FROM f_delivery",
    "fct_review": "SELECT * FROM f_review",
    "fct_funnel_session": "SELECT * FROM f_session",
    "fct_order_reconciliation": "SELECT * FROM f_reconciliation",
    "mart_executive_daily": "SELECT * FROM m_daily",
    "mart_seller_scorecard": "SELECT * FROM m_seller",
    "mart_delivery_sla": "SELECT * FROM m_sla",
    "mart_funnel_conversion": "SELECT * FROM m_funnel",
    "mart_customer_cohort": "SELECT * FROM m_cohort",
    "seller_performance": f"""SELECT * FROM (SELECT *, CAST(dense_rank() OVER (PARTITION BY order_month ORDER BY gmv DESC) AS INTEGER) AS revenue_rank FROM (
        SELECT *, {money(f'sum(gmv) OVER (PARTITION BY seller_key ORDER BY order_month {_ROLL})')} AS rolling_3m_gmv,
               {div(f'sum(average_delay_days) OVER (PARTITION BY seller_key ORDER BY order_month {_ROLL})', f'count(average_delay_days) OVER (PARTITION BY seller_key ORDER BY order_month {_ROLL})', 4, 'DECIMAL(18,4)')} AS rolling_3m_delay
        FROM (SELECT seller_key, CAST(date_trunc('month', purchased_at) AS DATE) AS order_month, count(DISTINCT order_id) AS order_count, {money('sum(gross_amount)')} AS gmv, {mean('delivery_delay_days')} AS average_delay_days FROM f_item GROUP BY 1, 2))) WHERE revenue_rank <= 20""",
    "delay_streaks": """SELECT carrier_code, min(day) AS delay_streak_started_at, max(day) AS delay_streak_ended_at, count(*) AS consecutive_delay_days FROM (
        SELECT *, day - CAST(row_number() OVER (PARTITION BY carrier_code ORDER BY day) AS INTEGER) AS island FROM (SELECT DISTINCT carrier_code, CAST(delivered_at AS DATE) AS day FROM f_delivery WHERE NOT is_delivered_on_time)) GROUP BY carrier_code, island HAVING count(*) >= 3""",
    "funnel_rates": f"SELECT *, {rate('carts', 'sessions')} AS cart_rate, {rate('purchases', 'carts')} AS cart_to_purchase_rate FROM (SELECT session_date_key, count(*) AS sessions, count(*) FILTER (has_add_to_cart) AS carts, count(*) FILTER (has_purchase) AS purchases FROM f_session GROUP BY 1)",
    "measure_daily": f"""SELECT calendar_year, {money('sum(gmv)')} AS gmv, CAST(sum(order_count) AS BIGINT) AS orders, {div('sum(gmv)', 'sum(order_count)', 4, 'DECIMAL(18,4)')} AS average_ticket, {rate('sum(on_time_order_count)', 'sum(delivered_order_count)')} AS on_time_rate,
        {rate('sum(failed_order_count)', 'sum(order_count)')} AS failure_rate, {mean('average_review_score')} AS average_review FROM m_daily JOIN d_date USING (date_key) GROUP BY 1""",
    "measure_sla": f"SELECT carrier_code, CAST(sum(at_risk_order_count) AS BIGINT) AS orders_at_risk, CAST(sum(late_order_count) AS BIGINT) AS late_orders, {mean('average_delivery_delay_days')} AS average_delay FROM m_sla GROUP BY 1",
    "measure_funnel": f"SELECT traffic_source, CAST(sum(session_count) AS BIGINT) AS sessions, CAST(sum(purchase_sessions) AS BIGINT) AS purchases, {rate('sum(purchase_sessions)', 'sum(session_count)')} AS conversion FROM m_funnel GROUP BY 1",
    "measure_seller": f"SELECT state, {money('sum(gmv)')} AS seller_gmv, CAST(sum(order_count) AS BIGINT) AS seller_orders, {div('sum(on_time_delivery_rate * order_count)', 'sum(order_count)', 6, 'DECIMAL(9,6)')} AS seller_on_time_rate FROM m_seller LEFT JOIN d_seller USING (seller_key) GROUP BY 1",
    "measure_cumulative_gmv": f"SELECT full_date, gmv, {money('sum(gmv) OVER (ORDER BY full_date)')} AS cumulative_gmv FROM m_daily",
    "export_monthly": "SELECT * FROM e_monthly",
    "export_regions": "SELECT * FROM e_regions",
    "export_sellers": "SELECT * FROM e_sellers",
    "export_top_sellers": "SELECT year, id, gmv FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY gmv DESC, id) AS place FROM e_sellers) WHERE place <= 6",
    "export_worst_regions": "SELECT * FROM e_regions ORDER BY year DESC, sla, state",
    "region_share": "SELECT year, CAST(CAST(sum(gmv) FILTER (state = 'N0') AS DOUBLE) / CAST(sum(gmv) AS DOUBLE) AS DECIMAL(9,6)) AS share FROM e_regions GROUP BY year",
    "quality_score": "SELECT avg(1 - (event_id % 4) / CAST(4 AS DOUBLE)) AS score FROM (SELECT event_id, ts = max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE last",
    "gen_delivery_counts": "SELECT status, sequence_number, count(*) AS events, count(*) AS orders, CAST(min(60 * (360 * sequence_number + 3 * id)) AS BIGINT) AS first_second, CAST(max(60 * (360 * sequence_number + 3 * id)) AS BIGINT) AS last_second, CAST(300 AS BIGINT) AS lag FROM range(1, 1001) r(id), (VALUES ('created', 1), ('approved', 2), ('invoiced', 3), ('shipped', 4), ('in_transit', 5), ('out_for_delivery', 6), ('delivered', 7)) v(status, sequence_number) GROUP BY 1, 2",
    "gen_click_counts": "SELECT count(*) AS users, count(*) AS with_view, count(*) AS in_step FROM range(1000)",
    "export_channels": "SELECT calendar_year AS year, traffic_source AS source, CAST(sum(session_count) AS BIGINT) AS sessions, CAST(sum(product_view_sessions) AS BIGINT) AS views, CAST(sum(cart_sessions) AS BIGINT) AS carts, CAST(sum(checkout_sessions) AS BIGINT) AS checkouts, CAST(sum(purchase_sessions) AS BIGINT) AS purchases FROM m_funnel JOIN (SELECT " + dk("d") + " AS date_key, CAST(year(d) AS INTEGER) AS calendar_year FROM (SELECT CAST(unnest(generate_series(DATE '2016-01-01', DATE '2030-12-31', INTERVAL 1 DAY)) AS DATE) AS d)) USING (date_key) GROUP BY 1, 2",
    "export_previous": f"""SELECT y.year, {', '.join(f'CASE WHEN b.year IS NULL THEN y.{c} ELSE b.{c} END AS previous_{c}' for c in ('gmv', 'orders', 'ticket', 'sla', 'review'))} FROM yearly y LEFT JOIN yearly b ON b.year = y.year - 1""",
    "seller_risk_class": "SELECT seller_key, on_time_delivery_rate, CASE WHEN on_time_delivery_rate < 0.86 THEN 'critical' WHEN on_time_delivery_rate < 0.90 THEN 'warning' ELSE 'healthy' END AS risk FROM m_seller",
    "seller_alias": "SELECT s_suppkey, 'seller-' || substr(sha256('salt:' || s_suppkey), 1, 8) AS alias FROM supplier",
    "kpi_delta": "SELECT year, gmv, previous_gmv, CASE WHEN previous_gmv = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(gmv - previous_gmv AS DOUBLE) / CAST(previous_gmv AS DOUBLE) * 100 END AS delta FROM (SELECT y.year, y.gmv, coalesce(b.gmv, y.gmv) AS previous_gmv FROM yearly y LEFT JOIN yearly b ON b.year = y.year - 1)",
    "dq_not_null": _judged(_NN, _NN2),
    "dq_accepted_values": _judged(_ACC),
    "dq_between": _judged(_BET),
    "dq_unique": _judged(_UNI, _UNI2),
    "ref_integrity": _judged(_FK1, _FK3),
    "dq_suite": _judged(_NN, _ACC, _UNI, _AMT, _FK1, _FK2, _REC),
    "operational_health": """SELECT s.latest_heartbeat, s.streaming_failures, s.input_rows, h.quarantined_rows, c.failed_quality_checks, CAST(h.quarantined_rows AS DOUBLE) / CAST(s.input_rows AS DOUBLE) AS quarantine_rate FROM (
        SELECT max(seen_at) AS latest_heartbeat, CAST(sum(failed) AS BIGINT) AS streaming_failures, CAST(sum(rows) AS BIGINT) AS input_rows FROM (SELECT run_id, source, max(recorded_at) AS seen_at, count(*) FILTER (status = 'FAILED') AS failed, max(input_rows) AS rows FROM outcomes WHERE recorded_at BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-15' GROUP BY 1, 2)) s,
        (SELECT count(*) AS quarantined_rows FROM events WHERE event_type = 'error' AND ts BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-15') h,
        (SELECT count(*) AS failed_quality_checks FROM (SELECT user_id, event_type, ts = max(ts) OVER (PARTITION BY user_id) AS last FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14' AND TIMESTAMP '2024-01-15') WHERE last AND event_type = 'error') c""",
    "freshness": "SELECT latest, date_diff('second', latest, TIMESTAMP '2024-02-01 12:00:00') / CAST(3600 AS DOUBLE) AS age_hours, CASE WHEN date_diff('second', latest, TIMESTAMP '2024-02-01 12:00:00') / 3600.0 > 48 THEN 'error' WHEN date_diff('second', latest, TIMESTAMP '2024-02-01 12:00:00') / 3600.0 > 24 THEN 'warn' ELSE 'pass' END AS state FROM (SELECT max(ts) AS latest FROM events)",
    "stream_parse_delivery": "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'MISSING_REQUIRED_FIELD' WHEN 2 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN 3 THEN 'INVALID_STATUS' WHEN 4 THEN 'INVALID_STATE' END AS _quarantine_reason, CASE WHEN event_id % 7 > 0 THEN date_trunc('millisecond', ts) END AS occurred_at FROM events",
    "stream_parse_clicks": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'INVALID_JSON' WHEN 1 THEN 'MISSING_REQUIRED_FIELD' WHEN 2 THEN 'UNSUPPORTED_SCHEMA_VERSION' WHEN 3 THEN 'INVALID_EVENT_TYPE' END AS _quarantine_reason, CASE WHEN event_id % 5 > 0 THEN date_trunc('millisecond', ts) END AS occurred_at FROM events",
    "stream_dedup": "SELECT DISTINCT event_id % 500 AS event_id FROM events",
}

PARTS["yearly"] = f"""SELECT year, {money('sum(gmv)')} AS gmv, CAST(sum(orders) AS BIGINT) AS orders, coalesce({div('sum(gmv)', 'sum(orders)', 4, 'DECIMAL(18,4)')}, 0) AS ticket,
    coalesce({div('sum(coalesce(sla, 0) * orders)', 'sum(orders)', 6, 'DECIMAL(9,6)')}, 0) AS sla,
    coalesce({div('sum(coalesce(review, 0) * orders)', 'sum(orders)', 6, 'DECIMAL(9,6)')}, 0) AS review FROM e_monthly GROUP BY year"""
ORACLES = {name: q(sql) for name, sql in ORACLES.items()}
