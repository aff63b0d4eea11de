"""Filtered views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.money import money_sum
from ..operators import filters, inventory
from ..operators.metrics import completed_orders
from . import shared as s
from .registry import query


@query("F01_product_filter", """SELECT id, sku, name, category, price, stock, sizes, created_at FROM r_products
    WHERE category = 'ECONOMY' AND (name ILIKE '%RED%' OR sku ILIKE '%RED%') AND stock > 0""")
def _(t):
    return filters.filter_products(t.products, "ECONOMY", "RED", "in").drop("description")


@query("F02_order_filter", """SELECT id, order_number, status, total_amount, created_at FROM r_orders WHERE status = 'Shipped'
    AND created_at >= TIMESTAMP '1998-01-01' AND created_at < TIMESTAMP '1999-01-01'""")
def _(t):
    found = filters.filter_orders(t.orders, "Shipped", "1998-01-01", "1998-12-31")
    return found.select("id", "order_number", "status", "total_amount", "created_at")


@query("F02_order_filter_bad_date", """SELECT id, status, created_at FROM r_orders WHERE status = 'Packed' AND created_at <= TIMESTAMP '1996-06-30'""")
def _(t):
    return filters.filter_orders(t.orders, "Packed", "not a date", "1996-06-30", whole_last_day=False).select("id", "status", "created_at")


@query("F03_ticket_filter", """SELECT id, priority, status, created_at FROM r_tickets WHERE status = 'Open' ORDER BY CASE priority WHEN 'High' THEN 1
    WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END, created_at DESC, id DESC""")
def _(t):
    return filters.filter_tickets(t.tickets, "Open").select("id", "priority", "status", "created_at")


@query("F04_customer_search", """SELECT u.id, name, email, u.phone, u.created_at, count(o.id) AS order_count,
    coalesce(msum(CASE WHEN payment_status IN ('Paid', 'Completed') THEN total_amount END), 0.0) AS total_spent
    FROM r_users u LEFT JOIN r_orders o ON u.id = o.user_id WHERE NOT is_admin AND (name ILIKE '%00001%' OR email ILIKE '%00001%' OR u.phone ILIKE '%00001%')
    GROUP BY ALL""")
def _(t):
    return filters.search_customers(t.users, t.orders, "00001")


@query("F05_completed_orders", """SELECT status, count(*) AS orders, msum(total_amount) AS revenue FROM r_orders
    WHERE status IN ('Delivered', 'Shipped', 'Out for Delivery') GROUP BY 1""")
def _(t):
    done = completed_orders(t.orders, ["Delivered", "Shipped", "Out for Delivery"])
    return done.groupBy("status").agg(F.count(F.lit(1)).alias("orders"), money_sum("total_amount").alias("revenue"))


@query("F11_audit_log_view", """SELECT id, user_id, action, entity_type, CASE WHEN trim(old_values) <> '' AND json_valid(old_values)
    THEN json_extract_string(old_values, '$.k')::bigint END AS old_k, json_extract_string(new_values, '$.k')::bigint AS new_k, created_at FROM r_audit
    WHERE entity_type = 'order' ORDER BY created_at DESC, id DESC LIMIT 100""")
def _(t):
    view = filters.audit_log_view(t.audit_logs, entity_type="order")
    old, new = (F.try_variant_get(c, "$.k", "bigint").alias(c[:3] + "_k") for c in ("old_values", "new_values"))
    return view.select("id", "user_id", "action", "entity_type", old, new, "created_at")


@query("F12_live_alerts", """SELECT * FROM r_alerts WHERE (expires_at IS NULL OR expires_at > EV_AS_OF) AND NOT is_read
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 50""")
def _(t):
    return filters.live_alerts(t.alerts, t.events_as_of, unread_only=True, per_user=50)


@query("F13_expired_alerts", "SELECT * FROM r_alerts WHERE expires_at <= EV_AS_OF")
def _(t):
    return filters.expired_alerts(t.alerts, t.events_as_of)


@query("F14_document_filter", """SELECT document_id, filename, document_type, status, created_at FROM r_documents
    WHERE document_type = 'src1' AND status = 'indexed' ORDER BY created_at DESC, document_id DESC LIMIT 100""")
def _(t):
    return filters.filter_documents(t.documents, "src1", "indexed").drop("text", "lang")


@query("F15_active_sessions", """SELECT * FROM r_sessions WHERE is_active AND last_activity >= EV_AS_OF - INTERVAL 24 HOUR
    ORDER BY last_activity DESC, id DESC LIMIT 20""")
def _(t):
    return filters.active_sessions(t.sessions, t.events_as_of)


@query("F16_shipping_queue", """SELECT count(*) FILTER (status = 'Processing') AS to_ship, count(*) FILTER (status = 'Shipped') AS in_transit,
    count(*) FILTER (status = 'Delivered') AS delivered FROM r_orders""")
def _(t):
    return filters.shipping_counts(t.orders)


@query("F17_alert_rules", """SELECT 'Low_Stock_Alert' AS rule, 'high' AS severity, id::varchar AS key FROM s_inventory WHERE stock < 10
    UNION ALL SELECT 'Revenue_Anomaly_Alert', 'medium', created_at::varchar FROM s_features WHERE abs(revenue_zscore) > 2.5
    UNION ALL SELECT 'High_Value_Customer_Churn', 'high', id::varchar FROM s_c360 WHERE rfm_segment = 'Champions' AND recency > 30""")
def _(t):
    return (
        filters.apply_rules(s.dim_products(t), filters.rules_for("inventory_analytics"), F.col("id"))
        .unionByName(filters.apply_rules(s.anomaly_features(t), filters.rules_for("anomaly_features"), F.col("created_at")))
        .unionByName(filters.apply_rules(s.customer_360(t), filters.rules_for("customer_360"), F.col("id")))
    )


@query("F22_low_stock_list", """SELECT id, name, category, stock, price, CASE WHEN stock = 0 THEN 'critical' ELSE 'warning' END AS severity
    FROM r_products WHERE stock <= 5""")
def _(t):
    return inventory.low_stock_list(t.products)
