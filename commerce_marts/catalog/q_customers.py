"""Customer analytics, order insights, inventory advice and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import customers, delivery, inventory, joins, personalise, recommend
from ..plans import exports
from . import shared as s
from .q_joins import segments
from ..session import shared_dir
from .registry import add_cte, query


@query("C05_rfm_fixed", """WITH b AS (SELECT id, total_orders AS frequency, total_spent AS monetary, datediff('day', last_order_date, cast(AS_OF AS date)) AS recency FROM s_dim_customers),
    c AS (SELECT *, CASE WHEN recency < 7 THEN 5 WHEN recency < 30 THEN 4 WHEN recency < 60 THEN 3 WHEN recency < 90 THEN 2 ELSE 1 END AS r_score,
    CASE WHEN frequency > 10 THEN 5 WHEN frequency > 5 THEN 4 WHEN frequency > 2 THEN 3 WHEN frequency > 0 THEN 2 ELSE 1 END AS f_score,
    CASE WHEN monetary > 10000 THEN 5 WHEN monetary > 5000 THEN 4 WHEN monetary > 2000 THEN 3 WHEN monetary > 500 THEN 2 ELSE 1 END AS m_score FROM b),
    d AS (SELECT *, CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN f_score >= 4 THEN 'Loyal Customers' WHEN r_score >= 4 THEN 'New Customers'
    WHEN r_score <= 2 THEN 'At Risk' ELSE 'Average' END AS rfm_segment FROM c), e AS (SELECT *, CASE WHEN rfm_segment = 'At Risk' THEN 0.8::double WHEN r_score < 3 THEN 0.5::double ELSE 0.1::double END AS churn_risk_score FROM d)
    SELECT *, r_score::varchar || f_score || m_score AS rfm_score, CASE WHEN churn_risk_score > 0.7 THEN 'High Risk' WHEN churn_risk_score > 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS churn_risk_segment FROM e""")
def _(t):
    return customers.rfm_fixed(s.dim_customers(t), t.as_of)


@query("C06_customer_features", "SELECT * FROM s_cfeat")
def _(t):
    return customers.customer_features(t.users, t.orders, t.order_items, t.products, t.as_of)


@query("C07_customer_segment", "SELECT user_id, segment FROM s_segments")
def _(t):
    return segments(t)


@query("C08_segment_actions", f"""SELECT user_id, segment, CASE segment {' '.join(f"WHEN '{k}' THEN '{'; '.join(v)}'" for k, v in fv.SEGMENT_ACTIONS.items())} END AS actions FROM s_segments""")
def _(t):
    return segments(t).withColumn("actions", F.array_join(customers.segment_actions(), "; "))


def behaviour(t):
    return customers.shopping_behaviour(t.users, t.orders, t.order_items, t.cart_items, t.wishlist_items)


@query("C09_shopping_behaviour", "SELECT * FROM s_behaviour")
def _(t):
    return behaviour(t)


add_cte("s_sens", """SELECT u.id AS user_id, CASE WHEN a.aov IS NULL THEN 'unknown' WHEN aov < 1000 THEN 'budget_conscious' WHEN aov < 3000 THEN 'moderate_spender' ELSE 'premium_shopper' END AS price_sensitivity
    FROM r_users u LEFT JOIN (SELECT user_id, mavg(total_amount) AS aov FROM r_orders GROUP BY 1) a ON u.id = a.user_id""")


@query("C10_price_sensitivity", "SELECT * FROM s_sens")
def _(t):
    return customers.price_sensitivity(t.users, t.orders)


@query("C11_category_affinity", """SELECT user_id, category, items_bought AS count, round(items_bought / sum(items_bought) OVER (PARTITION BY user_id) * 100, 2) AS affinity_score,
    row_number() OVER (PARTITION BY user_id ORDER BY items_bought DESC, category)::int AS rank FROM s_cat_qty""")
def _(t):
    return customers.category_affinity(joins.items_with_user(s.fact_items(t), t.orders))


add_cte("s_hints", """SELECT b.user_id, concat_ws('; ', CASE price_sensitivity WHEN 'budget_conscious' THEN 'Show budget-friendly options and discounts'
    WHEN 'premium_shopper' THEN 'Highlight premium and exclusive products' END, CASE WHEN cart_abandonment_rate > 50 THEN 'Send cart abandonment reminders with incentives' END,
    CASE WHEN wishlist_conversion_rate < 30 THEN 'Promote wishlist items with discounts' END, CASE WHEN f.category IS NOT NULL THEN 'Prioritize ' || f.category || ' recommendations' END,
    CASE WHEN time_preference <> 'unknown' THEN 'Send promotions during ' || time_preference END) AS hints
    FROM s_behaviour b JOIN s_sens s ON b.user_id = s.user_id LEFT JOIN s_favourite f ON b.user_id = f.user_id""")


def hints(t):
    favourite = customers.favourite_category(joins.items_with_user(s.fact_items(t), t.orders))
    return customers.behaviour_hints(behaviour(t), customers.price_sensitivity(t.users, t.orders), favourite)


@query("C12_behaviour_hints", "SELECT * FROM s_hints")
def _(t):
    return hints(t).withColumn("hints", F.array_join("hints", "; "))


@query("C13_churn_list", """WITH b AS (SELECT user_id, max(created_at) AS last_order_date, count(*) FILTER (created_at >= AS_OF - INTERVAL 60 DAY) AS recent,
    floor(epoch(AS_OF - max(created_at)) / 86400)::bigint AS d FROM r_orders GROUP BY 1), c AS (SELECT *, CASE WHEN d > 60 THEN 50 ELSE 0 END + CASE WHEN d > 30 THEN 30 ELSE 0 END
    + CASE WHEN recent = 0 AND d > 30 THEN 20 ELSE 0 END AS risk_score FROM b)
    SELECT c.user_id, u.email, risk_score, d AS days_since_last_order, last_order_date FROM c JOIN r_users u ON c.user_id = u.id WHERE risk_score > 50""")
def _(t):
    return customers.churn_list(t.users, t.orders, t.as_of)


@query("C14_suspicious_users", """SELECT a.user_id, 'multiple_failed_logins' AS type, count(*) AS count, 'high' AS severity, count(*) || ' failed login attempts in last 24 hours' AS message, u.email
    FROM r_activities a JOIN r_users u ON a.user_id = u.id WHERE activity_type = 'login_failed' AND a.created_at >= TIMESTAMP '2024-01-17' GROUP BY a.user_id, u.email HAVING count(*) >= 5
    UNION ALL SELECT o.user_id, 'rapid_cancellations', count(*), 'medium', count(*) || ' orders cancelled in last 24 hours', u.email FROM r_orders o JOIN r_users u ON o.user_id = u.id
    WHERE status = 'Cancelled' AND o.created_at >= AS_OF - INTERVAL 24 HOUR GROUP BY o.user_id, u.email HAVING count(*) >= 3
    UNION ALL SELECT o.user_id, 'sudden_activity_spike', count(*), 'medium', 'Sudden activity: ' || count(*) || ' orders in last 24 hours after long inactivity', u.email
    FROM r_orders o JOIN r_users u ON o.user_id = u.id AND u.created_at <= AS_OF - INTERVAL 90 DAY WHERE o.created_at >= AS_OF - INTERVAL 24 HOUR GROUP BY o.user_id, u.email HAVING count(*) >= 5""")
def _(t):
    return customers.suspicious_users(t.users, t.orders, t.activities, t.as_of, "2024-01-18 00:00:00")


add_cte("s_eta", """SELECT *, CASE WHEN status <> 'Cancelled' THEN created_at + to_days(CASE WHEN status = 'Delivered' THEN 5 ELSE
    CASE WHEN contains(lower(state), 'delhi') OR contains(lower(state), 'mumbai') THEN 3 WHEN contains(lower(state), 'pune') OR contains(lower(state), 'jaipur') THEN 4 ELSE 5 END
    + CASE status WHEN 'Packed' THEN 1 WHEN 'Shipped' THEN 3 WHEN 'Out for Delivery' THEN 5 ELSE 0 END END) END AS estimated_delivery,
    status NOT IN ('Delivered', 'Cancelled') AS open FROM r_orders""")
add_cte("s_risk", """SELECT *, CASE WHEN open THEN AS_OF > estimated_delivery END AS is_delayed,
    CASE WHEN open THEN AS_OF <= estimated_delivery AND floor(epoch(estimated_delivery - AS_OF) / 86400) < 2 AND status <> 'Out for Delivery' END AS at_risk,
    CASE WHEN open AND AS_OF > estimated_delivery THEN floor(epoch(AS_OF - estimated_delivery) / 86400)::bigint END AS delay_days FROM s_eta""")


@query("C16_delivery_eta", "SELECT id, status, state, created_at, estimated_delivery FROM s_eta")
def _(t):
    return t.orders.select("id", "status", "state", "created_at", delivery.delivery_eta().alias("estimated_delivery"))


@query("C17_delivery_risk", f"""SELECT id, status, is_delayed, at_risk, delay_days, CASE WHEN is_delayed THEN CASE status {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.DELAY_REASONS.items())}
    ELSE '{fv.DEFAULT_DELAY_REASON}' END WHEN at_risk THEN 'Order is taking longer than expected' END AS delay_reason FROM s_risk""")
def _(t):
    return delivery.delivery_risk(t.orders, t.as_of).select("id", "status", "is_delayed", "at_risk", "delay_days", "delay_reason")


add_cte("s_notes", """SELECT id, user_id, 'delay' AS type, 'high' AS priority, 'Order ' || order_number || ' is delayed by ' || delay_days || ' days' AS message, 'Contact support' AS action FROM s_risk WHERE is_delayed
    UNION ALL SELECT id, user_id, 'at_risk', 'medium', 'Order ' || order_number || ' may be delayed', 'Track order' FROM s_risk WHERE at_risk
    UNION ALL SELECT id, user_id, 'shipped', 'low', 'Order ' || order_number || ' has been shipped', 'Track delivery' FROM s_risk WHERE status = 'Shipped'
    UNION ALL SELECT id, user_id, 'out_for_delivery', 'low', 'Order ' || order_number || ' is out for delivery', NULL FROM s_risk WHERE status = 'Out for Delivery'
    UNION ALL SELECT id, user_id, 'return_reminder', 'low', 'Return window for order ' || order_number || ' closes in ' || (7 - floor(epoch(AS_OF - created_at) / 86400)::bigint) || ' days', 'View order'
    FROM s_risk WHERE status = 'Delivered' AND return_status = 'Not Requested' AND floor(epoch(AS_OF - created_at) / 86400) >= 5""")


@query("C18_order_notifications", "SELECT * FROM s_notes")
def _(t):
    return delivery.order_notifications(t.orders, t.as_of).drop("created_at")


@query("T07_user_notifications", """SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, id, type)::int AS rank FROM s_notes QUALIFY rank <= 10""")
def _(t):
    return delivery.user_notifications(delivery.order_notifications(t.orders, t.as_of)).drop("created_at")


@query("C19_order_insights", """SELECT o.id, o.order_number, o.status, o.created_at, o.estimated_delivery, o.is_delayed, o.delay_days, coalesce(c.n, 0) AS total_items, c.categories,
    'Explore more ' || split_part(c.categories, ',', 1) || ' items' AS suggestion,
    (CASE WHEN is_delayed THEN 2 ELSE 0 END + CASE WHEN status = 'Shipped' THEN 1 ELSE 0 END + CASE WHEN status = 'Delivered' AND return_status = 'Not Requested' THEN 2 ELSE 0 END) AS n_recommendations
    FROM s_risk o LEFT JOIN (SELECT order_id, count(*) AS n, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM s_items_user GROUP BY 1) c ON o.id = c.order_id""")
def _(t):
    pack = delivery.order_insights(t.orders, t.order_items, t.products, t.as_of)
    return pack.withColumns({"categories": F.array_join("categories", ","), "n_recommendations": F.size("recommendations")}).drop("recommendations")


@query("E13_order_timeline", f"""SELECT id, status, array_to_string(list_transform({fv.ORDER_TIMELINE}, lambda s, i: s || CASE WHEN i <= greatest(coalesce(list_position({fv.ORDER_TIMELINE}, status), 0), 1) THEN '+' ELSE '-' END), ',') AS timeline FROM r_orders""")
def _(t):
    steps = F.transform(delivery.order_timeline(), lambda x: F.concat(x["label"], F.when(x["done"], "+").otherwise("-")))
    return t.orders.select("id", "status", F.array_join(steps, ",").alias("timeline"))


@query("E14_invoice_text", """SELECT o.id, concat_ws(chr(10), 'STORE INVOICE', 'Order Number: ' || order_number, 'Tracking ID: ' || tracking_id, 'Customer: ' || customer_name, 'Phone: ' || phone,
    'Address: ' || address || ', ' || city || ', ' || state || ' - ' || pincode, 'Status: ' || status, 'Payment Method: ' || payment_method, 'Payment Status: ' || payment_status, '', 'Items:', l.lines, '',
    'Total Amount: ₹' || rnd0(total_amount)) AS invoice
    FROM r_orders o LEFT JOIN (SELECT order_id, string_agg('- ' || product_name || ' | Size: ' || size || ' | Qty: ' || quantity || ' | Amount: ₹' || rnd0(unit_price * quantity), chr(10)
    ORDER BY product_id, quantity, size, rnd0(unit_price * quantity)::varchar) AS lines FROM r_items GROUP BY 1) l ON o.id = l.order_id""")
def _(t):
    return delivery.invoice_text(t.orders, t.order_items)


@query("C15_personalisation", f"""WITH base AS (SELECT g.user_id, g.segment, b.time_preference, b.cart_abandonment_rate, h.hints FROM s_segments g JOIN s_behaviour b ON g.user_id = b.user_id JOIN s_hints h ON g.user_id = h.user_id)
    SELECT user_id, segment, CASE segment {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in fv.SEGMENT_CAMPAIGNS.items())} END AS title,
    CASE time_preference WHEN 'morning' THEN 'Good morning! ' WHEN 'evening' THEN 'Good evening! ' ELSE '' END ||
    CASE segment {' '.join("WHEN '" + k + "' THEN '" + v[1].replace("'", "''") + "'" for k, v in fv.SEGMENT_CAMPAIGNS.items())} END AS subtitle,
    CASE segment {' '.join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in fv.SEGMENT_CAMPAIGNS.items())} END AS call_to_action, time_preference, cart_abandonment_rate, hints FROM base""")
def _(t):
    affinity = customers.category_affinity(joins.items_with_user(s.fact_items(t), t.orders))
    recs = recommend.segment_recommendations(segments(t), affinity, t.orders, t.order_items, t.products, 8)
    pack = personalise.personalisation(segments(t), behaviour(t), hints(t), recs)
    return pack.withColumn("hints", F.array_join("hints", "; ")).drop("recommended")


def snapshots(t):
    """The product list as it is, and a later one with other prices and stock."""
    later = t.products.withColumns(
        {"price": F.round(F.col("price") * (1 - (F.col("id") % 4) * 0.1), 2), "stock": F.when(F.col("stock") == 0, 5).otherwise(F.col("stock"))}
    )
    return t.products, later


add_cte("s_later", "SELECT * REPLACE (round(price * (1 - (id % 4) * 0.1::double), 2) AS price, CASE WHEN stock = 0 THEN 5 ELSE stock END AS stock) FROM r_products")


@query("C20_price_drop_alerts", """SELECT w.user_id, o.id AS product_id, 'price_drop' AS alert_type, o.price AS old_price, n.price AS new_price, round((o.price - n.price) / o.price * 100, 2) AS discount_percent,
    'Price drop on ' || n.name || '!' AS title, CASE WHEN round((o.price - n.price) / o.price * 100, 2) > 20 THEN 'high' ELSE 'medium' END AS priority, EV_AS_OF + INTERVAL 3 DAY AS expires_at
    FROM (SELECT DISTINCT user_id, product_id FROM r_wishlist) w JOIN r_products o ON w.product_id = o.id JOIN s_later n ON o.id = n.id WHERE n.price < o.price""")
def _(t):
    old, new = snapshots(t)
    return customers.price_drop_alerts(old, new, t.wishlist_items, t.events_as_of)


@query("C21_back_in_stock_alerts", """SELECT w.user_id, o.id AS product_id, 'stock' AS alert_type, n.name || ' is back in stock!' AS title, 'high' AS priority, EV_AS_OF + INTERVAL 7 DAY AS expires_at
    FROM (SELECT DISTINCT user_id, product_id FROM r_wishlist) w JOIN r_products o ON w.product_id = o.id JOIN s_later n ON o.id = n.id WHERE o.stock = 0 AND n.stock > 0""")
def _(t):
    old, new = snapshots(t)
    return customers.back_in_stock_alerts(old, new, t.wishlist_items, t.events_as_of)


@query("I04_inventory_simple", """WITH v AS (SELECT *, CASE WHEN total_sold > 0 THEN total_sold / 90 ELSE 0.0 END AS v FROM s_dim_products), d AS (SELECT *, CASE WHEN v > 0 THEN stock / v ELSE 999.0 END AS d FROM v)
    SELECT id, sku, category, stock, total_sold, total_revenue, stock_status, rnd2(v) AS daily_velocity, rnd1(d) AS days_of_inventory, CASE WHEN total_revenue > 50000 THEN 'A' WHEN total_revenue > 10000 THEN 'B' ELSE 'C' END AS abc_classification,
    d < 30 OR stock < 10 AS reorder_recommended, CASE WHEN d < 30 OR stock < 10 THEN greatest(0, trunc(v * 60 - stock)::int) ELSE 0 END AS suggested_reorder_qty FROM d""")
def _(t):
    return inventory.inventory_simple(s.dim_products(t))


@query("I05_shortage_forecast", """SELECT p.id AS product_id, name, stock AS current_stock, round(units / 30, 2) AS avg_daily_sales, round(stock / (units / 30), 1) AS predicted_stockout_days,
    CASE WHEN stock / (units / 30) <= 7 THEN 'high' ELSE 'medium' END AS urgency FROM r_products p JOIN s_recent r ON p.id = r.product_id WHERE units > 0 AND stock < 10 AND stock / (units / 30) <= 14""")
def _(t):
    return inventory.shortage_forecast(t.products, t.orders, t.order_items, t.as_of)


@query("I06_reorder_recommendations", """WITH v AS (SELECT p.*, coalesce(units, 0) / 30 AS v FROM r_products p LEFT JOIN s_recent r ON p.id = r.product_id), x AS (SELECT *, v * 7 + v * 7 AS point, greatest(0, v * 7 + v * 7 - stock) AS need FROM v)
    SELECT id AS product_id, name, stock AS current_stock, round(point, 0) AS reorder_point, round(greatest(need, v * 30), 0) AS recommended_quantity, round(v * 7, 2) AS lead_time_demand, round(v * 7, 2) AS safety_stock,
    CASE WHEN stock < v * 7 THEN 'high' ELSE 'medium' END AS priority FROM x WHERE need > 0 OR stock < point * 0.5""")
def _(t):
    return inventory.reorder_recommendations(t.products, t.orders, t.order_items, t.as_of)


@query("I07_dead_stock", """SELECT 'dead_stock' AS type, id AS product_id, name, stock AS current_stock, 'medium' AS severity FROM r_products WHERE stock > 50 AND id NOT IN (SELECT product_id FROM s_recent_all WHERE units <> 0)""")
def _(t):
    return inventory.dead_stock(t.products, t.orders, t.order_items, t.as_of)


@query("I08_pricing_hints", """SELECT p.id AS product_id, name AS title, 'Increase Price' AS action, price AS current_price, round(a, 2) AS suggested_price FROM r_products p JOIN (SELECT product_id,
    cast(sum(cast(unit_price AS decimal(20,8))) AS double) / count(unit_price) AS a FROM r_items GROUP BY 1) i ON p.id = i.product_id WHERE a > price * 1.1""")
def _(t):
    return inventory.pricing_hints(t.products, t.order_items)


@query("I09_promotion_ranking", """SELECT r.product_id, name AS title, category, price, stock, revenue * 0.7::double + units * 0.3::double AS performance_score, CASE WHEN stock > 20 THEN 'Promote' ELSE 'Restock & Promote' END AS action
    FROM s_recent r JOIN r_products p ON r.product_id = p.id ORDER BY units DESC, r.product_id LIMIT 5""")
def _(t):
    return inventory.promotion_ranking(t.products, t.orders, t.order_items, t.as_of)


# --- exports -------------------------------------------------------------------------------

SALES = "SELECT * EXCLUDE (unit_price) FROM s_sales_export WHERE order_date >= AS_OF - INTERVAL 90 DAY"
CUSTOMERS = """SELECT c.id AS customer_id, name, email, phone, created_at AS registration_date, total_orders, total_spent, rnd2(avg_order_value) AS average_order_value, last_order_date,
    coalesce(f.category, 'N/A') AS favorite_category, is_admin FROM s_dim_customers c LEFT JOIN s_favourite f ON c.id = f.user_id"""
INVENTORY = """SELECT p.id AS product_id, sku, name, category, description, price, stock AS current_stock, coalesce(r.units, 0) AS units_sold_30d, round(coalesce(r.units, 0) / 30, 2) AS daily_velocity,
    coalesce(rnd1(stock * 30 / nullif(coalesce(r.units, 0), 0)), 999.0) AS days_of_inventory, coalesce(m.total_revenue, 0.0) AS total_revenue,
    CASE WHEN stock < 10 THEN 'Low' WHEN stock < 50 THEN 'Medium' ELSE 'High' END AS stock_status, created_at FROM r_products p LEFT JOIN s_recent_all r ON p.id = r.product_id LEFT JOIN s_product_sales m ON p.id = m.product_id"""
TICKETS = """SELECT id AS ticket_id, ticket_number, created_at, customer_email, subject, issue, status, priority, source, sentiment, order_number FROM r_tickets WHERE created_at >= AS_OF - INTERVAL 90 DAY"""
DAILY = """SELECT c.date, coalesce(revenue, 0.0) AS revenue, coalesce(orders, 0) AS orders_count, (SELECT count(*) FROM r_users WHERE created_at::date = c.date) AS new_customers,
    (SELECT count(*) FROM r_tickets WHERE created_at::date = c.date) AS support_tickets, coalesce(rnd2(revenue / orders), 0.0) AS average_order_value, dayname(c.date) AS day_of_week,
    dayofweek(c.date) IN (0, 6) AS is_weekend FROM s_calendar30 c LEFT JOIN s_by_day d ON c.date = d.date"""


@query("S24_dataflow_sales", "SELECT created_at, total_orders, total_revenue, total_profit FROM s_daily WHERE created_at >= cast(AS_OF - INTERVAL 90 DAY AS date)")
def _(t):
    flow = exports.dataflows(s.daily(t), s.customer_360(t), s.inventory(t), t.as_of)["sales"]
    return flow.select("created_at", "total_orders", "total_revenue", "total_profit")


@query("S24_dataflow_inventory", "SELECT id, stock, stock_alert, suggested_reorder_qty FROM s_inventory WHERE reorder_recommended")
def _(t):
    flow = exports.dataflows(s.daily(t), s.customer_360(t), s.inventory(t), t.as_of)["inventory"]
    return flow.select("id", "stock", "stock_alert", "suggested_reorder_qty")


@query("S24_dataflow_customers", "SELECT * FROM s_c360")
def _(t):
    return exports.dataflows(s.daily(t), s.customer_360(t), s.inventory(t), t.as_of)["customers"]


@query("S25_export_sales", SALES)
def _(t):
    return exports.export_sales(t.orders, t.order_items, t.products, t.as_of).drop("unit_price")


@query("S26_export_customers", CUSTOMERS)
def _(t):
    return exports.export_customers(t.users, t.orders, t.order_items, t.products)


@query("S27_export_inventory", INVENTORY)
def _(t):
    return exports.export_inventory(t.products, t.orders, t.order_items, t.as_of)


@query("S28_export_tickets", TICKETS)
def _(t):
    return exports.export_tickets(t.tickets, t.as_of)


@query("S29_daily_metrics", DAILY)
def _(t):
    return exports.daily_metrics(t.orders, t.users, t.tickets, t.as_of)


@query("S30_export_bundle", f"""SELECT 'sales_data' AS dataset, count(*) AS rows, '1.0' AS schema_version FROM ({SALES}) UNION ALL SELECT 'customer_data', count(*), '1.0' FROM ({CUSTOMERS})
    UNION ALL SELECT 'inventory_data', count(*), '1.0' FROM ({INVENTORY}) UNION ALL SELECT 'support_tickets', count(*), '1.0' FROM ({TICKETS}) UNION ALL SELECT 'daily_metrics', count(*), '1.0' FROM ({DAILY})""")
def _(t):
    root, out = shared_dir(t.spark, "exports"), None
    exports.write_exports(exports.all_exports(t.users, t.products, t.orders, t.order_items, t.tickets, t.as_of), root)
    for name in ("sales_data", "customer_data", "inventory_data", "support_tickets", "daily_metrics"):
        one = t.spark.read.parquet(f"{root}/{name}").groupBy("schema_version").agg(F.count(F.lit(1)).alias("rows")).withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


