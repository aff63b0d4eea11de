"""Dashboard figures, counters, report packs and top lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import lexicon
from ..functions.money import money_sum
from ..operators import customers, inventory, joins, metrics, ordered, recommend
from ..plans import kpis
from . import shared as s
from .q_joins import segments
from .registry import add_cte, query, sentiment_sql


@query("A11_headline_kpis", """SELECT msum(total_amount) AS total_revenue, count(*) AS total_orders,
    coalesce(msum(CASE WHEN created_at::date = NOON::date THEN total_amount END), 0.0) AS today_revenue,
    count(*) FILTER (created_at::date = NOON::date) AS today_orders,
    count(DISTINCT user_id) FILTER (created_at >= NOON - INTERVAL 30 DAY) AS active_users,
    (SELECT count(*) FROM r_users) AS total_customers, (SELECT count(*) FROM r_products) AS total_products,
    round(msum(total_amount) * 0.2::double, 2) AS profit, round(msum(total_amount) / count(*), 2) AS avg_order_value FROM r_orders""")
def _(t):
    return kpis.headline(t.users, t.products, t.orders, t.noon)


add_cte("s_calendar30", "SELECT unnest(generate_series(cast(AS_OF - INTERVAL 30 DAY AS date), cast(AS_OF - INTERVAL 1 DAY AS date), INTERVAL 1 DAY))::date AS date")
add_cte("s_by_day", "SELECT created_at::date AS date, msum(total_amount) AS revenue, count(*) AS orders FROM r_orders GROUP BY 1")


@query("A12_dense_daily", """SELECT c.date, coalesce(revenue, 0.0) AS revenue, coalesce(orders, 0) AS orders FROM s_calendar30 c
    LEFT JOIN s_by_day d ON c.date = d.date""")
def _(t):
    return kpis.dense_daily(t.orders, t.as_of, 30)


@query("A13_customer_growth", """SELECT b::int AS bucket, strftime(AS_OF - INTERVAL 180 DAY + to_days(cast(30 * b AS int)), '%Y-%m') AS month, (SELECT count(*) FROM r_users
    WHERE created_at >= AS_OF - INTERVAL 180 DAY + to_days(cast(30 * b AS int)) AND created_at < AS_OF - INTERVAL 180 DAY + to_days(cast(30 * b + 30 AS int)))
    AS new_customers FROM range(6) r(b)""")
def _(t):
    return kpis.customer_growth(t.users, t.as_of, 6)


@query("A14_category_stock", "SELECT category, sum(stock)::bigint AS total_stock, count(*) AS total_products FROM r_products GROUP BY 1")
def _(t):
    return kpis.category_stock(t.products)


@query("A15_status_breakdown", f"""SELECT s.status, count(o.id) AS orders FROM (SELECT unnest({fv.ORDER_STATUSES}) AS status) s
    LEFT JOIN r_orders o ON s.status = o.status GROUP BY 1""")
def _(t):
    return kpis.status_breakdown(t.orders)


@query("A16_insight_flags", """WITH k AS (SELECT (SELECT msum(total_amount) FROM r_orders) AS revenue, (SELECT count(*) FROM r_orders) AS orders,
    (SELECT count(*) FROM r_products WHERE stock < 5) AS low, (SELECT count(DISTINCT user_id) FROM r_orders WHERE created_at >= AS_OF - INTERVAL 30 DAY) AS active,
    (SELECT count(*) FROM r_tickets WHERE status = 'Open') AS open),
    x AS (SELECT list_filter([CASE WHEN revenue > 100000 THEN 'Revenue exceeded ₹1L this month - strong performance' END,
    CASE WHEN orders > 500 THEN 'Order volume is high - consider scaling operations' END,
    CASE WHEN low > 10 THEN low || ' products are running low on stock - urgent restocking needed' END,
    CASE WHEN active > 50 THEN 'High customer retention rate - loyalty programs effective' END,
    CASE WHEN open > 20 THEN open || ' pending support tickets - allocate more resources' END], lambda x: x IS NOT NULL) AS l FROM k)
    SELECT unnest(range(len(l)))::int AS pos, unnest(l) AS insight FROM x""")
def _(t):
    return kpis.insight_flags(t.orders, t.products, t.tickets, t.as_of)


@query("A17_period_metrics", """SELECT msum(total_amount) AS revenue_total,
    coalesce(msum(CASE WHEN created_at::date = NOON::date THEN total_amount END), 0.0) AS revenue_today,
    coalesce(msum(CASE WHEN created_at >= NOON - INTERVAL 30 DAY THEN total_amount END), 0.0) AS revenue_month,
    coalesce(msum(CASE WHEN created_at >= NOON - INTERVAL 60 DAY AND created_at < NOON - INTERVAL 30 DAY THEN total_amount END), 0.0) AS revenue_previous,
    count(*) AS orders_total, count(*) FILTER (created_at::date = NOON::date) AS orders_today, count(*) FILTER (created_at >= NOON - INTERVAL 30 DAY) AS orders_month,
    (SELECT count(*) FROM r_users) AS customers_total, (SELECT count(*) FROM r_users WHERE created_at >= NOON - INTERVAL 30 DAY) AS customers_new,
    (SELECT count(*) FROM r_products) AS products_total, (SELECT count(*) FROM r_products WHERE stock < 10) AS low_stock,
    (SELECT count(*) FROM r_tickets WHERE status = 'Open') AS open_tickets, (SELECT count(*) FROM r_tickets WHERE status = 'Open' AND priority = 'High') AS high_priority,
    coalesce(round((revenue_month - revenue_previous) / nullif(revenue_previous, 0) * 100, 1), 0.0) AS trend_percent FROM r_orders""")
def _(t):
    return kpis.period_metrics(t.orders, t.users, t.products, t.tickets, t.noon)


@query("A18_seasonal_months", """WITH m AS (SELECT year(created_at) AS y, month(created_at) AS month, msum(total_amount) AS revenue FROM r_orders
    WHERE status IN ('Delivered', 'Shipped') GROUP BY 1, 2), a AS (SELECT month::int AS month, count(*) AS years, mavg(revenue) AS revenue FROM m GROUP BY 1)
    SELECT month, years, revenue, round(revenue / avg(revenue) OVER (), 6) AS level, CASE WHEN revenue / avg(revenue) OVER () > 1.2 THEN 'peak'
    WHEN revenue / avg(revenue) OVER () < 0.8 THEN 'low' END AS type FROM a""")
def _(t):
    return kpis.seasonal_months(t.orders).withColumn("level", F.round("level", 6))


add_cte("s_series", """SELECT created_at::date AS date, msum(total_amount) AS revenue, count(*) AS orders FROM r_orders
    WHERE status IN ('Delivered', 'Shipped', 'Out for Delivery') GROUP BY 1""")
add_cte("s_series90", """SELECT created_at::date AS date, msum(total_amount) AS revenue, count(*) AS orders FROM r_orders
    WHERE status IN ('Delivered', 'Shipped', 'Out for Delivery') AND created_at >= AS_OF - INTERVAL 90 DAY GROUP BY 1""")


@query("A19_sales_series", "SELECT * FROM s_series90")
def _(t):
    return metrics.sales_series(t.orders, t.as_of, 90)


@query("A20_product_series", """SELECT created_at::date AS date, product_id, sum(quantity)::bigint AS quantity FROM s_items_user
    WHERE status IN ('Delivered', 'Shipped') AND created_at >= AS_OF - INTERVAL 90 DAY GROUP BY 1, 2""")
def _(t):
    return metrics.product_series(t.orders, t.order_items, t.as_of, 90)


@query("A21_warehouse_totals", """SELECT category, sum(stock)::bigint AS total_stock, msum(price * stock) AS total_value, count(*) AS product_count,
    count(*) FILTER (stock < 10) AS low_stock_count, count(*) FILTER (stock = 0) AS out_of_stock_count FROM r_products GROUP BY GROUPING SETS ((category), ())""")
def _(t):
    return inventory.warehouse_totals(t.products)


@query("A22_trend_pack", """WITH d AS (SELECT * FROM r_orders WHERE status IN ('Delivered', 'Shipped') AND created_at >= AS_OF - INTERVAL 30 DAY)
    SELECT 'day' AS kind, created_at::date::varchar AS label, count(*) AS orders, NULL::bigint AS units, msum(total_amount) AS revenue FROM d GROUP BY 2 UNION ALL
    SELECT 'hour', lpad(hour(created_at)::varchar, 2, '0'), count(*), NULL, msum(total_amount) FROM d GROUP BY 2 UNION ALL
    SELECT 'category', category, NULL, sum(quantity)::bigint, msum(quantity * unit_price) FROM s_items_user WHERE status IN ('Delivered', 'Shipped')
    AND created_at >= AS_OF - INTERVAL 30 DAY GROUP BY 2""")
def _(t):
    return kpis.trend_pack(t.orders, t.order_items, t.products, t.as_of)


@query("A23_top_performers", """SELECT r.product_id, name, category, units AS units_sold, revenue, stock FROM s_recent r JOIN r_products p ON r.product_id = p.id
    ORDER BY units DESC, r.product_id LIMIT 10""")
def _(t):
    return inventory.top_performers(t.products, t.orders, t.order_items, t.as_of)


@query("A23_under_performers", """SELECT p.id AS product_id, name, stock, coalesce(units, 0) AS monthly_sales, round(coalesce(units, 0) / stock, 3) AS turnover_rate
    FROM r_products p LEFT JOIN s_recent r ON r.product_id = p.id WHERE stock > 50 AND coalesce(units, 0) < 5""")
def _(t):
    return inventory.under_performers(t.products, t.orders, t.order_items, t.as_of)


@query("A24_payment_breakdown", """SELECT payment_method, count(*) AS orders,
    coalesce(msum(CASE WHEN payment_status = 'Completed' THEN total_amount END), 0.0) AS completed_amount,
    coalesce(msum(CASE WHEN payment_status = 'Pending' THEN total_amount END), 0.0) AS pending_amount,
    count(*) FILTER (payment_method = 'COD') AS cod_orders, count(*) FILTER (payment_method <> 'COD') AS online_orders
    FROM r_orders GROUP BY GROUPING SETS ((payment_method), ())""")
def _(t):
    return kpis.payment_breakdown(t.orders)


@query("A25_order_counters", """SELECT count(*) AS total_orders, msum(total_amount) AS total_revenue, count(*) FILTER (status = 'Processing') AS pending_orders,
    count(*) FILTER (status = 'Shipped') AS shipped_orders, count(*) FILTER (status = 'Delivered') AS delivered_orders,
    count(*) FILTER (status = 'Cancelled') AS cancelled_orders FROM r_orders""")
def _(t):
    return kpis.order_counters(t.orders)


@query("A26_inventory_health", """SELECT category, count(*) AS products, count(*) FILTER (stock > 0 AND stock < 10) AS low_stock,
    count(*) FILTER (stock = 0) AS out_of_stock, count(*) FILTER (stock >= 10) AS healthy_stock, msum(price * stock) AS value
    FROM r_products GROUP BY GROUPING SETS ((category), ())""")
def _(t):
    return kpis.inventory_health(t.products)


@query("A27_customer_page", """SELECT u.id, u.name, u.email, date_trunc('month', u.created_at) = date_trunc('month', AS_OF - INTERVAL 12 HOUR) AS new_this_month,
    count(o.id) AS order_count, coalesce(msum(o.total_amount), 0.0) AS total_spent FROM r_users u LEFT JOIN r_orders o ON u.id = o.user_id
    WHERE NOT u.is_admin GROUP BY ALL""")
def _(t):
    return kpis.customer_page(t.users, t.orders, t.noon)


@query("A28_product_page", """SELECT count(*) AS total_products, count(*) FILTER (stock < 10) AS low_stock_count, count(*) FILTER (stock = 0) AS out_of_stock_count,
    msum(price * stock) AS total_value, count(DISTINCT category) AS categories FROM r_products""")
def _(t):
    return kpis.product_page(t.products)


@query("A29_ticket_counters", """SELECT count(*) AS total_tickets, count(*) FILTER (status = 'Open') AS open_tickets,
    count(*) FILTER (status = 'Open' AND priority = 'High') AS high_priority,
    count(*) FILTER (status = 'Resolved' AND created_at >= TIMESTAMP '2001-07-01') AS resolved_today FROM r_tickets""")
def _(t):
    return kpis.ticket_counters(t.tickets, "2001-07-01")


@query("A30_revenue_by_status", """SELECT payment_status, msum(total_amount) AS revenue, count(*) AS orders FROM r_orders
    WHERE payment_status IN ('Paid', 'Completed') GROUP BY 1""")
def _(t):
    return kpis.revenue_by_status(t.orders, ["Paid", "Completed"])


@query("A31_sentiment_distribution", """SELECT sentiment, count(*) AS reviews, round(count(*) / sum(count(*)) OVER () * 100, 1) AS percentage,
    round((SELECT avg(rating) FROM r_reviews), 2) AS average_rating FROM r_reviews GROUP BY 1""")
def _(t):
    return kpis.sentiment_distribution(t.reviews)


@query("A32_sentiment_trend", """SELECT c.date, count(*) FILTER (sentiment = 'positive') AS positive, count(*) FILTER (sentiment = 'neutral') AS neutral,
    count(*) FILTER (sentiment = 'negative') AS negative FROM s_calendar30 c LEFT JOIN r_reviews r ON r.created_at::date = c.date GROUP BY 1""")
def _(t):
    return kpis.sentiment_trend(t.reviews, t.as_of)


@query("A33_product_reviews", """SELECT product_id, sum(n)::bigint AS reviews, round(sum(r) / sum(n), 1) AS average_rating,
    string_agg(sentiment || '=' || n, ',' ORDER BY sentiment) AS sentiment_distribution FROM (SELECT product_id, sentiment, count(*) AS n, sum(rating) AS r
    FROM r_reviews GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    return kpis.product_reviews(t.reviews).withColumn("sentiment_distribution", map_text("sentiment_distribution"))


def map_text(c):
    pairs = F.array_sort(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return F.array_join(pairs, ",")


@query("A34_feedback_summary", """SELECT sentiment, count(*) AS feedback FROM (SELECT sentiment FROM r_tickets UNION ALL
    SELECT CASE WHEN lower(activity_details) LIKE '%sentiment: positive%' OR lower(activity_details) LIKE '%sentiment=positive%' THEN 'positive'
    WHEN lower(activity_details) LIKE '%sentiment: negative%' OR lower(activity_details) LIKE '%sentiment=negative%' THEN 'negative'
    WHEN lower(activity_details) LIKE '%sentiment: mixed%' THEN 'neutral' END FROM r_activities WHERE activity_type = 'feedback')
    WHERE sentiment IS NOT NULL GROUP BY 1""")
def _(t):
    return kpis.feedback_summary(t.tickets, t.activities)


@query("A35_chat_counts", f"""SELECT sentiment, count(*) AS chats FROM (SELECT {sentiment_sql('text', fv.CHAT_POSITIVE, fv.CHAT_NEGATIVE)} AS sentiment FROM conversations)
    GROUP BY ROLLUP (sentiment)""")
def _(t):
    return kpis.chat_counts(t.raw("conversations").select(lexicon.chat_sentiment("text").alias("sentiment")))


@query("A36_customer_order_analytics", """WITH st AS (SELECT user_id, string_agg(status || '=' || n, ',' ORDER BY status) AS v FROM (SELECT user_id, status, count(*) AS n
    FROM r_orders GROUP BY 1, 2) GROUP BY 1), mo AS (SELECT user_id, string_agg(m || ':' || n, ',' ORDER BY m) AS v FROM (SELECT user_id,
    strftime(created_at, '%Y-%m') AS m, count(*) AS n FROM r_orders GROUP BY 1, 2) GROUP BY 1), ca AS (SELECT user_id,
    string_agg(category || ':' || items_bought, ',' ORDER BY items_bought DESC, category) AS v FROM (SELECT * FROM s_cat_qty
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY items_bought DESC, category) <= 5) GROUP BY 1)
    SELECT u.id AS user_id, coalesce(m.total_orders, 0) AS total_orders, coalesce(m.total_spent, 0.0) AS total_spent, coalesce(m.avg_order_value, 0.0) AS avg_order_value,
    st.v AS order_status_breakdown, mo.v AS spending_trends, ca.v AS favorite_categories,
    concat_ws(',', CASE WHEN ca.v IS NOT NULL THEN 'category' END, CASE WHEN m.total_spent > 5000 THEN 'loyalty' END, CASE WHEN m.total_orders >= 5 THEN 'frequency' END) AS offers
    FROM r_users u LEFT JOIN s_cust_metrics m ON u.id = m.user_id LEFT JOIN st ON u.id = st.user_id LEFT JOIN mo ON u.id = mo.user_id LEFT JOIN ca ON u.id = ca.user_id""")
def _(t):
    pack = kpis.customer_order_analytics(t.users, t.orders, joins.items_with_user(s.fact_items(t), t.orders))
    months = F.transform("spending_trends", lambda x: F.concat(x["month"], F.lit(":"), x["orders"].cast("string")))
    cats = F.transform("favorite_categories", lambda x: F.concat(x["category"], F.lit(":"), x["items_bought"].cast("string")))
    return pack.withColumns(
        {
            "order_status_breakdown": map_text("order_status_breakdown"), "spending_trends": F.array_join(months, ","),
            "favorite_categories": F.array_join(cats, ","), "offers": F.array_join("offers", ","),
        }
    ).drop("avg_delivery_days")


@query("A37_user_activity_summary", """SELECT u.id AS user_id, coalesce(l.n, 0) AS login_count, coalesce(o.n, 0) AS orders_count, coalesce(o.v, 0.0) AS total_spent,
    a.v AS recent_activities FROM r_users u
    LEFT JOIN (SELECT user_id, count(*) FILTER (activity_type = 'login') AS n FROM r_activities WHERE created_at >= EV_AS_OF - INTERVAL 30 DAY GROUP BY 1) l ON u.id = l.user_id
    LEFT JOIN (SELECT user_id, count(*) AS n, msum(total_amount) AS v FROM r_orders WHERE created_at >= AS_OF - INTERVAL 30 DAY GROUP BY 1) o ON u.id = o.user_id
    LEFT JOIN (SELECT user_id, string_agg(activity_type, ',' ORDER BY created_at DESC, id DESC) AS v FROM (SELECT * FROM r_activities
        WHERE created_at >= EV_AS_OF - INTERVAL 30 DAY QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) <= 20) GROUP BY 1) a ON u.id = a.user_id""")
def _(t):
    pack = kpis.user_activity_summary(t.users, t.orders, t.activities, t.as_of, t.events_as_of)
    return pack.withColumn("recent_activities", F.array_join(F.transform("recent_activities", lambda x: x["type"]), ","))


@query("A39_lakehouse_dashboard", """SELECT (SELECT msum(total_revenue) FROM s_daily) AS total_revenue, (SELECT sum(total_orders)::bigint FROM s_daily) AS total_orders,
    (SELECT count(*) FROM s_c360) AS active_customers, (SELECT count(*) FROM s_c360 WHERE rfm_segment = 'Champions') AS vip_customers,
    (SELECT count(*) FROM s_c360 WHERE churn_risk_segment = 'High Risk') AS at_risk_customers,
    (SELECT count(*) FROM s_inventory WHERE stock_status IN ('Out of Stock', 'Low Stock')) AS products_critical_stock,
    (SELECT count(*) FROM s_inventory WHERE reorder_recommended) AS products_reorder_needed, (SELECT count(*) FROM s_features WHERE is_any_anomaly) AS anomalies_detected,
    round((SELECT msum(total_revenue) / sum(total_orders) FROM s_daily), 2) AS avg_order_value""")
def _(t):
    return kpis.lakehouse_dashboard(s.daily(t), s.customer_360(t), s.inventory(t), s.anomaly_features(t))


@query("A40_file_summary", """SELECT msum(revenue) AS total_revenue, sum(orders)::bigint AS total_orders, count(*) AS records, min(date) AS period_start, max(date) AS period_end,
    round(msum(revenue) / sum(orders), 2) AS avg_order_value FROM s_series""")
def _(t):
    return kpis.file_summary(metrics.sales_series(t.orders, t.as_of, None))


@query("A41_document_stats", """SELECT status, document_type, count(*) AS documents FROM r_documents GROUP BY GROUPING SETS ((status), (document_type), ())""")
def _(t):
    return kpis.document_stats(t.documents)


@query("A41_newest_documents", """SELECT row_number() OVER (ORDER BY created_at DESC, document_id DESC)::int AS rank, document_id, filename, document_type, status, created_at FROM r_documents QUALIFY rank <= 5""")
def _(t):
    return kpis.newest_documents(t.documents)


@query("A42_run_log_summary", """SELECT pipeline_id, arg_max(status, (start_time, run_id)) AS status, max(start_time) AS last_run,
    round(count(*) FILTER (status = 'success') / count(*) * 100, 1) AS success_rate, count(*) AS total_runs FROM r_runs GROUP BY 1""")
def _(t):
    return kpis.run_log_summary(t.run_log)


add_cte("s_sales_export", """SELECT o.id AS order_id, o.order_number, o.created_at AS order_date, o.user_id AS customer_id, o.customer_name, i.product_id, i.product_name,
    coalesce(p.category, 'Unknown') AS category, i.quantity, i.unit_price, i.quantity * i.unit_price AS total_amount, o.total_amount AS order_total, o.status,
    o.payment_method, o.city, o.state FROM r_orders o JOIN r_items i ON o.id = i.order_id LEFT JOIN r_products p ON i.product_id = p.id""")


@query("A43_report_measures", """SELECT msum(total_amount) AS total_revenue, count(DISTINCT order_id) AS total_orders,
    msum(total_amount) / count(DISTINCT order_id) AS average_order_value FROM s_sales_export""")
def _(t):
    from ..plans import exports

    return kpis.report_measures(exports.export_sales(t.orders, t.order_items, t.products, t.as_of, None))


@query("A44_segment_counts", f"""SELECT n.segment, count(g.user_id) AS customers FROM (SELECT unnest({list(fv.SEGMENT_ACTIONS)}) AS segment) n
    LEFT JOIN s_segments g ON n.segment = g.segment GROUP BY 1""")
def _(t):
    return customers.segment_counts(segments(t))


@query("A45_value_clusters", """WITH c AS (SELECT *, CASE WHEN total_spent > 50000 AND total_orders > 20 THEN 0 WHEN recency_days < 30 AND total_orders > 5 THEN 1
    WHEN total_orders < 3 THEN 2 WHEN recency_days > 90 THEN 4 ELSE 3 END AS cluster FROM s_cfeat)
    SELECT n.cluster::int AS cluster, n.name, count(c.user_id) AS count, coalesce(mavg(c.total_spent), 0.0) AS avg_spend FROM (SELECT unnest(range(5)) AS cluster,
    unnest(['VIP Customers', 'Active Shoppers', 'New Customers', 'At Risk', 'Inactive']) AS name) n LEFT JOIN c ON n.cluster = c.cluster GROUP BY 1, 2""")
def _(t):
    features = customers.customer_features(t.users, t.orders, t.order_items, t.products, t.as_of)
    return customers.value_clusters(features)


@query("T01_top_sellers", """SELECT p.id, p.name, p.category, p.price, m.total_sold, m.total_revenue FROM s_product_sales m JOIN r_products p ON m.product_id = p.id
    ORDER BY m.total_sold DESC, p.id LIMIT 10""")
def _(t):
    sold = metrics.product_sales(t.order_items).withColumnRenamed("product_id", "id")
    best = sold.join(t.products.select("id", "name", "category", "price"), "id")
    return best.orderBy(F.desc("total_sold"), "id").limit(10)


@query("T02_recent_orders", "SELECT id, order_number, status, created_at FROM r_orders ORDER BY created_at DESC, id DESC LIMIT 12")
def _(t):
    return ordered.top_n(t.orders.select("id", "order_number", "status", "created_at"), [], [F.desc("created_at"), F.desc("id")], 12)


@query("T03_top_customers", """SELECT u.id, u.name, u.email, m.total_orders AS orders, m.total_spent AS spent FROM s_cust_metrics m JOIN r_users u ON m.user_id = u.id
    WHERE NOT is_admin ORDER BY m.total_spent DESC, u.id LIMIT 8""")
def _(t):
    spent = t.orders.groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("orders"), money_sum("total_amount").alias("spent"))
    people = t.users.filter(~F.col("is_admin")).select("id", "name", "email")
    return spent.join(people, "id").orderBy(F.desc("spent"), "id").limit(8)


@query("T06_popular_products", """SELECT row_number() OVER (ORDER BY stock DESC, created_at DESC, id)::int AS rank, id AS product_id FROM r_products QUALIFY rank <= 4""")
def _(t):
    return recommend.popular(t.products, 4)


@query("T08_best_days", """SELECT row_number() OVER (ORDER BY revenue DESC, date)::int AS rank, date, revenue, orders FROM s_series QUALIFY rank <= 6""")
def _(t):
    series = metrics.sales_series(t.orders, t.as_of, None)
    return ordered.top_n(series, [], [F.desc("revenue"), F.asc("date")], 6, rank="rank")


@query("W18_order_hour_grid", """WITH k AS (SELECT * FROM r_orders WHERE created_at >= AS_OF - INTERVAL 7 DAY), m AS (SELECT mavg(total_amount) AS mean, stddev_pop(total_amount) AS std FROM k)
    SELECT (['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'])[d + 1] AS day, d::int AS day_index, h::int AS hour, count(k.id) AS order_count,
    count(*) FILTER (abs(total_amount - mean) > std * 2) AS anomaly_count,
    coalesce(round(count(*) FILTER (abs(total_amount - mean) > std * 2) / nullif(count(k.id), 0) * 100, 1), 0.0) AS anomaly_rate
    FROM range(7) a(d), range(24) b(h), m LEFT JOIN k ON dayofweek(k.created_at) = d AND hour(k.created_at) = h GROUP BY d, h""")
def _(t):
    return kpis.order_hour_grid(t.orders, t.as_of)


@query("W18_hour_matrix", "SELECT dayofweek(created_at)::int AS day_index, (['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat'])[dayofweek(created_at) + 1] AS day, "
       + ", ".join(f"count(*) FILTER (hour(created_at) = {h}) AS h{h:02d}" for h in range(24)) + " FROM r_orders GROUP BY 1, 2")
def _(t):
    return kpis.hour_matrix(kpis.order_hour_grid(t.orders, t.as_of, None))


@query("W19_day_change_alerts", """WITH k AS (SELECT coalesce(msum(CASE WHEN created_at::date = (AS_OF - INTERVAL 1 DAY)::date THEN total_amount END), 0.0) AS r1,
    coalesce(msum(CASE WHEN created_at::date = (AS_OF - INTERVAL 2 DAY)::date THEN total_amount END), 0.0) AS r0,
    count(*) FILTER (created_at::date = (AS_OF - INTERVAL 1 DAY)::date) AS o1, count(*) FILTER (created_at::date = (AS_OF - INTERVAL 2 DAY)::date) AS o0,
    count(*) FILTER (created_at::date = (AS_OF - INTERVAL 1 DAY)::date AND status = 'Cancelled') AS c1 FROM r_orders)
    SELECT 'revenue_anomaly' AS type, 'high' AS severity, printf('Revenue changed by %.1f%% compared to yesterday', (r1 - r0) / r0 * 100) AS message, round(r1, 2) AS value
    FROM k WHERE abs((r1 - r0) / nullif(r0, 0) * 100) > 50 UNION ALL
    SELECT 'order_anomaly', 'medium', printf('Order volume changed by %.1f%% compared to yesterday', (o1 - o0) / o0 * 100), o1::double FROM k
    WHERE abs((o1 - o0) / nullif(o0, 0) * 100) > 50 UNION ALL
    SELECT 'cancellation_anomaly', 'high', printf('High cancellation rate: %.1f%% today', c1 / o1 * 100), round(c1 / o1 * 100, 2) FROM k WHERE c1 / nullif(o1, 0) * 100 > 20""")
def _(t):
    return kpis.day_change_alerts(t.orders, t.as_of)


@query("W20_revenue_trend", """SELECT *, (revenue - lag(revenue) OVER (ORDER BY month)) / nullif(lag(revenue) OVER (ORDER BY month), 0) * 100 AS revenue_trend_pct
    FROM (SELECT date_trunc('month', order_date)::date AS month, msum(total_amount) AS revenue FROM s_sales_export GROUP BY 1)""")
def _(t):
    from ..plans import exports

    return kpis.revenue_trend(exports.export_sales(t.orders, t.order_items, t.products, t.as_of, None))
