"""Frames that several queries start from, and the SQL building blocks that mirror them."""

from __future__ import annotations

from ..plans import marts, staging
from ..sources.canonical import Retail
from .registry import add_cte


def fact_items(t: Retail):
    return staging.fact_order_items(t.order_items, t.products, t.orders)


def dim_customers(t: Retail):
    return staging.dim_customers(t.users, t.orders, t.as_of)


def dim_products(t: Retail):
    return staging.dim_products(t.products, t.order_items)


def daily(t: Retail):
    return marts.sales_daily(t.orders, t.order_items, t.products)


def customer_360(t: Retail):
    return marts.customer_360(dim_customers(t), t.orders, fact_items(t), t.as_of)


def inventory(t: Retail):
    return marts.inventory_analytics(dim_products(t), fact_items(t))


def anomaly_features(t: Retail):
    return marts.anomaly_features(daily(t))


add_cte("s_cust_metrics", """SELECT user_id, count(*) AS total_orders, msum(total_amount) AS total_spent,
    mavg(total_amount) AS avg_order_value, max(created_at) AS last_order_date FROM r_orders GROUP BY user_id""")
add_cte("s_dim_customers", """SELECT u.*, coalesce(m.total_orders, 0) AS total_orders, coalesce(m.total_spent, 0.0) AS total_spent,
    coalesce(m.avg_order_value, 0.0) AS avg_order_value, m.last_order_date,
    CASE WHEN coalesce(m.total_spent, 0.0) > 10000 THEN 'VIP' WHEN coalesce(m.total_spent, 0.0) > 5000 THEN 'Gold'
        WHEN coalesce(m.total_spent, 0.0) > 1000 THEN 'Silver' ELSE 'Bronze' END AS customer_segment,
    cast(AS_OF AS date) AS effective_date, DATE '9999-12-31' AS expiration_date, true AS is_current
    FROM r_users u LEFT JOIN s_cust_metrics m ON u.id = m.user_id""")
add_cte("s_product_sales", """SELECT product_id, sum(quantity)::bigint AS total_sold, msum(quantity * unit_price) AS total_revenue
    FROM r_items GROUP BY product_id""")
add_cte("s_dim_products", """SELECT p.*, coalesce(s.total_sold, 0)::bigint AS total_sold, coalesce(s.total_revenue, 0.0) AS total_revenue,
    round(price * stock, 2) AS inventory_value,
    CASE WHEN stock = 0 THEN 'Out of Stock' WHEN stock < 10 THEN 'Low Stock' WHEN stock < 50 THEN 'Medium Stock' ELSE 'In Stock' END AS stock_status,
    CASE WHEN coalesce(s.total_sold, 0) > 100 THEN 'High' WHEN coalesce(s.total_sold, 0) > 20 THEN 'Medium' ELSE 'Low' END AS product_performance
    FROM r_products p LEFT JOIN s_product_sales s ON p.id = s.product_id""")
add_cte("s_rollup", """SELECT order_id, sum(quantity)::bigint AS total_items, count(*) AS line_count,
    count(DISTINCT product_id) AS distinct_products FROM r_items GROUP BY order_id""")
add_cte("s_fact_orders", """SELECT o.*, r.total_items, r.line_count, r.distinct_products, year(created_at) AS order_year,
    month(created_at) AS order_month, day(created_at) AS order_day, dayofweek(created_at) + 1 AS order_weekday,
    quarter(created_at) AS order_quarter, dayofweek(created_at) IN (0, 6) AS is_weekend,
    CASE status WHEN 'Delivered' THEN 3 WHEN 'Shipped' THEN 2 WHEN 'Processing' THEN 5 END AS expected_delivery_days
    FROM r_orders o LEFT JOIN s_rollup r ON o.id = r.order_id""")
add_cte("s_fact_items", """SELECT i.*, p.category, o.created_at, o.status AS order_status, unit_price * 0.6 AS unit_cost,
    quantity * unit_price AS line_revenue, quantity * (unit_price * 0.6) AS line_cost,
    quantity * unit_price - quantity * (unit_price * 0.6) AS line_profit,
    round((quantity * unit_price - quantity * (unit_price * 0.6)) / nullif(quantity * unit_price, 0) * 100, 2) AS profit_margin
    FROM r_items i LEFT JOIN r_products p ON i.product_id = p.id LEFT JOIN r_orders o ON i.order_id = o.id""")
add_cte("s_daily_sales", """SELECT cast(created_at AS date) AS created_at, count(*) AS total_orders, msum(total_amount) AS total_revenue,
    mavg(total_amount) AS avg_order_value, coalesce(sum(total_items), 0)::bigint AS total_items,
    count(DISTINCT user_id) AS unique_customers, count(*) FILTER (status = 'Delivered') AS delivered_orders,
    count(*) FILTER (status = 'Cancelled') AS cancelled_orders,
    round(count(*) FILTER (status = 'Cancelled') / count(*) * 100, 2) AS cancellation_rate
    FROM s_fact_orders GROUP BY 1""")
add_cte("s_daily_profit", """SELECT cast(created_at AS date) AS created_at, msum(line_revenue) AS item_revenue, psum(line_profit) AS total_profit,
    mavg(profit_margin) AS avg_profit_margin FROM s_fact_items GROUP BY 1""")
add_cte("s_daily", """SELECT d.*, p.item_revenue, p.total_profit, p.avg_profit_margin, year(d.created_at) AS year, month(d.created_at) AS month,
    quarter(d.created_at) AS quarter, weekofyear(d.created_at) AS week, dayofweek(d.created_at) + 1 AS weekday,
    dayofweek(d.created_at) IN (0, 6) AS is_weekend,
    round((total_revenue - lag(total_revenue) OVER w) / nullif(lag(total_revenue) OVER w, 0) * 100, 2) AS revenue_vs_yesterday,
    round((total_orders - lag(total_orders) OVER w) / nullif(lag(total_orders) OVER w, 0) * 100, 2) AS orders_vs_yesterday
    FROM s_daily_sales d LEFT JOIN s_daily_profit p ON d.created_at = p.created_at WINDOW w AS (ORDER BY d.created_at)""")
add_cte("s_weekly", """SELECT *, round((total_revenue - lag(total_revenue) OVER w) / nullif(lag(total_revenue) OVER w, 0) * 100, 2) AS wow_revenue_growth
    FROM (SELECT isoyear(created_at) AS year, weekofyear(created_at) AS week, count(*) AS total_orders, msum(total_amount) AS total_revenue,
        mavg(total_amount) AS avg_order_value, min(created_at)::date AS week_start, max(created_at)::date AS week_end,
        count(DISTINCT user_id) AS unique_customers, isoyear(created_at) || '-W' || weekofyear(created_at) AS year_week
        FROM r_orders GROUP BY isoyear(created_at), weekofyear(created_at)) WINDOW w AS (ORDER BY year, week)""")
add_cte("s_monthly", """SELECT *, round((total_revenue - lag(total_revenue) OVER w) / nullif(lag(total_revenue) OVER w, 0) * 100, 2) AS mom_revenue_growth
    FROM (SELECT year(created_at) AS year, month(created_at) AS month, count(*) AS total_orders, msum(total_amount) AS total_revenue,
        mavg(total_amount) AS avg_order_value, count(DISTINCT user_id) AS unique_customers, min(created_at)::date AS month_start,
        max(created_at)::date AS month_end, year(created_at) || '-' || month(created_at) AS year_month
        FROM r_orders GROUP BY year(created_at), month(created_at)) WINDOW w AS (ORDER BY year, month)""")
add_cte("s_rfm_base", """SELECT user_id, count(*) AS frequency, msum(total_amount) AS monetary,
    datediff('day', cast(max(created_at) AS date), cast(AS_OF AS date)) AS recency FROM r_orders GROUP BY user_id""")
add_cte("s_rfm_cuts", """SELECT quantile_disc(recency, [0.2, 0.4, 0.6, 0.8]) AS r, quantile_disc(frequency, [0.2, 0.4, 0.6, 0.8]) AS f,
    quantile_disc(monetary, [0.2, 0.4, 0.6, 0.8]) AS m FROM s_rfm_base""")
add_cte("s_rfm_scored", """SELECT b.*,
    CASE WHEN recency <= r[1] THEN 5 WHEN recency <= r[2] THEN 4 WHEN recency <= r[3] THEN 3 WHEN recency <= r[4] THEN 2 ELSE 1 END AS r_score,
    CASE WHEN frequency >= f[4] THEN 5 WHEN frequency >= f[3] THEN 4 WHEN frequency >= f[2] THEN 3 WHEN frequency >= f[1] THEN 2 ELSE 1 END AS f_score,
    CASE WHEN monetary >= m[4] THEN 5 WHEN monetary >= m[3] THEN 4 WHEN monetary >= m[2] THEN 3 WHEN monetary >= m[1] THEN 2 ELSE 1 END AS m_score
    FROM s_rfm_base b, s_rfm_cuts""")
add_cte("s_rfm", """SELECT *, r_score::varchar || f_score::varchar || m_score::varchar AS rfm_score,
    CASE WHEN r_score >= 4 AND f_score >= 4 AND m_score >= 4 THEN 'Champions' WHEN r_score >= 3 AND f_score >= 3 AND m_score >= 3 THEN 'Loyal Customers'
        WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customers' WHEN r_score <= 2 AND f_score >= 3 THEN 'At Risk'
        WHEN r_score <= 2 AND f_score <= 2 THEN 'Lost Customers' ELSE 'Potential Loyalists' END AS rfm_segment FROM s_rfm_scored""")
add_cte("s_items_user", """SELECT o.user_id, o.id AS order_id, o.status, o.created_at, i.product_id, i.quantity, i.unit_price, p.category
    FROM r_items i JOIN r_orders o ON i.order_id = o.id LEFT JOIN r_products p ON i.product_id = p.id""")
add_cte("s_cat_qty", "SELECT user_id, category, sum(quantity)::bigint AS items_bought FROM s_items_user GROUP BY 1, 2")
add_cte("s_favourite", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY items_bought DESC, category) AS rn
    FROM s_cat_qty) WHERE rn = 1""")
add_cte("s_c360_base", """SELECT c.*, r.recency, r.frequency, r.monetary, r.r_score, r.f_score, r.m_score, r.rfm_score, r.rfm_segment,
    f.category AS favorite_category,
    CASE WHEN recency IS NULL THEN NULL WHEN recency > 60 THEN 0.9::double WHEN recency > 30 THEN 0.6::double
        WHEN rfm_segment IN ('At Risk', 'Lost Customers') THEN 0.8::double ELSE 0.1::double END AS churn_risk_score
    FROM s_dim_customers c LEFT JOIN s_rfm r ON c.id = r.user_id LEFT JOIN s_favourite f ON c.id = f.user_id""")
add_cte("s_c360", """SELECT *, CASE WHEN churn_risk_score IS NULL THEN 'No Orders' WHEN churn_risk_score >= 0.7 THEN 'High Risk'
    WHEN churn_risk_score >= 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS churn_risk_segment FROM s_c360_base""")
add_cte("s_velocity", """SELECT product_id, sum(quantity)::bigint AS total_sold, count(DISTINCT cast(created_at AS date)) AS selling_days,
    max(created_at) AS last_sold_date, sum(quantity)::double / greatest(count(DISTINCT cast(created_at AS date)), 1) AS daily_velocity
    FROM s_fact_items GROUP BY product_id""")
add_cte("s_inv1", """SELECT p.*, v.last_sold_date, coalesce(v.daily_velocity, 0.0) AS daily_velocity,
    CASE WHEN v.daily_velocity > 0 THEN stock / v.daily_velocity ELSE 999.0 END AS days_of_inventory,
    cast(sum(cast(total_revenue AS decimal(18,2))) OVER (ORDER BY total_revenue DESC) AS double)
        / cast(sum(cast(total_revenue AS decimal(18,2))) OVER () AS double) AS cumulative_revenue_pct
    FROM s_dim_products p LEFT JOIN s_velocity v ON p.id = v.product_id""")
add_cte("s_inv2", """SELECT *, CASE WHEN stock = 0 THEN 'OUT_OF_STOCK' WHEN days_of_inventory < 7 THEN 'CRITICAL' WHEN days_of_inventory < 14 THEN 'LOW'
    WHEN days_of_inventory < 30 THEN 'MODERATE' ELSE 'HEALTHY' END AS stock_alert,
    CASE WHEN cumulative_revenue_pct <= 0.8 THEN 'A' WHEN cumulative_revenue_pct <= 0.95 THEN 'B' ELSE 'C' END AS abc_classification FROM s_inv1""")
add_cte("s_inventory", """SELECT *, stock_alert IN ('OUT_OF_STOCK', 'CRITICAL', 'LOW') OR stock < daily_velocity * 30 AS reorder_recommended,
    CASE WHEN stock_alert IN ('OUT_OF_STOCK', 'CRITICAL', 'LOW') OR stock < daily_velocity * 30
        THEN greatest(trunc(daily_velocity * 60 - stock)::int, 0) ELSE 0 END AS suggested_reorder_qty FROM s_inv2""")
add_cte("s_feat1", """SELECT *, avg(total_revenue) OVER w7 AS revenue_7d_avg, stddev_samp(total_revenue) OVER w7 AS revenue_7d_std,
    avg(total_revenue) OVER w30 AS revenue_30d_avg, avg(total_orders) OVER w7 AS orders_7d_avg, stddev_samp(total_orders) OVER w7 AS orders_7d_std,
    (total_revenue - lag(total_revenue) OVER w) / nullif(lag(total_revenue) OVER w, 0) * 100 AS revenue_change_pct
    FROM s_daily WINDOW w AS (ORDER BY created_at), w7 AS (ORDER BY created_at ROWS 6 PRECEDING), w30 AS (ORDER BY created_at ROWS 29 PRECEDING)""")
add_cte("s_feat2", """SELECT *, (total_revenue - revenue_7d_avg) / greatest(revenue_7d_std, 0.01) AS revenue_zscore,
    (total_orders - orders_7d_avg) / greatest(orders_7d_std, 0.01) AS orders_zscore FROM s_feat1""")
add_cte("s_features", """SELECT *, abs(revenue_zscore) > 2.5 AS is_revenue_anomaly, abs(orders_zscore) > 2.5 AS is_orders_anomaly,
    abs(revenue_zscore) > 2.5 OR abs(orders_zscore) > 2.5 AS is_any_anomaly FROM s_feat2""")
add_cte("s_recent", """SELECT product_id, sum(quantity)::bigint AS units, msum(quantity * unit_price) AS revenue FROM s_items_user
    WHERE created_at >= AS_OF - INTERVAL 30 DAY AND status IN ('Delivered', 'Shipped') GROUP BY 1""")
add_cte("s_recent_all", """SELECT product_id, sum(quantity)::bigint AS units, msum(quantity * unit_price) AS revenue FROM s_items_user
    WHERE created_at >= AS_OF - INTERVAL 30 DAY GROUP BY 1""")
