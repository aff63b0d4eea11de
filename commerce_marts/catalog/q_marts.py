"""Staging tables, curated marts, reporting views and the aggregates they are made of."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import labels
from ..operators import customers, inventory, joins, metrics, ordered
from ..plans import marts, staging
from . import shared as s
from .registry import query


@query("A01_customer_metrics", "SELECT * FROM s_cust_metrics")
def _(t):
    return metrics.customer_metrics(t.orders)


@query("A02_product_sales", "SELECT * FROM s_product_sales")
def _(t):
    return metrics.product_sales(t.order_items)


@query("A03_order_item_rollup", """SELECT r.*, p.product_ids FROM s_rollup r JOIN (SELECT order_id,
    string_agg(product_id, ',' ORDER BY product_id) AS product_ids FROM r_items GROUP BY order_id) p ON r.order_id = p.order_id""")
def _(t):
    lists = metrics.order_product_lists(t.order_items)
    lists = lists.select("order_id", F.array_join(F.col("product_ids").cast("array<string>"), ",").alias("product_ids"))
    return metrics.order_item_rollup(t.order_items).join(lists, "order_id")


@query("A04_daily_sales", "SELECT * FROM s_daily_sales")
def _(t):
    return metrics.daily_sales(t.orders, metrics.order_item_rollup(t.order_items))


@query("A05_daily_profit", "SELECT * FROM s_daily_profit")
def _(t):
    return metrics.daily_profit(s.fact_items(t))


@query("A06_weekly_rollup", "SELECT * EXCLUDE (wow_revenue_growth) FROM s_weekly")
def _(t):
    return metrics.weekly_sales(t.orders)


@query("A07_monthly_rollup", "SELECT * EXCLUDE (mom_revenue_growth) FROM s_monthly")
def _(t):
    return metrics.monthly_sales(t.orders)


@query("A08_category_quantities", "SELECT * FROM s_cat_qty")
def _(t):
    return metrics.category_quantities(joins.items_with_user(s.fact_items(t), t.orders))


@query("A09_sales_velocity", "SELECT * FROM s_velocity")
def _(t):
    return metrics.sales_velocity(s.fact_items(t))


ROLLUP = """SELECT product_id, sum(quantity)::bigint AS units_sold, msum(line_revenue) AS total_revenue, psum(line_profit) AS total_profit,
    round(avg(unit_price), 6) AS avg_selling_price,
    count(DISTINCT order_id) AS orders_count, min(created_at) AS first_sale, max(created_at) AS last_sale
    FROM s_fact_items GROUP BY product_id"""


@query("A10_product_rollup", ROLLUP)
def _(t):
    return metrics.product_rollup(s.fact_items(t))


@query("D01_dim_customers", "SELECT * FROM s_dim_customers")
def _(t):
    return s.dim_customers(t)


@query("D03_dim_products", "SELECT * FROM s_dim_products")
def _(t):
    return s.dim_products(t)


@query("D04_fact_orders", "SELECT * FROM s_fact_orders")
def _(t):
    return staging.fact_orders(t.orders, t.order_items)


@query("D05_fact_order_items", "SELECT * EXCLUDE (id) FROM s_fact_items")
def _(t):
    return s.fact_items(t).drop("id")


@query("D06_fact_support_tickets", """SELECT *, CASE WHEN status IN ('Resolved', 'Closed')
    THEN datediff('day', created_at, resolved_at)::double END AS resolution_days,
    CASE priority WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS severity_score,
    sentiment = 'negative' AND status <> 'Closed' AS requires_followup FROM r_tickets""")
def _(t):
    return staging.fact_support_tickets(t.tickets)


@query("D07_sales_daily", "SELECT * FROM s_daily")
def _(t):
    return s.daily(t)


@query("D08_sales_weekly", "SELECT * FROM s_weekly")
def _(t):
    return marts.sales_weekly(t.orders)


@query("D09_sales_monthly", "SELECT * FROM s_monthly")
def _(t):
    return marts.sales_monthly(t.orders)


@query("D10_customer_360", "SELECT * FROM s_c360")
def _(t):
    return s.customer_360(t)


@query("D11_inventory_analytics", "SELECT * FROM s_inventory")
def _(t):
    return s.inventory(t)


FEATURES = "revenue_7d_avg revenue_7d_std revenue_30d_avg orders_7d_avg orders_7d_std revenue_zscore orders_zscore revenue_change_pct".split()


def rounded(df, cols, digits=4):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def rounded_sql(cols, digits=4):
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


@query("D12_anomaly_features", f"SELECT * REPLACE ({rounded_sql(FEATURES)}) FROM s_features")
def _(t):
    return rounded(s.anomaly_features(t), FEATURES)


@query("D13_product_performance", f"""WITH r AS ({ROLLUP}), p AS (SELECT p.*, coalesce(r.units_sold, 0)::bigint AS units_sold,
    coalesce(r.total_revenue, 0.0) AS total_revenue, coalesce(r.total_profit, 0.0) AS total_profit, coalesce(r.orders_count, 0) AS orders_count,
    r.avg_selling_price, r.first_sale, r.last_sale,
    CASE WHEN r.total_revenue > 0 THEN r.total_profit / r.total_revenue * 100 ELSE 0.0 END AS profit_margin_pct
    FROM r_products p LEFT JOIN r ON p.id = r.product_id)
    SELECT *, CASE WHEN total_revenue > 50000 AND profit_margin_pct > 30 THEN 'Star' WHEN total_revenue > 20000 AND profit_margin_pct > 20 THEN 'Strong'
    WHEN total_revenue > 5000 THEN 'Average' WHEN units_sold > 0 THEN 'Weak' ELSE 'No Sales' END AS performance_tier FROM p""")
def _(t):
    return marts.product_performance(t.products, s.fact_items(t))


@query("D14_orders_nested", """SELECT o.id, o.order_number, count(i.order_id) AS n_items,
    coalesce(string_agg(i.product_id || 'x' || i.quantity, ',' ORDER BY i.product_id, i.quantity), '') AS items
    FROM r_orders o LEFT JOIN r_items i ON o.id = i.order_id GROUP BY o.id, o.order_number""")
def _(t):
    nested = metrics.orders_nested(t.orders, t.order_items)
    tag = F.transform("items", lambda x: F.concat(x["product_id"].cast("string"), F.lit("x"), x["quantity"].cast("string")))
    return nested.select("id", "order_number", F.size("items").cast("bigint").alias("n_items"), F.array_join(tag, ",").alias("items"))


@query("D15_simple_fact_orders", """SELECT o.*, coalesce(r.total_items, 0)::bigint AS total_items, coalesce(r.distinct_products, 0) AS distinct_products,
    coalesce(p.order_profit, 0.0) AS order_profit, year(created_at) AS order_year, month(created_at) AS order_month,
    dayofweek(created_at) IN (0, 6) AS is_weekend FROM r_orders o LEFT JOIN s_rollup r ON o.id = r.order_id
    LEFT JOIN (SELECT order_id, round(psum(quantity * unit_price * 0.4::double), 2) AS order_profit FROM r_items GROUP BY 1) p ON o.id = p.order_id""")
def _(t):
    return staging.simple_fact_orders(t.orders, t.order_items)


@query("D15_nested_fact_orders", """SELECT o.id, coalesce(r.total_items, 0)::bigint AS total_items, coalesce(r.distinct_products, 0) AS distinct_products,
    coalesce(p.order_profit, 0.0) AS order_profit FROM r_orders o LEFT JOIN s_rollup r ON o.id = r.order_id
    LEFT JOIN (SELECT order_id, psum(quantity * unit_price * 0.4::double) AS order_profit FROM r_items GROUP BY 1) p ON o.id = p.order_id""")
def _(t):
    return staging.nested_fact_orders(metrics.orders_nested(t.orders.select("id"), t.order_items))


@query("F18_v_sales_dashboard", """SELECT d.created_at, d.total_orders, d.total_revenue, d.avg_order_value, d.unique_customers, d.cancellation_rate,
    d.total_profit, d.avg_profit_margin, d.year, d.month, d.is_weekend, w.wow_revenue_growth
    FROM s_daily d LEFT JOIN s_weekly w ON isoyear(d.created_at) = w.year AND d.week = w.week""")
def _(t):
    return marts.v_sales_dashboard(s.daily(t), marts.sales_weekly(t.orders))


@query("F19_v_customer_analytics", """SELECT id, name, email, customer_segment, rfm_score, rfm_segment, recency, frequency, monetary,
    churn_risk_segment, total_orders, total_spent, favorite_category, CASE rfm_segment WHEN 'Champions' THEN 1 WHEN 'Loyal Customers' THEN 2
    WHEN 'Potential Loyalists' THEN 3 WHEN 'New Customers' THEN 4 WHEN 'At Risk' THEN 5 ELSE 6 END AS segment_priority FROM s_c360""")
def _(t):
    return marts.v_customer_analytics(s.customer_360(t))


@query("F20_v_inventory_status", """SELECT id, sku, name, category, stock, stock_status, total_sold, days_of_inventory, abc_classification,
    reorder_recommended, suggested_reorder_qty, daily_velocity, inventory_value, CASE stock_alert WHEN 'OUT_OF_STOCK' THEN 1 WHEN 'CRITICAL' THEN 2
    WHEN 'LOW' THEN 3 WHEN 'MODERATE' THEN 4 ELSE 5 END AS stock_alert_priority FROM s_inventory""")
def _(t):
    return marts.v_inventory_status(s.inventory(t))


@query("F21_v_anomaly_alerts", """SELECT created_at, total_revenue, total_orders, round(revenue_zscore, 4) AS revenue_zscore,
    round(orders_zscore, 4) AS orders_zscore, is_revenue_anomaly, is_orders_anomaly, round(revenue_change_pct, 4) AS revenue_change_pct,
    CASE WHEN is_revenue_anomaly AND revenue_zscore > 0 THEN 'Revenue Spike' WHEN is_revenue_anomaly AND revenue_zscore < 0 THEN 'Revenue Drop'
        WHEN is_orders_anomaly AND orders_zscore > 0 THEN 'Order Spike' WHEN is_orders_anomaly AND orders_zscore < 0 THEN 'Order Drop' ELSE 'Normal' END AS alert_type,
    CASE WHEN abs(revenue_zscore) > 3 OR abs(orders_zscore) > 3 THEN 'High' WHEN abs(revenue_zscore) > 2 OR abs(orders_zscore) > 2 THEN 'Medium' ELSE 'Low' END AS severity
    FROM s_features WHERE is_any_anomaly""")
def _(t):
    return rounded(marts.v_anomaly_alerts(s.anomaly_features(t).filter("is_any_anomaly")), ["revenue_zscore", "orders_zscore", "revenue_change_pct"])


LOW = "(abs(revenue_zscore) > 2 OR abs(orders_zscore) > 2)"


@query("F21_v_anomaly_alerts_limit_2", f"""SELECT created_at, CASE WHEN abs(revenue_zscore) > 2 AND revenue_zscore > 0 THEN 'Revenue Spike'
    WHEN abs(revenue_zscore) > 2 THEN 'Revenue Drop' WHEN orders_zscore > 0 THEN 'Order Spike' ELSE 'Order Drop' END AS alert_type,
    CASE WHEN abs(revenue_zscore) > 3 OR abs(orders_zscore) > 3 THEN 'High' ELSE 'Medium' END AS severity FROM s_features WHERE {LOW}""")
def _(t):
    return marts.v_anomaly_alerts(marts.anomaly_features(s.daily(t), 2.0)).select("created_at", "alert_type", "severity")


@query("C01_rfm_scores", "SELECT user_id, frequency, monetary, recency, r_score, f_score, m_score FROM s_rfm_scored")
def _(t):
    return customers.rfm_scores(t.orders, t.as_of).drop("rfm_score", "rfm_segment")


@query("C02_rfm_segment", "SELECT rfm_segment, rfm_score, count(*) AS customers FROM s_rfm GROUP BY 1, 2")
def _(t):
    return customers.rfm_scores(t.orders, t.as_of).groupBy("rfm_segment", "rfm_score").agg(F.count(F.lit(1)).alias("customers"))


@query("C03_churn_risk", "SELECT id, recency, rfm_segment, churn_risk_score, churn_risk_segment FROM s_c360")
def _(t):
    rfm = customers.rfm_scores(t.orders, t.as_of).withColumnRenamed("user_id", "id")
    return customers.with_churn(t.users.select("id").join(rfm.select("id", "recency", "rfm_segment"), "id", "left"))


@query("C04_favourite_category", "SELECT * FROM s_favourite")
def _(t):
    return customers.favourite_category(joins.items_with_user(s.fact_items(t), t.orders))


@query("I01_stock_alerts", "SELECT id, stock, daily_velocity, days_of_inventory, stock_alert FROM s_inv2")
def _(t):
    velocity = metrics.sales_velocity(s.fact_items(t)).select("product_id", "daily_velocity")
    df = joins.join_metrics(t.products.select("id", "stock"), velocity, "product_id", {"daily_velocity": 0.0})
    return inventory.with_days_of_inventory(df)


@query("I02_abc_class", "SELECT id, total_revenue, cumulative_revenue_pct, abc_classification FROM s_inv2")
def _(t):
    return inventory.with_abc(s.dim_products(t).select("id", "total_revenue"))


@query("I03_reorder", "SELECT id, stock_alert, reorder_recommended, suggested_reorder_qty FROM s_inventory")
def _(t):
    return s.inventory(t).select("id", "stock_alert", "reorder_recommended", "suggested_reorder_qty")


@query("W01_wow_growth", "SELECT year, week, total_revenue, wow_revenue_growth FROM s_weekly")
def _(t):
    return marts.sales_weekly(t.orders).select("year", "week", "total_revenue", "wow_revenue_growth")


@query("W02_mom_growth", "SELECT year, month, total_revenue, mom_revenue_growth FROM s_monthly")
def _(t):
    return marts.sales_monthly(t.orders).select("year", "month", "total_revenue", "mom_revenue_growth")


@query("W03_top1_category", "SELECT user_id, category FROM s_favourite")
def _(t):
    bought = joins.items_with_user(s.fact_items(t), t.orders)
    ranked = ordered.top_n(metrics.category_quantities(bought), ["user_id"], [F.desc("items_bought"), F.asc("category")], 1)
    return ranked.select("user_id", "category")


@query("W04_running_share", """SELECT product_id, total_revenue, cast(sum(cast(total_revenue AS decimal(18,2))) OVER (ORDER BY total_revenue DESC) AS double)
    / cast(sum(cast(total_revenue AS decimal(18,2))) OVER () AS double) AS share FROM s_product_sales""")
def _(t):
    return ordered.running_share(metrics.product_sales(t.order_items).select("product_id", "total_revenue"), "total_revenue", "share")


@query("W05_grand_total", """SELECT product_id, total_revenue, cast(sum(cast(total_revenue AS decimal(18,2))) OVER () AS double) AS grand_total
    FROM s_product_sales""")
def _(t):
    sales = metrics.product_sales(t.order_items).select("product_id", "total_revenue")
    total = sales.agg(metrics.money_sum("total_revenue").alias("g")).scalar()
    return sales.withColumn("grand_total", total)


@query("W06_rolling", f"""SELECT created_at, {rounded_sql(FEATURES[:3])} FROM s_features""")
def _(t):
    daily = t.orders.groupBy(F.col("created_at").cast("date").alias("created_at")).agg(metrics.money_sum("total_amount").alias("total_revenue"))
    sizes = {"revenue_7d_avg": ("avg", 7), "revenue_7d_std": ("std", 7), "revenue_30d_avg": ("avg", 30)}
    return rounded(ordered.add_rolling(daily, "total_revenue", "created_at", sizes), FEATURES[:3]).drop("total_revenue")


@query("W07_zscores", """SELECT created_at, round(revenue_zscore, 4) AS revenue_zscore, round(orders_zscore, 4) AS orders_zscore,
    is_revenue_anomaly, is_orders_anomaly, is_any_anomaly FROM s_features""")
def _(t):
    cols = ["created_at", "revenue_zscore", "orders_zscore", "is_revenue_anomaly", "is_orders_anomaly", "is_any_anomaly"]
    return rounded(s.anomaly_features(t).select(*cols), ["revenue_zscore", "orders_zscore"])


@query("W08_day_over_day", "SELECT created_at, total_revenue, round(revenue_change_pct, 4) AS revenue_change_pct FROM s_features")
def _(t):
    daily = t.orders.groupBy(F.col("created_at").cast("date").alias("created_at")).agg(metrics.money_sum("total_amount").alias("total_revenue"))
    return rounded(ordered.add_pct_change(daily, "total_revenue", "revenue_change_pct", ["created_at"]), ["revenue_change_pct"])


@query("F06_customer_tier", "SELECT customer_segment, count(*) AS customers, msum(total_spent) AS spend FROM s_dim_customers GROUP BY 1")
def _(t):
    tier = s.dim_customers(t).select("total_spent", labels.customer_tier().alias("customer_segment"))
    return tier.groupBy("customer_segment").agg(F.count(F.lit(1)).alias("customers"), metrics.money_sum("total_spent").alias("spend"))


@query("F07_stock_and_sales_bands", "SELECT stock_status, product_performance, count(*) AS products FROM s_dim_products GROUP BY 1, 2")
def _(t):
    return s.dim_products(t).groupBy("stock_status", "product_performance").agg(F.count(F.lit(1)).alias("products"))


@query("F08_sla_days", "SELECT status, expected_delivery_days, count(*) AS orders FROM s_fact_orders GROUP BY 1, 2")
def _(t):
    return t.orders.groupBy("status", labels.sla_days().alias("expected_delivery_days")).agg(F.count(F.lit(1)).alias("orders"))


@query("F09_ticket_flags", """SELECT id, priority, CASE priority WHEN 'Critical' THEN 4 WHEN 'High' THEN 3 WHEN 'Medium' THEN 2 ELSE 1 END AS severity_score,
    sentiment = 'negative' AND status <> 'Closed' AS requires_followup FROM r_tickets""")
def _(t):
    return t.tickets.select("id", "priority", labels.severity_score().alias("severity_score"), labels.requires_followup().alias("requires_followup"))


@query("F10_null_defaults", "SELECT id, total_orders, total_spent, avg_order_value FROM s_dim_customers")
def _(t):
    zero = {"total_orders": 0, "total_spent": 0.0, "avg_order_value": 0.0}
    return joins.join_metrics(t.users.select("id"), metrics.customer_metrics(t.orders), "user_id", zero).drop("last_order_date")
