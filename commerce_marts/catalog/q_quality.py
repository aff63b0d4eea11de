"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics, quality
from ..operators.quality import Check
from ..plans import staging
from . import shared as s
from .registry import add_cte, query

SQL_TABLES = {
    "dim_customers": "s_dim_customers", "dim_products": "s_dim_products", "fact_orders": "s_fact_orders", "fact_order_items": "s_fact_items",
    "sales_daily": "s_daily", "customer_360": "s_c360", "inventory_analytics": "s_inventory", "r_orders": "r_orders", "r_items": "r_items",
    "activities": "r_activities", "cart_items": "r_cart", "products": "r_products",
}


def check_sql(c):
    table = SQL_TABLES[c.table]
    if c.kind == "completeness":
        pct = quality._number(c.low * 100)
        return f"""SELECT '{c.table}' AS table_name, '{c.column}_completeness' AS check_name, 'completeness' AS check_type, n / t >= {c.low} AS passed, '>={pct}%' AS expected_value,
            printf('%.2f%%', n / t * 100) AS actual_value, 'high' AS sev, n || '/' || t || ' non-null values' AS details FROM (SELECT count({c.column}) AS n, count(*) AS t FROM {table})"""
    if c.kind == "uniqueness":
        return f"""SELECT '{c.table}', '{c.column}_uniqueness', 'uniqueness', n = t, t || ' distinct', n || ' distinct', 'critical',
            CASE WHEN n = t THEN 'All unique' ELSE (t - n) || ' duplicates found' END FROM (SELECT count(DISTINCT {c.column}) AS n, count(*) AS t FROM {table})"""
    if c.kind == "range":
        return f"""SELECT '{c.table}', '{c.column}_range', 'range', n = 0, '[{quality._number(c.low)}, {quality._number(c.high)}]', n || ' out of range', 'high', NULL
            FROM (SELECT count(*) FILTER ({c.column} < {c.low} OR {c.column} > {c.high}) AS n FROM {table})"""
    if c.kind == "freshness":
        return f"""SELECT '{c.table}', '{c.column}_freshness', 'freshness', h <= {c.high}, '<={quality._number(c.high)}h', printf('%.1fh delay', h), 'medium', NULL
            FROM (SELECT floor(epoch(AS_OF - max({c.column}))) / 3600 AS h FROM {table})"""
    return f"""SELECT '{c.table}', 'fk_{c.column}_integrity', 'referential_integrity', n = 0, '0 orphans', n || ' orphans', 'critical',
        'Foreign key {c.column} references {c.parent}.{c.parent_column}' FROM (SELECT count(DISTINCT {c.column}) AS n FROM {table}
        WHERE {c.column} NOT IN (SELECT {c.parent_column} FROM {SQL_TABLES[c.parent]}))"""


def log_sql(checks):
    first = [c for c in checks if c.kind == "completeness"]
    ordered = first + [c for c in checks if c.kind != "completeness"]
    head = "SELECT '' AS table_name, '' AS check_name, '' AS check_type, true AS passed, '' AS expected_value, '' AS actual_value, '' AS sev, '' AS details WHERE false"
    arms = " UNION ALL ".join([head] + [check_sql(c) for c in ordered])
    return f"SELECT * EXCLUDE (sev), CASE WHEN passed THEN 'low' ELSE sev END AS severity FROM ({arms})"


add_cte("s_log", log_sql(quality.SUITE))


def tables(t):
    return {
        "dim_customers": s.dim_customers(t), "dim_products": s.dim_products(t), "fact_orders": staging.fact_orders(t.orders, t.order_items),
        "fact_order_items": s.fact_items(t), "sales_daily": s.daily(t), "customer_360": s.customer_360(t), "inventory_analytics": s.inventory(t),
    }


COMPLETE = [Check("dim_customers", "completeness", "email", 1.0), Check("dim_customers", "completeness", "last_order_date", 0.5), Check("fact_orders", "completeness", "total_items", 0.99)]
UNIQUE = [Check("dim_customers", "uniqueness", "email"), Check("fact_order_items", "uniqueness", "id"), Check("fact_orders", "uniqueness", "order_number")]
RANGE = [Check("dim_products", "range", "stock", 0, 50), Check("fact_order_items", "range", "quantity", 1, 1000), Check("fact_orders", "range", "total_amount", 2000, 400000)]
REFERENCE = [
    Check("fact_orders", "reference", "user_id", parent="dim_customers", parent_column="id"),
    Check("cart_items", "reference", "product_id", parent="products", parent_column="id"),
    Check("fact_orders", "reference", "id", parent="fact_order_items", parent_column="order_id"),
]
FRESH = [Check("fact_orders", "freshness", "created_at", high=24), Check("dim_products", "freshness", "created_at", high=24)]


def few(t):
    return {
        "dim_customers": s.dim_customers(t), "dim_products": s.dim_products(t), "fact_orders": staging.fact_orders(t.orders, t.order_items),
        "fact_order_items": t.order_items, "cart_items": t.cart_items, "products": t.products,
    }


@query("Q01_completeness", log_sql(COMPLETE))
def _(t):
    return quality.run_suite(few(t), COMPLETE)


@query("Q02_uniqueness", log_sql(UNIQUE))
def _(t):
    return quality.run_suite(few(t), UNIQUE)


@query("Q03_range", log_sql(RANGE))
def _(t):
    return quality.run_suite(few(t), RANGE)


@query("Q04_referential_integrity", log_sql(REFERENCE))
def _(t):
    return quality.run_suite(few(t), REFERENCE)


@query("Q05_freshness", log_sql(FRESH))
def _(t):
    return quality.run_suite(few(t), FRESH, t.as_of)


@query("Q06_staging_checks", """SELECT 'Duplicate Orders' AS check_name, n = 0 AS passed, 'Found ' || n || ' duplicates' AS message FROM
    (SELECT count(*) AS n FROM (SELECT order_number FROM r_orders GROUP BY 1 HAVING count(*) > 1)) UNION ALL
    SELECT 'Orders with Items', n > 0, n || '/' || t || ' orders have items' FROM (SELECT (SELECT count(DISTINCT order_id) FROM r_items) AS n, (SELECT count(*) FROM r_orders) AS t) UNION ALL
    SELECT 'No Negative Amounts', n = 0, 'Found ' || n || ' negative amounts' FROM (SELECT count(*) AS n FROM r_orders WHERE total_amount < 0) UNION ALL
    SELECT 'Customer Segments', n = 0, n || ' customers without segment' FROM (SELECT count(*) AS n FROM s_dim_customers WHERE customer_segment IS NULL) UNION ALL
    SELECT 'Product Categories', n = 0, n || ' products without category' FROM (SELECT count(*) AS n FROM r_products WHERE category IS NULL)""")
def _(t):
    return quality.staging_checks(staging.fact_orders(t.orders, t.order_items), t.order_items, s.dim_customers(t), s.dim_products(t))


@query("Q07_check_suite", "SELECT * FROM s_log")
def _(t):
    return quality.run_suite(tables(t))


@query("Q08_quality_score", """SELECT *, CASE WHEN quality_score >= 95 AND critical_failures = 0 THEN 'PASS' WHEN quality_score >= 90 THEN 'WARNING' ELSE 'FAIL' END AS status
    FROM (SELECT count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (NOT passed) AS failed_checks,
    count(*) FILTER (NOT passed AND severity = 'critical') AS critical_failures, round(count(*) FILTER (passed) / count(*) * 100, 2) AS quality_score FROM s_log)""")
def _(t):
    return quality.quality_score(quality.run_suite(tables(t)))


@query("A38_quality_by_table", """SELECT table_name, count(*) AS total_checks, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
    count(*) FILTER (NOT passed AND severity = 'critical') AS critical_failures, round(count(*) FILTER (passed) / count(*) * 100, 2) AS pass_rate
    FROM s_log GROUP BY ROLLUP (table_name)""")
def _(t):
    return quality.table_summary(quality.run_suite(tables(t)))


add_cte("s_few_log", log_sql(RANGE + REFERENCE))


@query("N14_quality_alerts", """SELECT table_name, check_name, severity, actual_value, '• ' || table_name || '.' || check_name || ': ' || actual_value || ' (' || severity || ')' AS alert
    FROM s_few_log WHERE NOT passed AND severity IN ('critical', 'high')""")
def _(t):
    return quality.quality_alerts(quality.run_suite(few(t), RANGE + REFERENCE))


@query("Q09_curated_report", """WITH c AS (SELECT (SELECT bool_and(total_revenue > 0) FROM s_daily) AS a, (SELECT bool_and(coalesce(rfm_segment, '') <> '') FROM s_c360) AS b,
    (SELECT bool_and(coalesce(stock_status, '') <> '') FROM s_inventory) AS c), p AS (SELECT a::int + b::int + c::int AS passed_checks FROM c)
    SELECT 3 AS total_checks, passed_checks, 3 - passed_checks AS failed_checks, round(passed_checks / 3 * 100, 2) AS quality_score,
    CASE WHEN passed_checks = 3 THEN 'PASS' ELSE 'FAIL' END AS status FROM p""")
def _(t):
    return quality.curated_report(s.daily(t), s.customer_360(t), s.inventory(t))


@query("Q10_file_report", """WITH p AS (SELECT bool_and(revenue >= 0)::int + bool_and(orders >= 0)::int + bool_and(date IS NOT NULL)::int AS passed_checks FROM s_series)
    SELECT 3 AS total_checks, passed_checks, 3 - passed_checks AS failed_checks, round(passed_checks / 3 * 100, 2) AS quality_score,
    CASE WHEN passed_checks = 3 THEN 'PASS' ELSE 'FAIL' END AS status FROM p""")
def _(t):
    return quality.file_report(metrics.sales_series(t.orders, t.as_of, None))


@query("Q11_gate", """SELECT CASE WHEN s >= 90 THEN 'continue' ELSE 'stop' END AS decision, s AS quality_score FROM
    (SELECT round(count(*) FILTER (passed) / count(*) * 100, 2) AS s FROM s_few_log)""")
def _(t):
    score = quality.quality_score(quality.run_suite(few(t), RANGE + REFERENCE))
    return score.select(F.when(F.col("status") == "FAIL", "stop").otherwise("continue").alias("decision"), "quality_score")


@query("Q12_sufficiency", """SELECT product_id, count(*) AS points, bool_or(quantity <> 0) AS any_value, count(*) >= 7 AS seasonal_ok, count(*) >= 7 AS autoregressive_ok,
    count(*) >= 14 AS sequence_ok FROM (SELECT created_at::date AS date, product_id, sum(quantity) AS quantity FROM s_items_user
    WHERE status IN ('Delivered', 'Shipped') GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    series = metrics.product_series(t.orders, t.order_items, t.as_of, None)
    return quality.sufficiency(series, ["product_id"], "quantity")
