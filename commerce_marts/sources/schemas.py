"""Declared schemas of the lake layers and the cast that enforces them on every write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

META = "_ingestion_timestamp timestamp, _execution_date string"
MONEY = "decimal(18,2)"

# Columns of the raw layer.
RAW = {
    "users": f"id bigint, name string, email string, phone string, is_admin boolean, created_at date, {META}",
    "products": f"id bigint, sku string, name string, category string, description string, price {MONEY}, stock int, sizes string, created_at date, {META}",
    "orders": "id bigint, order_number string, user_id bigint, customer_name string, phone string, address string, city string, state string, "
    f"pincode string, status string, tracking_id string, total_amount {MONEY}, payment_method string, payment_status string, return_status string, created_at date, {META}",
    "order_items": f"id bigint, order_id bigint, product_id bigint, product_name string, size string, quantity int, unit_price {MONEY}, {META}",
    "support_tickets": "id bigint, ticket_number string, customer_email string, subject string, issue string, order_number string, status string, "
    f"priority string, source string, sentiment string, created_at date, {META}",
}
# Columns of the staging layer.
STAGING = {
    "dim_customers": f"id bigint, name string, email string, phone string, is_admin boolean, created_at date, total_orders bigint, total_spent {MONEY}, "
    f"avg_order_value {MONEY}, last_order_date date, customer_segment string, effective_date date, expiration_date date, is_current boolean",
    "dim_products": f"id bigint, sku string, name string, category string, description string, price {MONEY}, stock int, sizes string, created_at date, "
    f"total_sold bigint, total_revenue {MONEY}, inventory_value {MONEY}, stock_status string, product_performance string",
    "fact_orders": f"id bigint, order_number string, user_id bigint, customer_name string, status string, total_amount {MONEY}, payment_method string, "
    "created_at date, total_items bigint, distinct_products bigint, order_year int, order_month int, order_day int, order_weekday int, "
    "order_quarter int, is_weekend boolean, expected_delivery_days int",
    "fact_order_items": f"id bigint, order_id bigint, product_id bigint, product_name string, category string, size string, quantity int, unit_price {MONEY}, "
    f"unit_cost {MONEY}, line_revenue {MONEY}, line_cost {MONEY}, line_profit {MONEY}, profit_margin decimal(5,2), created_at date, order_status string",
    "fact_support_tickets": "id bigint, ticket_number string, customer_email string, subject string, status string, priority string, source string, "
    "sentiment string, created_at date, resolution_days double, severity_score int, requires_followup boolean",
}
# Columns of the curated layer.
CURATED = {
    "sales_daily": f"created_at date, total_orders bigint, total_revenue {MONEY}, avg_order_value {MONEY}, total_items bigint, unique_customers bigint, "
    f"delivered_orders bigint, cancelled_orders bigint, cancellation_rate decimal(5,2), item_revenue {MONEY}, total_profit {MONEY}, "
    "avg_profit_margin decimal(5,2), year int, month int, week int, weekday int, is_weekend boolean, quarter int, revenue_vs_yesterday double, orders_vs_yesterday double",
    "sales_weekly": f"year int, week int, year_week string, total_orders bigint, total_revenue {MONEY}, avg_order_value {MONEY}, week_start date, "
    "week_end date, unique_customers bigint, wow_revenue_growth double",
    "sales_monthly": f"year int, month int, year_month string, total_orders bigint, total_revenue {MONEY}, avg_order_value {MONEY}, unique_customers bigint, "
    "month_start date, month_end date, mom_revenue_growth double",
    "customer_360": f"id bigint, name string, email string, phone string, is_admin boolean, created_at date, total_orders bigint, total_spent {MONEY}, "
    f"avg_order_value {MONEY}, last_order_date date, customer_segment string, favorite_category string, recency int, frequency bigint, monetary {MONEY}, "
    "r_score int, f_score int, m_score int, rfm_score string, rfm_segment string, churn_risk_score double, churn_risk_segment string",
    "inventory_analytics": f"id bigint, sku string, name string, category string, price {MONEY}, stock int, total_sold bigint, total_revenue {MONEY}, "
    f"inventory_value {MONEY}, stock_status string, product_performance string, daily_velocity double, days_of_inventory double, stock_alert string, "
    "last_sold_date date, cumulative_revenue_pct double, abc_classification string, reorder_recommended boolean, suggested_reorder_qty int",
    "anomaly_features": f"created_at date, total_orders bigint, total_revenue {MONEY}, avg_order_value {MONEY}, total_items bigint, unique_customers bigint, "
    "cancellation_rate decimal(5,2), revenue_7d_avg double, revenue_7d_std double, revenue_30d_avg double, orders_7d_avg double, orders_7d_std double, "
    "revenue_zscore double, orders_zscore double, is_revenue_anomaly boolean, is_orders_anomaly boolean, is_any_anomaly boolean, revenue_change_pct double, "
    "year int, month int, week int, weekday int, is_weekend boolean, quarter int",
    "product_performance": f"id bigint, sku string, name string, category string, price {MONEY}, stock int, units_sold bigint, total_revenue {MONEY}, "
    f"total_profit {MONEY}, avg_selling_price {MONEY}, orders_count bigint, first_sale date, last_sale date, profit_margin_pct decimal(5,2), performance_tier string",
}
# Partition columns of each table on disk: few values, or calendar months (``_month``, see MONTHLY).
MONTHLY = {"users": "created_at", "orders": "created_at", "support_tickets": "created_at"}
PARTITIONS = {
    "users": ["_month"], "products": ["category"], "orders": ["_month"], "order_items": [], "support_tickets": ["_month"],
    "dim_customers": ["customer_segment"], "dim_products": ["category"], "fact_orders": ["order_year", "order_month"], "fact_order_items": [],
    "fact_support_tickets": [], "sales_daily": ["year"], "sales_weekly": [], "sales_monthly": [], "customer_360": ["rfm_segment", "churn_risk_segment"],
    "inventory_analytics": ["category"], "anomaly_features": ["year"], "product_performance": ["category", "performance_tier"],
}
LAYERS = {"raw": RAW, "staging": STAGING, "curated": CURATED}


def schema_of(layer: str, table: str) -> T.StructType:
    return T.StructType.fromDDL(LAYERS[layer][table])


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of the schema in its order, cast to its types. A missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def evolve(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add columns the frame lacks as typed NULLs; a changed type is an error."""
    have = {f.name: f.dataType for f in df.schema}
    changed = [f.name for f in schema if f.name in have and have[f.name] != f.dataType]
    if changed:
        raise TypeError(f"type of columns differs: {', '.join(changed)}")
    return df.select(*[F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
