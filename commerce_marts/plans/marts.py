"""Curated marts, each one function from canonical or staging tables to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.money import growth_pct, pct
from ..functions.timeutil import AsOf, date_parts
from ..operators import customers, inventory, joins, metrics, ordered
from . import staging
from pyspark.sql import Window


def sales_daily_from(orders: DataFrame, rollup: DataFrame, fact_items: DataFrame) -> DataFrame:
    """Daily sales with profit, date parts and change against the day before (calendar rows only)."""
    daily = metrics.daily_sales(orders, rollup).join(metrics.daily_profit(fact_items), "created_at", "left")
    parts = {k: v for k, v in date_parts("created_at").items() if k != "day"}
    by_day = Window.orderBy("created_at")
    return daily.withColumns(parts).withColumns(
        {
            "revenue_vs_yesterday": F.round(growth_pct("total_revenue", F.lag("total_revenue").over(by_day)), 2),
            "orders_vs_yesterday": F.round(growth_pct("total_orders", F.lag("total_orders").over(by_day)), 2),
        }
    )


def sales_daily(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    return sales_daily_from(orders, metrics.order_item_rollup(items), staging.fact_order_items(items, products, orders))


def sales_weekly(orders: DataFrame) -> DataFrame:
    return ordered.add_growth(metrics.weekly_sales(orders), "total_revenue", "wow_revenue_growth", ["year", "week"])


def sales_monthly(orders: DataFrame) -> DataFrame:
    return ordered.add_growth(metrics.monthly_sales(orders), "total_revenue", "mom_revenue_growth", ["year", "month"])


def customer_360(dim_customers: DataFrame, orders: DataFrame, fact_items: DataFrame, as_of: AsOf) -> DataFrame:
    """Customer profile: RFM scores and segment, favourite category, churn score and band."""
    favourite = customers.favourite_category(joins.items_with_user(fact_items.select("order_id", "category", "quantity"), orders))
    rfm = customers.rfm_scores(orders, as_of)
    return customers.with_churn(joins.assemble_customer_360(dim_customers, rfm, favourite.drop("items_bought")))


def inventory_analytics(dim_products: DataFrame, fact_items: DataFrame) -> DataFrame:
    """Velocity, days of inventory, alert level, ABC class and reorder advice per product."""
    velocity = metrics.sales_velocity(fact_items).drop("total_sold", "selling_days")
    df = joins.join_metrics(dim_products, velocity, "product_id", {"daily_velocity": 0.0})
    return inventory.with_reorder(inventory.with_abc(inventory.with_days_of_inventory(df)))


def anomaly_features(daily: DataFrame, limit: float = 2.5) -> DataFrame:
    """Rolling statistics, z-scores and flags over the daily sales rows."""
    df = ordered.add_rolling(
        daily, "total_revenue", "created_at",
        {"revenue_7d_avg": ("avg", 7), "revenue_7d_std": ("std", 7), "revenue_30d_avg": ("avg", 30)},
    )
    df = ordered.add_rolling(df, "total_orders", "created_at", {"orders_7d_avg": ("avg", 7), "orders_7d_std": ("std", 7)})
    df = df.withColumns(
        {
            "revenue_zscore": ordered.zscore("total_revenue", "revenue_7d_avg", "revenue_7d_std"),
            "orders_zscore": ordered.zscore("total_orders", "orders_7d_avg", "orders_7d_std"),
        }
    ).withColumns(
        {
            "is_revenue_anomaly": F.abs("revenue_zscore") > limit,
            "is_orders_anomaly": F.abs("orders_zscore") > limit,
        }
    )
    df = df.withColumn("is_any_anomaly", F.col("is_revenue_anomaly") | F.col("is_orders_anomaly"))
    return ordered.add_pct_change(df, "total_revenue", "revenue_change_pct", ["created_at"])


def product_performance(products: DataFrame, fact_items: DataFrame) -> DataFrame:
    zero = {"units_sold": 0, "total_revenue": 0.0, "total_profit": 0.0, "orders_count": 0}
    df = joins.join_metrics(products, metrics.product_rollup(fact_items), "product_id", zero)
    margin = F.when(F.col("total_revenue") > 0, pct("total_profit", "total_revenue")).otherwise(0.0)
    return df.withColumn("profit_margin_pct", margin).withColumn("performance_tier", labels.performance_tier())


# --- reporting views over the marts --------------------------------------------------------

def v_sales_dashboard(daily: DataFrame, weekly: DataFrame) -> DataFrame:
    """Daily rows with the growth of their week, newest first."""
    monday = F.date_sub("created_at", F.weekday("created_at"))
    keyed = daily.withColumns({"_y": F.year(F.date_add(monday, 3)), "_w": F.col("week")})
    growth = weekly.select(F.col("year").alias("_y"), F.col("week").alias("_w"), "wow_revenue_growth")
    return keyed.join(growth, ["_y", "_w"], "left").select(
        "created_at", "total_orders", "total_revenue", "avg_order_value", "unique_customers", "cancellation_rate",
        "total_profit", "avg_profit_margin", "year", "month", "is_weekend", "wow_revenue_growth",
    ).orderBy(F.desc("created_at"))


def v_customer_analytics(c360: DataFrame) -> DataFrame:
    return c360.select(
        "id", "name", "email", "customer_segment", "rfm_score", "rfm_segment", "recency", "frequency", "monetary",
        "churn_risk_segment", "total_orders", "total_spent", "favorite_category",
        labels.segment_priority().alias("segment_priority"),
    )


def v_inventory_status(inv: DataFrame) -> DataFrame:
    return inv.select(
        "id", "sku", "name", "category", "stock", "stock_status", "total_sold", "days_of_inventory", "abc_classification",
        "reorder_recommended", "suggested_reorder_qty", "daily_velocity", "inventory_value",
        labels.stock_alert_priority().alias("stock_alert_priority"),
    )


def v_anomaly_alerts(features: DataFrame) -> DataFrame:
    rev, rz = F.col("is_revenue_anomaly"), F.col("revenue_zscore")
    num, oz = F.col("is_orders_anomaly"), F.col("orders_zscore")
    kind = (
        F.when(rev & (rz > 0), "Revenue Spike").when(rev & (rz < 0), "Revenue Drop")
        .when(num & (oz > 0), "Order Spike").when(num & (oz < 0), "Order Drop").otherwise("Normal")
    )
    worst = F.greatest(F.abs(rz), F.abs(oz))
    severity = F.when(worst > 3, "High").when(worst > 2, "Medium").otherwise("Low")
    return features.filter("is_any_anomaly").select(
        "created_at", "total_revenue", "total_orders", "revenue_zscore", "orders_zscore", "is_revenue_anomaly",
        "is_orders_anomaly", "revenue_change_pct", kind.alias("alert_type"), severity.alias("severity"),
    ).orderBy(F.desc("created_at"))
