"""Flat datasets for reporting tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import money_sum, ratio
from ..functions.timeutil import AsOf, ago, as_of_ts, calendar, day, is_weekend, since
from ..operators import customers, joins, metrics

SCHEMA_VERSION = "1.0"


def export_sales(orders: DataFrame, items: DataFrame, products: DataFrame, as_of: AsOf, days: int | None = 90) -> DataFrame:
    """One row per order line with order and product data; category 'Unknown' when missing."""
    kept = orders if days is None else orders.filter(since("created_at", as_of, days=days))
    head = kept.select(
        F.col("id").alias("order_id"), "order_number", F.col("created_at").alias("order_date"), F.col("user_id").alias("customer_id"),
        "customer_name", F.col("total_amount").alias("order_total"), "status", "payment_method", "city", "state",
    )
    lines = items.select("order_id", "product_id", "product_name", "quantity", "unit_price")
    goods = products.select(F.col("id").alias("product_id"), "category")
    return (
        lines.join(head, "order_id").join(goods, "product_id", "left")
        .withColumns({"category": F.coalesce("category", F.lit("Unknown")), "total_amount": metrics.line_value()})
    )


def export_customers(users: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """One row per customer with totals, last order and favourite category ('N/A' when none)."""
    typed = items.select("order_id", "product_id", "quantity").join(products.select(F.col("id").alias("product_id"), "category"), "product_id")
    best = customers.favourite_category(joins.items_with_user(typed, orders)).select(
        F.col("user_id").alias("id"), F.col("category").alias("favorite_category")
    )
    zero = {"total_orders": 0, "total_spent": 0.0, "avg_order_value": 0.0}
    df = joins.join_metrics(users, metrics.customer_metrics(orders), "user_id", zero).join(best, "id", "left")
    return df.select(
        F.col("id").alias("customer_id"), "name", "email", "phone", F.col("created_at").alias("registration_date"), "total_orders", "total_spent",
        F.round("avg_order_value", 2).alias("average_order_value"), "last_order_date",
        F.coalesce("favorite_category", F.lit("N/A")).alias("favorite_category"), "is_admin",
    )


def export_inventory(products: DataFrame, orders: DataFrame, items: DataFrame, as_of: AsOf) -> DataFrame:
    """Stock with 30-day units, velocity, days left (999 without sales) and a stock band."""
    recent = metrics.recent_units(orders, items, as_of, 30, None).select(F.col("product_id").alias("id"), F.col("units").alias("units_sold_30d"))
    total = metrics.product_sales(items).select(F.col("product_id").alias("id"), "total_revenue")
    df = products.join(recent, "id", "left").join(total, "id", "left")
    units = F.coalesce("units_sold_30d", F.lit(0))
    return df.select(
        F.col("id").alias("product_id"), "sku", "name", "category", "description", "price", F.col("stock").alias("current_stock"),
        units.alias("units_sold_30d"), F.round(units / 30, 2).alias("daily_velocity"),
        F.coalesce(F.round(ratio(F.col("stock") * 30, units), 1), F.lit(999.0)).alias("days_of_inventory"),
        F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue"),
        F.when(F.col("stock") < 10, "Low").when(F.col("stock") < 50, "Medium").otherwise("High").alias("stock_status"), "created_at",
    )


def export_tickets(tickets: DataFrame, as_of: AsOf, days: int = 90) -> DataFrame:
    return tickets.filter(since("created_at", as_of, days=days)).select(
        F.col("id").alias("ticket_id"), "ticket_number", "created_at", "customer_email", "subject", "issue", "status", "priority", "source", "sentiment", "order_number"
    )


def daily_metrics(orders: DataFrame, users: DataFrame, tickets: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """Dense calendar of the last days with revenue, orders, new customers, tickets and weekday."""
    start = ago(as_of, days=days)

    def per_day(df, *aggs):
        return df.filter(F.col("created_at") >= start.cast("date")).groupBy(day("created_at").alias("date")).agg(*aggs)

    out = calendar(orders.sparkSession, start, days)
    out = out.join(per_day(orders, money_sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders_count")), "date", "left")
    out = out.join(per_day(users, F.count(F.lit(1)).alias("new_customers")), "date", "left")
    out = out.join(per_day(tickets, F.count(F.lit(1)).alias("support_tickets")), "date", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("orders_count", "new_customers", "support_tickets")}
    return out.withColumns({**zero, "revenue": F.coalesce("revenue", F.lit(0.0))}).withColumns(
        {
            "average_order_value": F.coalesce(F.round(ratio("revenue", "orders_count"), 2), F.lit(0.0)),
            "day_of_week": F.date_format("date", "EEEE"),
            "is_weekend": is_weekend("date"),
        }
    )


def dataflows(sales_daily: DataFrame, c360: DataFrame, inventory: DataFrame, as_of: AsOf) -> dict[str, DataFrame]:
    """Published flows: 90 days of daily sales, all customers, products to reorder."""
    first = F.date_sub(as_of_ts(as_of).cast("date"), 90)
    return {
        "sales": sales_daily.filter(F.col("created_at") >= first),
        "customers": c360,
        "inventory": inventory.filter("reorder_recommended"),
    }


def all_exports(users, products, orders, items, tickets, as_of: AsOf) -> dict[str, DataFrame]:
    """Every export dataset, each stamped with the schema version."""
    frames = {
        "sales_data": export_sales(orders, items, products, as_of),
        "customer_data": export_customers(users, orders, items, products),
        "inventory_data": export_inventory(products, orders, items, as_of),
        "support_tickets": export_tickets(tickets, as_of),
        "daily_metrics": daily_metrics(orders, users, tickets, as_of),
    }
    return {name: df.withColumn("schema_version", F.lit(SCHEMA_VERSION)) for name, df in frames.items()}


def write_exports(frames: dict[str, DataFrame], root: str) -> None:
    """Store a bundle, one folder for each dataset."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")
