"""Staging tables: conformed dimensions and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import labels
from ..functions.money import MILLS, money_sum, pct
from ..functions.timeutil import AsOf, as_of_ts, day, is_weekend
from ..operators import joins, metrics


def dim_customers(users: DataFrame, orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Customers with order metrics, spend tier and validity dates."""
    base = joins.join_metrics(
        users,
        metrics.customer_metrics(orders),
        "user_id",
        {"total_orders": 0, "total_spent": 0.0, "avg_order_value": 0.0},
    )
    return base.withColumns(
        {
            "customer_segment": labels.customer_tier(),
            "effective_date": as_of_ts(as_of).cast("date"),
            "expiration_date": F.lit("9999-12-31").cast("date"),
            "is_current": F.lit(True),
        }
    )


def dim_products(products: DataFrame, items: DataFrame) -> DataFrame:
    base = joins.join_metrics(
        products, metrics.product_sales(items), "product_id", {"total_sold": 0, "total_revenue": 0.0}
    )
    return base.withColumns(
        {
            "inventory_value": F.round(F.col("price") * F.col("stock"), 2),
            "stock_status": labels.stock_status(),
            "product_performance": labels.sales_band(),
        }
    )


def fact_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with line roll-up, date parts, weekend flag and expected delivery days."""
    base = joins.join_metrics(orders, metrics.order_item_rollup(items), "order_id")
    return base.withColumns(
        {
            "order_year": F.year("created_at"),
            "order_month": F.month("created_at"),
            "order_day": F.dayofmonth("created_at"),
            "order_weekday": F.dayofweek("created_at"),
            "order_quarter": F.quarter("created_at"),
            "is_weekend": is_weekend("created_at"),
            "expected_delivery_days": labels.sla_days(),
        }
    )


def fact_order_items(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with category, order date and profit at a cost of 60 % of the price."""
    priced = joins.enrich_items(items, products, orders).withColumns(
        {"unit_cost": F.col("unit_price") * 0.6, "line_revenue": F.col("quantity") * F.col("unit_price")}
    )
    priced = priced.withColumn("line_cost", F.col("quantity") * F.col("unit_cost"))
    priced = priced.withColumn("line_profit", F.col("line_revenue") - F.col("line_cost"))
    return priced.withColumn("profit_margin", F.round(pct("line_profit", "line_revenue"), 2))


def fact_support_tickets(tickets: DataFrame) -> DataFrame:
    """Tickets with severity, follow-up flag and days to resolution when it is known."""
    return tickets.withColumns(
        {
            "resolution_days": F.when(
                F.col("status").isin("Resolved", "Closed"), F.datediff("resolved_at", "created_at")
            ).cast("double"),
            "severity_score": labels.severity_score(),
            "requires_followup": labels.requires_followup(),
        }
    )


def order_profit(items: DataFrame) -> DataFrame:
    """Profit per order at 40 % of line value."""
    return items.groupBy("order_id").agg(F.round(money_sum(metrics.line_value() * 0.4, MILLS), 2).alias("order_profit"))


def simple_fact_orders(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Short staging form of orders: item counts, profit, year, month and weekend flag."""
    rollup = metrics.order_item_rollup(items).drop("line_count")
    base = joins.join_metrics(orders, rollup, "order_id", {"total_items": 0, "distinct_products": 0})
    base = joins.join_metrics(base, order_profit(items), "order_id", {"order_profit": 0.0})
    return base.withColumns(
        {"order_year": F.year("created_at"), "order_month": F.month("created_at"), "is_weekend": is_weekend("created_at")}
    )


def nested_fact_orders(nested: DataFrame) -> DataFrame:
    """The same measures from orders that carry their lines as an array."""
    value = F.aggregate("items", F.lit(0.0), lambda acc, x: acc + x["quantity"] * x["unit_price"] * 0.4)
    units = F.aggregate("items", F.lit(0).cast("bigint"), lambda acc, x: acc + x["quantity"].cast("bigint"))
    measures = nested.select("id", units.alias("units"), value.alias("profit")).groupBy("id").agg(
        F.sum("units").alias("total_items"), money_sum("profit", MILLS).alias("order_profit")
    )
    products = (
        nested.select("id", F.explode_outer(F.array_distinct(F.transform("items", lambda x: x["product_id"]))).alias("p"))
        .groupBy("id")
        .agg(F.countDistinct("p").alias("distinct_products"))
    )
    return measures.join(products, "id")


def conform_day(df: DataFrame, ts: str = "created_at") -> DataFrame:
    return df.withColumn(ts, day(ts))
