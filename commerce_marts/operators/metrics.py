"""Per-entity and per-period aggregates of orders and order lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import CENTS, MILLS, as_col, count_if, in_units, money_avg, money_sum, pct, ratio, units_sum
from ..functions.timeutil import day, since


def line_value() -> Column:
    return F.col("quantity") * F.col("unit_price")


def completed_orders(orders: DataFrame, statuses: list[str] = fv.COMPLETED) -> DataFrame:
    return orders.filter(F.col("status").isin(statuses))


def customer_metrics(orders: DataFrame) -> DataFrame:
    """Orders, spend, average order and last order per customer."""
    return orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        money_sum("total_amount").alias("total_spent"),
        money_avg("total_amount").alias("avg_order_value"),
        F.max("created_at").alias("last_order_date"),
    )


def product_sales(items: DataFrame) -> DataFrame:
    return items.groupBy("product_id").agg(
        F.sum("quantity").alias("total_sold"), money_sum(line_value()).alias("total_revenue")
    )


def order_item_rollup(items: DataFrame) -> DataFrame:
    """Quantity, lines and distinct products per order."""
    return items.groupBy("order_id").agg(
        F.sum("quantity").alias("total_items"),
        F.count(F.lit(1)).alias("line_count"),
        F.countDistinct("product_id").alias("distinct_products"),
    )


def order_product_lists(items: DataFrame) -> DataFrame:
    """Sorted product ids, one row for each order, whatever the number of its lines."""
    return items.groupBy("order_id").agg(F.sort_array(F.collect_list("product_id")).alias("product_ids"))


def orders_nested(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Each order with its lines as one array of structs, empty where it has none: one row for each order at any size."""
    line = F.struct("product_id", "product_name", "quantity", "unit_price")
    lists = items.groupBy(F.col("order_id").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("items"))
    empty = F.array().cast("array<struct<product_id:bigint,product_name:string,quantity:int,unit_price:double>>")
    return orders.join(lists, "id", "left").withColumn("items", F.coalesce("items", empty))


def daily_sales(orders: DataFrame, order_rollup: DataFrame) -> DataFrame:
    """Orders, revenue, customers and cancellations per day.

    Items come from the per-order roll-up; distinct customers are counted in their own two-step
    aggregate so the other measures need no expanded rows.
    """
    facts = orders.join(order_rollup.select(F.col("order_id").alias("id"), "total_items"), "id", "left")
    return facts.groupBy(day("created_at").alias("created_at")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        money_sum("total_amount").alias("total_revenue"),
        money_avg("total_amount").alias("avg_order_value"),
        F.coalesce(F.sum("total_items"), F.lit(0)).alias("total_items"),
        F.countDistinct("user_id").alias("unique_customers"),
        count_if(F.col("status") == "Delivered").alias("delivered_orders"),
        count_if(F.col("status") == "Cancelled").alias("cancelled_orders"),
    ).withColumn("cancellation_rate", F.round(pct("cancelled_orders", "total_orders"), 2))


def daily_profit(fact_items: DataFrame) -> DataFrame:
    return fact_items.groupBy(day("created_at").alias("created_at")).agg(
        money_sum("line_revenue").alias("item_revenue"),
        money_sum("line_profit", MILLS).alias("total_profit"),
        money_avg("profit_margin").alias("avg_profit_margin"),
    )


def weekly_sales(orders: DataFrame) -> DataFrame:
    """Roll-up by ISO year and week."""
    monday = F.date_sub(day("created_at"), F.weekday(day("created_at")))
    keyed = orders.select(
        "total_amount", "user_id", "created_at", F.year(F.date_add(monday, 3)).alias("year"), F.weekofyear("created_at").alias("week")
    )
    return keyed.groupBy("year", "week").agg(
        F.count(F.lit(1)).alias("total_orders"),
        money_sum("total_amount").alias("total_revenue"),
        money_avg("total_amount").alias("avg_order_value"),
        F.min("created_at").cast("date").alias("week_start"),
        F.max("created_at").cast("date").alias("week_end"),
        F.countDistinct("user_id").alias("unique_customers"),
    ).withColumn("year_week", F.concat(F.col("year").cast("string"), F.lit("-W"), F.col("week").cast("string")))


def monthly_sales(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.year("created_at").alias("year"), F.month("created_at").alias("month")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        money_sum("total_amount").alias("total_revenue"),
        money_avg("total_amount").alias("avg_order_value"),
        F.countDistinct("user_id").alias("unique_customers"),
        F.min("created_at").cast("date").alias("month_start"),
        F.max("created_at").cast("date").alias("month_end"),
    ).withColumn("year_month", F.concat(F.col("year").cast("string"), F.lit("-"), F.col("month").cast("string")))


def category_quantities(items_with_user: DataFrame) -> DataFrame:
    return items_with_user.groupBy("user_id", "category").agg(F.sum("quantity").alias("items_bought"))


def sales_velocity(fact_items: DataFrame) -> DataFrame:
    """Units per selling day and the last sale of each product."""
    return fact_items.groupBy("product_id").agg(
        F.sum("quantity").alias("total_sold"),
        F.countDistinct(day("created_at")).alias("selling_days"),
        F.max("created_at").alias("last_sold_date"),
    ).withColumn("daily_velocity", ratio("total_sold", F.greatest("selling_days", F.lit(1))))


def product_rollup(fact_items: DataFrame, parts: int = 8) -> DataFrame:
    """Units, money, orders and dates of sale per product.

    Orders are counted at their first line in a sort by order, so no task holds a hash table of all pairs of
    product and order. The orders of a product are dealt to ``parts`` parts, so a common one is shared by tasks.
    """
    lines = fact_items.select(
        "product_id", "order_id", "quantity", "unit_price", "created_at", in_units("line_revenue", CENTS).alias("_revenue"),
        in_units("line_profit", MILLS).alias("_profit"), F.pmod(F.xxhash64("order_id"), F.lit(parts)).cast("int").alias("_part"),
    )
    before = F.lag("order_id").over(Window.partitionBy("product_id", "_part").orderBy("order_id"))
    first = F.col("order_id").isNotNull() & ~F.col("order_id").eqNullSafe(before)
    return lines.withColumn("_first", first).groupBy("product_id").agg(
        F.sum("quantity").alias("units_sold"),
        units_sum("_revenue", CENTS).alias("total_revenue"),
        units_sum("_profit", MILLS).alias("total_profit"),
        F.round(F.avg("unit_price"), 6).alias("avg_selling_price"),
        count_if(F.col("_first")).alias("orders_count"),
        F.min("created_at").alias("first_sale"),
        F.max("created_at").alias("last_sale"),
    )


def sales_series(orders: DataFrame, as_of, days: int | None = 90, statuses: list[str] = fv.COMPLETED_OR_OUT) -> DataFrame:
    """Daily revenue and order count of completed orders, the last ``days`` days (all when None)."""
    done = completed_orders(orders, statuses)
    if days is not None:
        done = done.filter(since("created_at", as_of, days=days))
    return done.groupBy(day("created_at").alias("date")).agg(
        money_sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders")
    )


def product_series(orders: DataFrame, items: DataFrame, as_of, days: int | None = 90, statuses: list[str] = fv.COMPLETED) -> DataFrame:
    """Daily units per product from completed orders."""
    done = completed_orders(orders, statuses)
    if days is not None:
        done = done.filter(since("created_at", as_of, days=days))
    return (
        items.select("order_id", "product_id", "quantity")
        .join(done.select(F.col("id").alias("order_id"), day("created_at").alias("date")), "order_id")
        .groupBy("date", "product_id")
        .agg(F.sum("quantity").alias("quantity"))
    )


def recent_units(orders: DataFrame, items: DataFrame, as_of, days: int = 30, statuses: list[str] | None = fv.COMPLETED) -> DataFrame:
    """Units and revenue per product in the last ``days`` days, optionally by order status."""
    kept = orders.filter(since("created_at", as_of, days=days))
    if statuses:
        kept = completed_orders(kept, statuses)
    return (
        items.select("order_id", "product_id", "quantity", "unit_price")
        .join(kept.select(F.col("id").alias("order_id")), "order_id", "left_semi")
        .groupBy("product_id")
        .agg(F.sum("quantity").alias("units"), money_sum(line_value()).alias("revenue"))
    )


def value_by(df: DataFrame, key: str, value: str | Column, name: str) -> DataFrame:
    return df.groupBy(key).agg(money_sum(as_col(value)).alias(name))
