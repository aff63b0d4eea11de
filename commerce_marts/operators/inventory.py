"""Inventory and pricing analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import labels
from ..functions.money import FINE, money_avg, money_sum, ratio
from ..functions.timeutil import AsOf
from . import metrics, ordered


def with_days_of_inventory(df: DataFrame) -> DataFrame:
    """Days the stock lasts at the daily velocity, 999 without sales, and the alert level."""
    days = F.when(F.col("daily_velocity") > 0, F.col("stock") / F.col("daily_velocity")).otherwise(F.lit(999.0))
    return df.withColumn("days_of_inventory", days).withColumn("stock_alert", labels.stock_alert())


def with_abc(df: DataFrame, revenue: str = "total_revenue") -> DataFrame:
    return ordered.running_share(df, revenue).withColumn("abc_classification", labels.abc_class())


def with_reorder(df: DataFrame) -> DataFrame:
    """Reorder flag and quantity for 60 days, never negative."""
    flag = F.col("stock_alert").isin("OUT_OF_STOCK", "CRITICAL", "LOW") | (F.col("stock") < F.col("daily_velocity") * 30)
    qty = F.greatest((F.col("daily_velocity") * 60 - F.col("stock")).cast("int"), F.lit(0))
    return df.withColumn("reorder_recommended", flag).withColumn(
        "suggested_reorder_qty", F.when(F.col("reorder_recommended"), qty).otherwise(0)
    )


def inventory_simple(dim_products: DataFrame) -> DataFrame:
    """Short form: velocity over 90 days, ABC by revenue thresholds."""
    velocity = F.when(F.col("total_sold") > 0, F.col("total_sold") / 90).otherwise(F.lit(0.0))
    df = dim_products.withColumn("_v", velocity)
    days = F.when(F.col("_v") > 0, F.col("stock") / F.col("_v")).otherwise(F.lit(999.0))
    reorder = (days < 30) | (F.col("stock") < 10)
    qty = F.greatest(F.lit(0), (F.col("_v") * 60 - F.col("stock")).cast("int"))
    return df.select(
        "id", "sku", "category", "stock", "total_sold", "total_revenue", "stock_status",
        F.round("_v", 2).alias("daily_velocity"),
        F.round(days, 1).alias("days_of_inventory"),
        labels.banded("total_revenue", [(50000, "A"), (10000, "B")], "C").alias("abc_classification"),
        reorder.alias("reorder_recommended"),
        F.when(reorder, qty).otherwise(0).alias("suggested_reorder_qty"),
    )


def _with_recent_units(products: DataFrame, units: DataFrame) -> DataFrame:
    out = products.join(units.withColumnRenamed("product_id", "id"), "id", "left")
    return out.withColumns({"units": F.coalesce("units", F.lit(0)), "revenue": F.coalesce("revenue", F.lit(0.0))})


def shortage_forecast(products: DataFrame, orders: DataFrame, items: DataFrame, as_of: AsOf, days_ahead: int = 14, threshold: int = 10) -> DataFrame:
    """Low-stock products that run out within the horizon at the 30-day velocity."""
    low = products.filter(F.col("stock") < threshold)
    df = _with_recent_units(low, metrics.recent_units(orders, items, as_of)).withColumn("_v", F.col("units") / 30)
    df = df.withColumn("_left", ratio("stock", "_v")).filter(F.col("_left") <= days_ahead)
    return df.select(
        F.col("id").alias("product_id"), "name", F.col("stock").alias("current_stock"),
        F.round("_v", 2).alias("avg_daily_sales"), F.round("_left", 1).alias("predicted_stockout_days"),
        F.when(F.col("_left") <= 7, "high").otherwise("medium").alias("urgency"),
    )


def reorder_recommendations(products: DataFrame, orders: DataFrame, items: DataFrame, as_of: AsOf, lead_time_days: int = 7, safety_stock_days: int = 7) -> DataFrame:
    """Reorder point from lead-time demand and safety stock."""
    df = _with_recent_units(products, metrics.recent_units(orders, items, as_of)).withColumn("_v", F.col("units") / 30)
    df = df.withColumns({"_lead": F.col("_v") * lead_time_days, "_safe": F.col("_v") * safety_stock_days})
    df = df.withColumn("_point", F.col("_lead") + F.col("_safe"))
    need = F.greatest(F.lit(0.0), F.col("_point") - F.col("stock"))
    df = df.withColumn("_need", need).filter((F.col("_need") > 0) | (F.col("stock") < F.col("_point") * 0.5))
    return df.select(
        F.col("id").alias("product_id"), "name", F.col("stock").alias("current_stock"),
        F.round("_point", 0).alias("reorder_point"),
        F.round(F.greatest(F.col("_need"), F.col("_v") * 30), 0).alias("recommended_quantity"),
        F.round("_lead", 2).alias("lead_time_demand"), F.round("_safe", 2).alias("safety_stock"),
        F.when(F.col("stock") < F.col("_safe"), "high").otherwise("medium").alias("priority"),
    )


def demand_spikes(products: DataFrame, daily_units: DataFrame, ratio_limit: float = 3.0) -> DataFrame:
    """Products whose mean over the last 7 selling days is above ``ratio_limit`` times the mean of all."""
    w = Window.partitionBy("product_id").orderBy(F.desc("date"))
    seen = daily_units.withColumn("_rn", F.row_number().over(w)).groupBy("product_id").agg(
        F.count(F.lit(1)).alias("_days"),
        F.avg("quantity").alias("overall_avg_daily_sales"),
        (F.sum(F.when(F.col("_rn") <= 7, F.col("quantity"))) / 7).alias("recent_avg_daily_sales"),
    )
    hot = seen.filter("_days >= 7").filter(F.col("recent_avg_daily_sales") > F.col("overall_avg_daily_sales") * ratio_limit)
    goods = products.select(F.col("id").alias("product_id"), "name", F.col("stock").alias("current_stock"))
    return hot.join(goods, "product_id").filter(F.col("current_stock") < F.col("recent_avg_daily_sales") * 7).select(
        F.lit("demand_spike").alias("type"), "product_id", "name", "current_stock",
        F.round("recent_avg_daily_sales", 2).alias("recent_avg_daily_sales"),
        F.round("overall_avg_daily_sales", 2).alias("overall_avg_daily_sales"), F.lit("high").alias("severity"),
    )


def dead_stock(products: DataFrame, orders: DataFrame, items: DataFrame, as_of: AsOf, min_stock: int = 50, days: int = 30) -> DataFrame:
    """Well-stocked products without any sale in the period."""
    sold = metrics.recent_units(orders, items, as_of, days, None).filter("units <> 0")
    idle = products.filter(F.col("stock") > min_stock).join(sold.select(F.col("product_id").alias("id")), "id", "left_anti")
    return idle.select(
        F.lit("dead_stock").alias("type"), F.col("id").alias("product_id"), "name", F.col("stock").alias("current_stock"),
        F.lit("medium").alias("severity"),
    )


def pricing_hints(products: DataFrame, items: DataFrame) -> DataFrame:
    """Products sold on average above 110 % of the list price."""
    sold = items.groupBy(F.col("product_id").alias("id")).agg(money_avg("unit_price", FINE).alias("_avg"))
    return products.join(sold, "id").filter(F.col("_avg") > F.col("price") * 1.1).select(
        F.col("id").alias("product_id"), F.col("name").alias("title"), F.lit("Increase Price").alias("action"),
        F.col("price").alias("current_price"), F.round("_avg", 2).alias("suggested_price"),
    )


def promotion_ranking(products: DataFrame, orders: DataFrame, items: DataFrame, as_of: AsOf, pool: int = 10, k: int = 5) -> DataFrame:
    """The first ``k`` of the ``pool`` best sellers of the last 30 days, scored by revenue and units."""
    units = metrics.recent_units(orders, items, as_of)
    best = units.join(products.withColumnRenamed("id", "product_id"), "product_id")
    best = best.orderBy(F.desc("units"), "product_id").limit(pool).limit(k)
    return best.select(
        "product_id", F.col("name").alias("title"), "category", "price", "stock",
        (F.col("revenue") * 0.7 + F.col("units") * 0.3).alias("performance_score"),
        F.when(F.col("stock") > 20, "Promote").otherwise("Restock & Promote").alias("action"),
    )


def low_stock_list(products: DataFrame, threshold: int = 5) -> DataFrame:
    return products.filter(F.col("stock") <= threshold).select(
        "id", "name", "category", "stock", "price", F.when(F.col("stock") == 0, "critical").otherwise("warning").alias("severity")
    )


def warehouse_totals(products: DataFrame) -> DataFrame:
    """Per category and overall (category NULL) in one grouping-sets pass."""
    value = F.col("price") * F.col("stock")
    return products.groupingSets([["category"], []], "category").agg(
        F.sum("stock").alias("total_stock"),
        money_sum(value).alias("total_value"),
        F.count(F.lit(1)).alias("product_count"),
        F.count(F.when(F.col("stock") < 10, 1)).alias("low_stock_count"),
        F.count(F.when(F.col("stock") == 0, 1)).alias("out_of_stock_count"),
    )


def under_performers(products: DataFrame, orders: DataFrame, items: DataFrame, as_of: AsOf) -> DataFrame:
    """Stock above 50 with fewer than 5 units sold in 30 days."""
    stocked = products.filter(F.col("stock") > 50)
    df = _with_recent_units(stocked, metrics.recent_units(orders, items, as_of)).filter("units < 5")
    return df.select(
        F.col("id").alias("product_id"), "name", "stock", F.col("units").alias("monthly_sales"),
        F.round(ratio("units", "stock"), 3).alias("turnover_rate"),
    )


def top_performers(products: DataFrame, orders: DataFrame, items: DataFrame, as_of: AsOf, k: int = 10) -> DataFrame:
    units = metrics.recent_units(orders, items, as_of)
    goods = products.select(F.col("id").alias("product_id"), "name", "category", "stock")
    best = units.join(goods, "product_id").orderBy(F.desc("units"), "product_id").limit(k)
    return best.select("product_id", "name", "category", F.col("units").alias("units_sold"), "revenue", "stock")


def run_rate_prediction(orders: DataFrame, as_of: AsOf, days: int = 30, default: float = 5000.0) -> DataFrame:
    """Revenue of the next ``days`` at the mean of the last 30."""
    from ..functions.timeutil import since

    past = metrics.completed_orders(orders, fv.COMPLETED).filter(since("created_at", as_of, days=30))
    total = past.agg(F.coalesce(money_sum("total_amount"), F.lit(0.0)).alias("t"))
    rate = F.when(F.col("t") > 0, F.col("t") / 30).otherwise(default)
    return total.select(
        F.round(rate * days, 2).alias("predicted_revenue"), F.round(rate, 2).alias("avg_daily_revenue"), F.lit(days).alias("prediction_days")
    )
