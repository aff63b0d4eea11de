"""The lake run: raw to staging to curated, each table written once, with counts and a run record."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeutil import AsOf
from ..operators import quality
from ..sources import readers, schemas, sinks
from ..sources.canonical import Retail
from . import marts, staging


def _store(df: DataFrame, root: str, layer: str, table: str) -> int:
    out = schemas.conform(df, schemas.schema_of(layer, table))
    if table in schemas.MONTHLY:
        out = out.withColumn("_month", F.date_format(schemas.MONTHLY[table], "yyyy-MM"))
    return sinks.write_table(out, f"{root}/{layer}/{table}", schemas.PARTITIONS[table])


def _load(spark: SparkSession, root: str, layer: str, table: str) -> DataFrame:
    schema = schemas.schema_of(layer, table)
    return spark.read.schema(schema).parquet(f"{root}/{layer}/{table}").select(*schema.names)


def raw_tables(retail: Retail) -> dict[str, DataFrame]:
    return {
        "users": retail.users, "products": retail.products, "orders": retail.orders, "order_items": retail.order_items, "support_tickets": retail.tickets,
    }


def run_raw(retail: Retail, root: str, execution_date: str) -> dict[str, int]:
    tables = raw_tables(retail)
    return {
        name: _store(readers.with_ingest_meta(df, execution_date, "source", execution_date), root, "raw", name) for name, df in tables.items()
    }


def run_staging(retail: Retail, root: str, as_of: AsOf) -> dict[str, int]:
    """Staging tables from the written raw layer; ticket resolution dates come from the source."""
    spark = retail.spark
    users, products, orders, items = (_load(spark, root, "raw", t) for t in ("users", "products", "orders", "order_items"))
    frames = {
        "dim_customers": staging.dim_customers(users, orders, as_of),
        "dim_products": staging.dim_products(products, items),
        "fact_orders": staging.fact_orders(orders, items),
        "fact_order_items": staging.fact_order_items(items, products, orders),
        "fact_support_tickets": staging.fact_support_tickets(retail.tickets),
    }
    return {name: _store(df, root, "staging", name) for name, df in frames.items()}


def curated_frames(spark: SparkSession, root: str, as_of: AsOf) -> dict[str, DataFrame]:
    customers, products, orders, items = (_load(spark, root, "staging", t) for t in ("dim_customers", "dim_products", "fact_orders", "fact_order_items"))
    rollup = orders.select(orders.id.alias("order_id"), "total_items")
    plain = products.drop("total_sold", "total_revenue", "inventory_value", "stock_status", "product_performance")
    return {
        "sales_daily": marts.sales_daily_from(orders.drop("total_items"), rollup, items),
        "sales_weekly": marts.sales_weekly(orders),
        "sales_monthly": marts.sales_monthly(orders),
        "customer_360": marts.customer_360(customers, orders, items, as_of),
        "inventory_analytics": marts.inventory_analytics(products, items),
        "product_performance": marts.product_performance(plain, items),
    }


def run_curated(spark: SparkSession, root: str, as_of: AsOf) -> dict[str, int]:
    counts = {name: _store(df, root, "curated", name) for name, df in curated_frames(spark, root, as_of).items()}
    features = marts.anomaly_features(_load(spark, root, "curated", "sales_daily"))
    counts["anomaly_features"] = _store(features, root, "curated", "anomaly_features")
    return counts


def quality_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    layer = {**{t: "staging" for t in schemas.STAGING}, **{t: "curated" for t in schemas.CURATED}}
    names = dict.fromkeys(c.table for c in quality.SUITE)
    return {t: _load(spark, root, layer[t], t) for t in names}


def run_medallion(retail: Retail, root: str, as_of: dt.datetime, stop_on_fail: bool = True) -> dict:
    """Run all layers and the check suite; the gate decides whether the run counts as done."""
    spark = retail.spark
    stamp = str(as_of)
    layers = {"raw": run_raw(retail, root, stamp), "staging": run_staging(retail, root, stamp), "curated": run_curated(spark, root, stamp)}
    log = quality.stamped(quality.run_suite(quality_tables(spark, root)), stamp)
    sinks.append_log(log, f"{root}/monitoring/data_quality_log")
    written = spark.read.parquet(f"{root}/monitoring/data_quality_log").filter(f"execution_date = '{as_of:%Y-%m-%d}'")
    score = quality.gate(written.dropDuplicates(["table_name", "check_name"]), stop_on_fail)
    rows = [(layer, table, n) for layer, tables in layers.items() for table, n in tables.items()]
    record = spark.createDataFrame([(stamp, layer, table, n, score["status"]) for layer, table, n in rows], "run_at string, layer string, table_name string, rows bigint, quality string")
    sinks.append_log(record.coalesce(1), f"{root}/monitoring/run_log")
    return {"layers": layers, "quality": score}
