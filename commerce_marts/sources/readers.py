"""Readers: tables, incremental loads, lenient and uploaded sales files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.timeutil import AsOf, as_of_ts
from ..operators.onerow import beside


def read_source(spark: SparkSession, fmt: str, schema: str | None = None, bounds: tuple[str, int, int, int] | None = None, **options) -> DataFrame:
    """Open one source table.

    For JDBC ``bounds`` is (column, lower, upper, partitions), so the table is read in parallel.
    """
    reader = spark.read.format(fmt).options(**{k: str(v) for k, v in options.items() if k != "path"})
    if bounds:
        column, low, high, parts = bounds
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts))
    if schema:
        reader = reader.schema(schema)
    return reader.load(options["path"]) if "path" in options else reader.load()


def with_ingest_meta(df: DataFrame, execution_date: str, source: str, ts: AsOf) -> DataFrame:
    """Load time, execution date and source name; the time is given, so a repeated run is equal."""
    return df.withColumns(
        {"_ingestion_timestamp": as_of_ts(ts).cast("timestamp"), "_execution_date": F.lit(execution_date), "_source": F.lit(source)}
    )


def incremental_ingest(df: DataFrame, mark_col: str | None, last_value: AsOf | None) -> DataFrame:
    """Rows newer than the last high-water mark; all rows when there is no mark."""
    if mark_col is None or last_value is None:
        return df
    return df.filter(F.col(mark_col) > as_of_ts(last_value))


def high_water_mark(df: DataFrame, table: str, mark_col: str) -> DataFrame:
    return df.agg(F.max(mark_col).alias("mark")).withColumn("table_name", F.lit(table))


def stored_mark(spark: SparkSession, marks: str, table: str):
    """The largest mark stored for a table, None before its first load."""
    try:
        stored = spark.read.schema("mark timestamp_ntz, table_name string").parquet(marks)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return stored.filter(F.col("table_name") == table).agg(F.max("mark")).first()[0]


def append_increment(df: DataFrame, path: str, marks: str, table: str, mark_col: str) -> None:
    """Append the rows beyond the stored mark, then store the new mark.

    A load that ends between both is taken up by the next one with the same rows; an append of the
    same rows again is told by the mark column and a key, not here.
    """
    fresh = incremental_ingest(df, mark_col, stored_mark(df.sparkSession, marks, table))
    fresh.write.mode("append").parquet(path)
    high_water_mark(fresh, table, mark_col).filter("mark IS NOT NULL").write.mode("append").parquet(marks)


def read_sales_csv(spark: SparkSession, path: str) -> DataFrame:
    """A (date, revenue, orders) file read leniently: bad date NULL, bad revenue 0.0, bad orders 0."""
    raw = spark.read.option("header", True).schema("date string, revenue string, orders string").csv(path)
    return raw.select(
        F.to_date(F.try_to_timestamp("date")).alias("date"),
        F.coalesce(F.col("revenue").try_cast("double"), F.lit(0.0)).alias("revenue"),
        F.coalesce(F.col("orders").try_cast("double").cast("int"), F.lit(0)).alias("orders"),
    )


def empty_sales(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "date date, revenue double, orders int")


def with_row_numbers(df: DataFrame, first: int = 2) -> DataFrame:
    """Number the rows in file order, the header being row 1; only rows per partition are counted together."""
    marked = df.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()})
    sizes = marked.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    local = F.col("_id") - F.shiftleft(F.col("_part").cast("bigint"), 33)
    return marked.join(offsets, "_part").withColumn("row", local + F.col("_before") + first).drop("_part", "_id", "_before")


def _named(df: DataFrame, names: list[str]) -> str | None:
    lower = {c.lower().strip(): c for c in df.columns}
    return next((c for low, c in lower.items() if low in names), None)


def parse_upload_date(text: Column) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in fv.UPLOAD_DATE_FORMATS])


def normalize_sales_upload(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Uploaded sales rows by flexible header names: (one row per date, rejected rows with reason).

    ``df`` holds text columns and a ``row`` number (see :func:`with_row_numbers`).
    """
    date_col, revenue_col, orders_col = (_named(df, names) for names in (fv.DATE_HEADERS, fv.REVENUE_HEADERS, fv.ORDERS_HEADERS))
    if not date_col or not revenue_col:
        raise ValueError(f"file needs a date and a revenue column, found: {', '.join(df.columns)}")
    date_text = F.trim(F.coalesce(F.col(date_col), F.lit("")))
    money_text = F.trim(F.coalesce(F.col(revenue_col), F.lit("")))
    number_text = F.trim(F.regexp_replace(money_text, "[$€£,]", ""))
    orders = F.lit(1) if orders_col is None else F.coalesce(F.trim(orders_col).try_cast("int"), F.lit(1))
    parsed = df.select(
        "row", date_text.alias("_d"), money_text.alias("_m"), number_text.alias("_t"), parse_upload_date(date_text).alias("date"),
        number_text.try_cast("double").alias("revenue"), orders.alias("orders"),
    )
    reason = (
        F.when(F.col("_d") == "", "Missing date value")
        .when(F.col("date").isNull(), F.concat(F.lit("Invalid date format '"), "_d", F.lit("'")))
        .when(F.col("_m") == "", "Missing revenue value")
        .when(F.col("revenue").isNull(), F.concat(F.lit("Invalid revenue value '"), "_t", F.lit("'")))
        .when(F.col("revenue") < 0, "Revenue cannot be negative")
    )
    marked = parsed.withColumn("_why", reason)
    good = marked.filter("_why IS NULL").groupBy("date").agg(F.sum(F.col("revenue").cast("decimal(18,2)")).cast("double").alias("revenue"), F.sum("orders").alias("orders"))
    text = F.concat(F.lit("Row "), F.col("row").cast("string"), F.lit(": "), "_why")
    return good, marked.filter("_why IS NOT NULL").select("row", text.alias("reason"))


def rows_to_df(spark: SparkSession, rows: list[dict] | DataFrame) -> DataFrame:
    """A (date, revenue, orders) frame from a request body or a column ``payload`` of JSON texts; rows that do not parse are dropped."""
    schema = "date string, revenue string, orders string"
    if isinstance(rows, DataFrame):
        text = rows.select(F.from_json("payload", schema).alias("r")).select("r.*")
    else:
        text = spark.createDataFrame([tuple(None if r.get(c) is None else str(r.get(c)) for c in ("date", "revenue", "orders")) for r in rows], schema)
    out = text.select(
        F.to_date(F.try_to_timestamp("date")).alias("date"), F.col("revenue").try_cast("double").alias("revenue"),
        F.coalesce(F.col("orders").try_cast("int"), F.lit(1)).alias("orders"),
    )
    return out.dropna(subset=["date", "revenue"])


def catalog_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """Column names, types and row count per table; counts read no columns."""
    out = None
    for name, df in tables.items():
        types = ", ".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), F.lit(len(df.columns)).alias("columns"), F.lit(types).alias("types"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def page(df: DataFrame, order_by: list[str], limit: int, offset: int = 0) -> DataFrame:
    """One page of a table in a fixed order, each row with the ``total`` number of rows."""
    return beside(df.orderBy(*order_by).offset(offset).limit(limit), df.agg(F.count(F.lit(1)).alias("total")))


def layer_sample(tables: dict[str, DataFrame], n: int = 100) -> dict[str, tuple[DataFrame, bool]]:
    """First ``n`` rows of every table and whether there are more."""
    out = {}
    for name, df in tables.items():
        more = df.limit(n + 1).count() > n
        out[name] = (df.limit(n), more)
    return out


def sales_file_marts(series: DataFrame) -> DataFrame:
    """One fact row per day of a sales file: average value, weekend flag and profit at 35 %."""
    orders = F.when(F.col("orders") == 0, 1).otherwise(F.col("orders"))
    return series.select(
        F.col("date").alias("order_date"), F.col("orders").alias("order_count"), F.col("revenue").alias("total_revenue"),
        F.round(F.try_divide("revenue", F.greatest(orders, F.lit(1))), 2).alias("average_value"), F.year("date").alias("order_year"),
        F.coalesce(F.dayofweek("date").isin(1, 7), F.lit(False)).alias("is_weekend"), F.round(F.col("revenue") * 0.35, 2).alias("profit_estimate"),
    )


def trend(series: DataFrame) -> DataFrame:
    return series.select("date", "revenue", "orders").orderBy("date")
