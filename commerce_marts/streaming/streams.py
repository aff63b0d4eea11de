"""Structured Streaming forms of the windowed metrics.

The windowed functions take a batch or a streaming frame alike. Watermarks bound the state; results
appear in append mode once a window is closed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.money import CENTS, in_units, money_sum
from ..operators.filters import apply_rules
from ..sources.batch_sums import BatchSums

MAX_FILES = 100
KEY_TYPE = "bigint"
EVERY = "5 minutes"


def file_stream(spark: SparkSession, path: str, schema: str, fmt: str = "parquet", max_files: int = MAX_FILES, glob: str | None = None) -> DataFrame:
    """A folder as a stream of files. A broker topic is the same with another format."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    """Event time as a zoned timestamp with a watermark (plain timestamps cannot carry one)."""
    out = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return out.withWatermark(ts, delay) if df.isStreaming else out


def writer(df: DataFrame, path: str, checkpoint: str, once: bool = False, partition_by: list[str] | None = None) -> DataStreamWriter:
    """Append to Parquet, every five minutes or once over all that is available."""
    out = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    if partition_by:
        out = out.partitionBy(*partition_by)
    return out.trigger(availableNow=True) if once else out.trigger(processingTime=EVERY)


def run_once(df: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None) -> DataFrame:
    """Process all available input and read the result back."""
    writer(df, path, checkpoint, True, partition_by).start().awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stream_ingest(source: DataFrame, path: str, checkpoint: str, once: bool = False) -> DataStreamWriter:
    """Micro-batch ingest of raw rows."""
    return writer(source, path, checkpoint, once)


def dedup_stream(df: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """One row per key within the lateness bound: the first to arrive in a stream, the earliest in a batch."""
    if not df.isStreaming:
        return first_rows(df, key, ts, delay)
    return with_event_time(df, ts, delay).dropDuplicatesWithinWatermark(key)


def first_rows(df: DataFrame, key: list[str], ts: str, delay: str) -> DataFrame:
    """The earliest row of each key, whatever order rows arrive in.

    Rows of a key that lie within ``delay`` of each other are copies; the earliest is held back until the
    watermark has passed the last of them and ``delay`` more, so no earlier copy can follow. Copies of the same
    time are decided by their other columns. Only the best row so far is kept for a key, in each task and
    in the state. Rows without a time are left out. Stream and batch give the same rows.
    """
    columns = df.columns
    timed = with_event_time(df.filter(F.col(ts).isNotNull()), ts, delay)
    row = F.struct(*[timed[c].alias(f"c{i}") for i, c in enumerate(columns)])
    rank = F.struct(F.col(ts), F.to_json(row))  # any order that all copies share
    held = timed.groupBy(F.session_window(ts, delay).alias("span"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(key)]).agg(F.min_by(row, rank).alias("first"))
    return held.select(*[F.col(f"first.c{i}").cast(df.schema[c].dataType).alias(c) for i, c in enumerate(columns)])


def velocity(df: DataFrame, ts: str, size: str, slide: str, threshold: int, delay: str = "1 hour", amount: str | None = None) -> DataFrame:
    """Users with at least ``threshold`` rows in a sliding window.

    Rows are pre-aggregated per task before the shuffle by user and window, so a busy user costs one
    row per task and window.
    """
    aggs = [F.count(F.lit(1)).alias("n")] + ([money_sum(amount).alias("spent")] if amount else [])
    counts = with_event_time(df, ts, delay).groupBy(F.window(ts, size, slide), "user_id").agg(*aggs)
    return counts.filter(F.col("n") >= threshold).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "user_id", *[a for a in counts.columns if a in ("n", "spent")])


def failed_logins(activities: DataFrame, threshold: int = 5, delay: str = "1 hour") -> DataFrame:
    """Failed-login bursts per user in a day, moved on by the hour."""
    return velocity(activities.filter("activity_type = 'login_failed'"), "created_at", "24 hours", "1 hour", threshold, delay)


def sessionize(df: DataFrame, ts: str, gap_minutes: int = 30, delay: str = "1 hour") -> DataFrame:
    """User sessions that end after a gap without activity; a gap of exactly the limit continues one.

    A stream uses session windows. A batch is first cut into sessions inside each user and day, then
    these are joined over midnight, so a very busy user is not ordered in one task.
    """
    if df.isStreaming:
        window = F.session_window(ts, f"{gap_minutes} minutes")
        grouped = with_event_time(df, ts, delay).groupBy(window, "user_id").agg(F.count(F.lit(1)).alias("events"))
        return grouped.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")
    gap = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(gap_minutes))
    rows = df.select("user_id", F.col(ts).alias("first"), F.col(ts).alias("last"), F.lit(1).cast("bigint").alias("events"), F.col(ts).cast("date").alias("_day"))
    by_day = _joined(rows, ["user_id", "_day"], gap)
    whole = _joined(by_day, ["user_id"], gap)
    return whole.select("user_id", F.col("first").alias("start"), (F.col("last") + gap).alias("end"), "events")


def _joined(spans: DataFrame, keys: list[str], gap: Column) -> DataFrame:
    """Join spans (first, last, events) of a key that lie within the gap of each other."""
    w = Window.partitionBy(*keys).orderBy("first", "last")
    reach = F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col("first") <= reach + gap, 0).otherwise(1)
    numbered = spans.withColumn("_new", fresh).withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_no").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("events").alias("events")).drop("_no")


def sales_daily(orders: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Daily sales with the exact number of customers, from two aggregations in a row.

    The first has one row for each day and customer, which leaves its state when the day is over; the second
    counts these rows and adds their sums. Money is added in whole cents.
    """
    count = lambda status: F.count(F.when(F.col("status") == status, 1))
    each = with_event_time(orders, "created_at", delay).groupBy(F.window("created_at", "1 day"), "user_id").agg(
        F.count(F.lit(1)).alias("orders"), F.sum(in_units("total_amount", CENTS)).alias("cents"), count("Delivered").alias("delivered"), count("Cancelled").alias("cancelled")
    )
    daily = each.groupBy(F.window(F.window_time("window"), "1 day")).agg(
        F.sum("orders").alias("total_orders"), (F.sum("cents").cast("double") / CENTS).alias("total_revenue"), F.sum("delivered").alias("delivered_orders"),
        F.sum("cancelled").alias("cancelled_orders"), F.count("user_id").alias("unique_customers"),
    )
    return daily.select(F.col("window.start").alias("day"), *[c for c in daily.columns if c != "window"])


def totals_store(spark: SparkSession, path: str, key: str) -> BatchSums:
    return BatchSums(spark, path, f"{key} {KEY_TYPE}, rows bigint, amount decimal(28,2)", [key])


def refresh_totals(source: DataFrame, path: str, key: str, amount: str, checkpoint: str, once: bool = True) -> DataStreamWriter:
    """Keep totals by key fresh: each micro-batch stores only its own sums.

    A repeated batch is known by its id and counts once; stored sums are merged by size class, so
    :func:`read_totals` opens few folders however many batches there were.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(amount).cast("decimal(18,2)")).alias("amount"))
        totals_store(batch.sparkSession, path, key).commit(batch_id, sums)

    out = source.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True) if once else out.trigger(processingTime=EVERY)


def read_totals(spark: SparkSession, path: str, key: str) -> DataFrame:
    """Rows and amount by key over all stored batches."""
    return totals_store(spark, path, key).totals()


def stream_alerts(source: DataFrame, rules: list[tuple[str, str, str]], key: Column, path: str, checkpoint: str, once: bool = True) -> DataStreamWriter:
    """Apply alert rules to every micro-batch; each batch writes its own folder, so a repeat replaces it."""

    def alert(batch: DataFrame, batch_id: int) -> None:
        apply_rules(batch, rules, key).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    out = source.writeStream.foreachBatch(alert).option("checkpointLocation", checkpoint)
    return out.trigger(availableNow=True) if once else out.trigger(processingTime=EVERY)
