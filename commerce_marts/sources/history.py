"""Type 2 history from changes that come in any order.

A history has one row for each date at which the state of a key was reported, valid until the key's next
date. A change dated inside a closed period splits it. Rows that repeat the state before them are kept and
marked, because a later change may fall between the two; ``periods`` merges them. So the history depends on
the set of changes alone, neither on their order nor on how often they are sent.

Changes are first reduced to one for each key and date, before and after the shuffle. A key has then at most
one row a day, which bounds the window over it by the calendar, however many changes it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

OPEN_END = "9999-12-31"


def _reports(df: DataFrame, key: str, tracked: list[str], at: str) -> DataFrame:
    return df.select(F.col(key), F.col(at).cast("date").alias("effective_date"), F.struct(*tracked).alias("_state")).filter("effective_date IS NOT NULL")


def _until(key: str) -> Column:
    return F.lead("effective_date").over(Window.partitionBy(key).orderBy("effective_date"))


def late_changes(history: DataFrame | None, changes: DataFrame, key: str, tracked: list[str], at: str = "effective_date") -> DataFrame:
    """The new history of the keys that ``changes`` name; other keys are neither read past the join nor returned.

    Returns key, ``tracked``, effective_date, expiration_date (exclusive), is_current and is_repeat (same state as
    the row before). Of several states of a key at one date the largest in ``tracked`` holds. A null key is a key
    like any other; changes without a date are left out. ``history`` is missing for the first batch.
    """
    reports = _reports(changes, key, tracked, at)
    if history is not None:
        named = reports.select(F.col(key).alias("_key")).distinct()
        held = history.join(named, F.col(key).eqNullSafe(F.col("_key")), "left_semi")
        reports = reports.unionByName(_reports(held, key, tracked, "effective_date"))
    day = reports.groupBy(key, "effective_date").agg(F.max("_state").alias("_state"))
    before = F.lag("_state").over(Window.partitionBy(key).orderBy("effective_date"))
    rows = day.withColumns({"_until": _until(key), "is_repeat": before.isNotNull() & before.eqNullSafe(F.col("_state"))})
    end = F.coalesce("_until", F.lit(OPEN_END).cast("date")).alias("expiration_date")
    return rows.select(key, "_state.*", "effective_date", end, F.col("_until").isNull().alias("is_current"), "is_repeat")


def merge_late(history: DataFrame, changes: DataFrame, key: str, tracked: list[str], at: str = "effective_date") -> DataFrame:
    """The whole history after a batch: rows of other keys as they are, those of named keys anew."""
    named = _reports(changes, key, tracked, at).select(F.col(key).alias("_key")).distinct()
    same = history.join(named, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return same.unionByName(late_changes(history, changes, key, tracked, at))


def periods(history: DataFrame, key: str) -> DataFrame:
    """The history with neighbouring rows of one state merged into one period."""
    rows = history.filter("NOT is_repeat").withColumn("_until", _until(key))
    rows = rows.withColumns({"expiration_date": F.coalesce("_until", F.lit(OPEN_END).cast("date")), "is_current": F.col("_until").isNull()})
    return rows.drop("_until", "is_repeat")


def as_of(history: DataFrame, date: str | Column) -> DataFrame:
    """The rows valid at a date."""
    on = F.lit(date).cast("date") if isinstance(date, str) else date
    return history.filter((F.col("effective_date") <= on) & (on < F.col("expiration_date")))


def update_stored(changes: DataFrame, root: str, key: str, tracked: list[str], at: str = "effective_date", buckets: int = 64) -> None:
    """Apply a batch to a history stored by hash bucket of the key; only buckets of named keys are read and written.

    The new rows are complete in the shared folder before any old ones are replaced, and a batch may be sent
    again. One writer is assumed; ``buckets`` stays the same for the life of the table and follows its size.
    """
    spark, bucket = changes.sparkSession, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    old = None
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        touched = [r[0] for r in changes.select(bucket).distinct().collect()]
        old = spark.read.parquet(root).filter(F.col("history_bucket").isin(touched)).drop("history_bucket")
    fresh = late_changes(old, changes, key, tracked, at) if old is None else merge_late(old, changes, key, tracked, at)
    fresh = cut_lineage(fresh.withColumn("history_bucket", bucket), "history")
    parts = fresh.repartition("history_bucket")
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("history_bucket").parquet(root)
