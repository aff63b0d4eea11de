"""Writers and the snapshot table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import top_n

MAX_ROWS_PER_FILE = 1_000_000


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite", max_rows: int = MAX_ROWS_PER_FILE) -> int:
    """Write a Parquet table and return its row count, observed during the write.

    Rows are brought together by partition value first, so a partition is not scattered over one
    small file per task. The exchange may be rebalanced, so a large partition is split over tasks.
    Files are compressed with zstd.
    """
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    if partition_by:
        out = out.hint("rebalance", *[F.col(c) for c in partition_by])
    writer = out.write.mode(mode).option("maxRecordsPerFile", max_rows).option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return seen.get["rows"]


def land_all(tables: dict[str, DataFrame], root: str, load_date: dt.date) -> dict[str, int]:
    """Copy every table to ``root/table/yyyy/MM/dd``; returns rows per table."""
    return {name: write_table(df, f"{root}/{name}/{load_date:%Y/%m/%d}") for name, df in tables.items()}


def write_json(df: DataFrame, root: str, stamp: dt.datetime) -> str:
    path = f"{root}/{stamp:%Y/%m/%d/%H%M}"
    df.write.mode("overwrite").json(path)
    return path


def register(spark: SparkSession, database: str, name: str, path: str, replace: bool = False) -> str:
    """Make a written table known to the catalog. A table of that name is an error unless it is to be replaced."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    if replace:
        spark.sql(f"DROP TABLE IF EXISTS {database}.{name}")
    spark.sql(f"CREATE TABLE {database}.{name} USING PARQUET LOCATION '{path}'")
    return f"{database}.{name}"


def export_csv(tables: dict[str, DataFrame], root: str) -> dict[str, int]:
    """One CSV folder with header per table; returns rows per table."""
    counts = {}
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def append_log(df: DataFrame, path: str) -> None:
    """Append all rows of one run at once."""
    df.write.mode("append").parquet(path)


def clustered(df: DataFrame, cols: list[str], target_rows: int, rows: int) -> DataFrame:
    """Range-partition and sort by the cluster columns into files of about ``target_rows`` rows."""
    parts = max(1, -(-rows // target_rows))
    return df.repartitionByRange(parts, *cols).sortWithinPartitions(*cols)


REGISTRY = "version int, ts timestamp_ntz, state string"


class SnapshotTable:
    """A table of full snapshots ``root/version=N`` with an append-only registry of their states.

    A version is visible once its registry row is written, after its data. One writer is assumed.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _fs(self, path: str):
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), hadoop

    def registry(self) -> DataFrame:
        fs, path = self._fs(f"{self.root}/_registry")
        if not fs.exists(path):
            return self.spark.createDataFrame([], REGISTRY)
        return self.spark.read.schema(REGISTRY).parquet(f"{self.root}/_registry")

    def _note(self, version: int, ts: dt.datetime, state: str) -> None:
        row = self.spark.createDataFrame([(version, ts, state)], REGISTRY).coalesce(1)
        row.write.mode("append").parquet(f"{self.root}/_registry")

    def live(self) -> DataFrame:
        """Versions that can be read."""
        gone = self.registry().filter("state = 'expired'").select("version")
        return self.registry().filter("state = 'written'").join(gone, "version", "left_anti").select("version", "ts")

    def latest(self, as_of: dt.datetime | None = None) -> int | None:
        rows = self.live() if as_of is None else self.live().filter(F.col("ts") <= F.lit(as_of).cast("timestamp_ntz"))
        return rows.agg(F.max_by("version", F.struct("ts", "version"))).first()[0]

    def commit(self, df: DataFrame, ts: dt.datetime, partition_by: list[str] | None = None) -> int:
        top = self.registry().agg(F.max("version")).first()[0]
        version = 0 if top is None else top + 1
        write_table(df, f"{self.root}/version={version}", partition_by)
        self._note(version, ts, "written")
        return version

    def read(self, version: int | None = None, as_of: dt.datetime | None = None) -> DataFrame:
        """A version, the newest one at a time, or the newest of all."""
        picked = version if version is not None else self.latest(as_of)
        if picked is None:
            raise ValueError(f"no snapshot of {self.root} at {as_of}")
        return self.spark.read.parquet(f"{self.root}/version={picked}")

    def upsert(self, changes: DataFrame, keys: list[str], order_col: str, ts: dt.datetime) -> int:
        """Replace and add rows by key; the newest of several changes of a key wins."""
        return self.commit(upsert(self.read(), changes, keys, order_col), ts)

    def compact(self, cols: list[str], target_rows: int, ts: dt.datetime) -> int:
        """Rewrite the newest snapshot clustered by ``cols``."""
        df = self.read()
        return self.commit(clustered(df, cols, target_rows, df.count()), ts)

    def expire(self, keep_hours: int, as_of: dt.datetime) -> list[int]:
        """Drop versions older than ``keep_hours``; the newest one always stays."""
        newest = self.latest()
        limit = F.lit(as_of - dt.timedelta(hours=keep_hours)).cast("timestamp_ntz")
        old = [r["version"] for r in self.live().filter((F.col("ts") < limit) & (F.col("version") != newest)).orderBy("version").collect()]
        for version in old:
            self._note(version, as_of, "expired")
            fs, path = self._fs(f"{self.root}/version={version}")
            fs.delete(path, True)
        return old


def newest_per_key(changes: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    """The row of each key with the largest ``order_col``; equal ones are told apart by all other columns."""
    rest = [F.desc_nulls_last(c) for c in sorted(changes.columns) if c not in (*keys, order_col)]
    return top_n(changes, keys, [F.desc(order_col), *rest], 1)


def upsert(target: DataFrame, changes: DataFrame, keys: list[str], order_col: str) -> DataFrame:
    fresh = newest_per_key(changes, keys, order_col)
    return target.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh.select(*target.columns))


def scd2_merge(current: DataFrame, incoming: DataFrame, key: str, tracked: list[str], as_of: dt.date) -> DataFrame:
    """Type 2 history: expire changed rows, add new versions and new keys, carry the rest.

    ``current`` has effective_date, expiration_date and is_current. Running the same day twice
    changes nothing. Keys that are missing from ``incoming`` stay current.
    """
    state = F.struct(*tracked)
    # A key that comes twice in a batch counts once: the row that is largest in the tracked columns.
    incoming = newest_per_key(incoming, [key], tracked[0])
    fresh = incoming.select(key, state.alias("_new"))
    closed, open_ = current.filter("NOT is_current"), current.filter("is_current")
    changed = F.col("_new").isNotNull() & ~state.eqNullSafe(F.col("_new"))
    kept = open_.join(fresh, key, "left").withColumn("_changed", changed).withColumns(
        {"expiration_date": F.when(F.col("_changed"), F.lit(as_of)).otherwise(F.col("expiration_date")), "is_current": ~F.col("_changed")}
    ).select(*current.columns)
    before = open_.select(key, state.alias("_old"))
    added = incoming.join(before, key, "left").filter(F.col("_old").isNull() | ~state.eqNullSafe(F.col("_old"))).drop("_old")
    added = added.withColumns(
        {"effective_date": F.lit(as_of), "expiration_date": F.lit("9999-12-31").cast("date"), "is_current": F.lit(True)}
    )
    return closed.unionByName(kept).unionByName(added.select(*current.columns))
