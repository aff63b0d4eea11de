"""Spark session with the settings the marts rely on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from functools import cache
from uuid import uuid4

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split a skewed join even where that costs one more exchange.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Merge sessions of a stream inside each task before the shuffle by user.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(app: str = "commerce_marts", master: str | None = None, **conf: str) -> SparkSession:
    """Build or reuse a session. ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under the cluster's shared checkpoint folder.

    A cluster names its shared folder in ``spark.checkpoint.dir``. Where that is unset, as in tests,
    a temporary folder is taken once per process and removed at its end; a master that is not local
    raises, because its executors could not see that folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


@cache
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="commerce-marts-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def cut_lineage(df, name: str = "cut"):
    """Write ``df`` once to the shared folder and read it back, so later steps reuse the files."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df):
    """``df`` in at least as many parts as tasks run at once: one small file would leave all work on its rows to one task.

    Inputs that are split well enough already, as large ones are, are not moved.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= tasks else df.repartition(tasks)
