"""One-row frames: totals and statistics that every row is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def beside(df: DataFrame, *stats: DataFrame) -> DataFrame:
    """Add the columns of one-row frames to every row.

    Each frame is an aggregate without keys, so it has exactly one row and is sent to the tasks as
    such; ``df`` itself is not shuffled.
    """
    for one in stats:
        df = df.join(F.broadcast(one), how="inner")
    return df
