"""Velocity of users in several windows at once, with keyed state.

A first aggregation counts rows by user and minute and hands a minute on when the watermark has passed its end, so
a busy user costs one row a minute. The keyed operator behind it keeps the minutes of a user that the longest
window can still reach, and tells for each new minute which windows that end with it hold too many rows. A
timer clears users who have been silent for as long as the longest window.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .streams import with_event_time

#: Minutes of a window and the number of rows that is too many.
LIMITS = ((5, 3), (15, 5), (60, 10), (1440, 30))
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trailing_counts(minutes: list[int], counts: list[int], fresh: set[int], limits=LIMITS) -> Iterator[tuple[int, int, int]]:
    """(window, minute, rows) of each fresh minute and window with too many rows. ``minutes`` are sorted.

    A window of w minutes that ends with minute m covers the minutes from m - w + 1 to m.
    """
    for size, limit in limits:
        total, first = 0, 0
        for at, minute in enumerate(minutes):
            total += counts[at]
            while minutes[first] <= minute - size:
                total -= counts[first]
                first += 1
            if minute in fresh and total >= limit:
                yield size, minute, total


class MinuteCounts(StatefulProcessor):
    """Keeps the recent minutes of a user; rows come with ``minute`` (since 1970) and ``n``."""

    def __init__(self, limits=LIMITS) -> None:
        self.limits, self.reach = limits, max(size for size, _ in limits)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getValueState("recent", "minutes array<bigint>, counts array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        held = self.recent.get() if self.recent.exists() else ([], [])
        by_minute = dict(zip(held[0], held[1], strict=True))
        fresh = set()
        for row in rows:
            fresh.add(row["minute"])
            by_minute[row["minute"]] = by_minute.get(row["minute"], 0) + row["n"]
        minutes = sorted(by_minute)
        found = [Row(user_id=key[0], window_minutes=size, end_minute=minute + 1, n=n) for size, minute, n in trailing_counts(minutes, [by_minute[m] for m in minutes], fresh, self.limits)]
        kept = [m for m in minutes if m > minutes[-1] - self.reach]
        self.recent.update((kept, [by_minute[m] for m in kept]))
        self.handle.registerTimer((minutes[-1] + self.reach) * 60_000)
        yield from found

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        # An earlier timer of a user who came back finds newer minutes and leaves them.
        if self.recent.exists() and (self.recent.get()[0][-1] + self.reach) * 60_000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.recent.clear()
        yield from ()

    def close(self) -> None:
        pass


def velocity_windows(df: DataFrame, ts: str, limits=LIMITS, delay: str = "1 hour") -> DataFrame:
    """user_id, window_minutes, end, n: minutes with rows of a user in which a window that ends there holds too many.

    ``df`` is a stream. Rows later than ``delay`` are dropped; a null user is a user. Sets the session's state store
    to the one that keyed state needs; queries that run from a checkpoint keep their own.
    """
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    counts = with_event_time(df, ts, delay).groupBy(F.window(ts, "1 minute"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    minutes = counts.select("user_id", F.window_time("window").alias("at"), (F.unix_timestamp("window.start") / 60).cast("bigint").alias("minute"), "n")
    schema = f"user_id {df.schema['user_id'].dataType.simpleString()}, window_minutes int, end_minute bigint, n bigint"
    found = minutes.groupBy("user_id").transformWithState(MinuteCounts(limits), schema, "Append", "EventTime")
    return found.select("user_id", "window_minutes", F.timestamp_seconds(F.col("end_minute") * 60).alias("end"), "n")
