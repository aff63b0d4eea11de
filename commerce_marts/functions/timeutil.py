"""Date and time expressions. No wall clock: every age is measured against an ``as_of`` value."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import as_col

AsOf = dt.date | dt.datetime | str | Column


def as_of_ts(as_of: AsOf) -> Column:
    """``as_of`` as a timestamp column; a Column, such as a scalar subquery, passes through."""
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")


def interval(days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return F.make_dt_interval(F.lit(days), F.lit(hours), F.lit(minutes), F.lit(0))


def ago(as_of: AsOf, days: int = 0, hours: int = 0, minutes: int = 0) -> Column:
    return as_of_ts(as_of) - interval(days, hours, minutes)


def since(ts: str | Column, as_of: AsOf, **span: int) -> Column:
    """``ts`` lies at or after ``as_of`` minus the span."""
    return as_col(ts) >= ago(as_of, **span)


def day(ts: str | Column) -> Column:
    return as_col(ts).cast("date")


def seconds_between(start: str | Column, end: str | Column) -> Column:
    return F.timestamp_diff("SECOND", as_col(start), as_col(end))


def whole_days(start: str | Column, end: str | Column) -> Column:
    """Full 24-hour days from ``start`` to ``end``, rounded down."""
    return F.floor(seconds_between(start, end) / 86400)


def epoch_seconds(ts: str | Column) -> Column:
    return F.unix_seconds(as_col(ts).cast("timestamp"))


def is_weekend(ts: str | Column) -> Column:
    return F.dayofweek(as_col(ts)).isin(1, 7)


def date_parts(ts: str | Column, prefix: str = "") -> dict[str, Column]:
    """year, month, day, quarter, ISO week, weekday and weekend flag of a timestamp."""
    c = as_col(ts)
    return {
        f"{prefix}year": F.year(c),
        f"{prefix}month": F.month(c),
        f"{prefix}day": F.dayofmonth(c),
        f"{prefix}quarter": F.quarter(c),
        f"{prefix}week": F.weekofyear(c),
        f"{prefix}weekday": F.dayofweek(c),
        f"{prefix}is_weekend": is_weekend(c),
    }


def iso_year(ts: str | Column) -> Column:
    return F.expr("extract(YEAROFWEEK FROM {})".format(ts)) if isinstance(ts, str) else F.year(
        F.date_add(F.date_trunc("week", ts).cast("date"), 3)
    )


def calendar(spark, start: AsOf, days: int, name: str = "date"):
    """One row per day: ``start`` and the ``days - 1`` days after it."""
    first = as_of_ts(start).cast("date")
    one = spark.range(1).select(F.sequence(first, F.date_add(first, days - 1)).alias("d"))
    return one.select(F.explode("d").alias(name))
