"""Money and ratio expressions.

Money is summed in whole cents (or finer units) as long integers, so a total is exact and does not
depend on the order in which partitions are merged. Longs keep such sums in fixed-size aggregation
buffers; they hold totals up to 92 quadrillion and raise on overflow. Results come back as double.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CENTS = 100
MILLS = 10_000
FINE = "decimal(20,8)"


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def in_units(c: str | Column, scale: int) -> Column:
    return F.rint(as_col(c).cast("double") * scale).cast("bigint")


def money_sum(c: str | Column, scale: int | str = CENTS) -> Column:
    """Exact sum of amounts given in whole units of 1 / ``scale``, or of a decimal type."""
    if isinstance(scale, str):
        return F.sum(as_col(c).cast(scale)).cast("double")
    return units_sum(in_units(c, scale), scale)


def units_sum(c: str | Column, scale: int) -> Column:
    """Sum of whole units of 1 / ``scale`` as an amount."""
    return F.sum(as_col(c)).cast("double") / F.lit(float(scale))


def money_sum_if(cond: Column, c: str | Column, scale: int | str = CENTS) -> Column:
    """Sum of ``c`` over rows where ``cond`` holds; 0 when there are none."""
    return F.coalesce(money_sum(F.when(cond, as_col(c)), scale), F.lit(0.0))


def money_avg(c: str | Column, scale: int | str = CENTS) -> Column:
    return ratio(money_sum(c, scale), F.count(as_col(c)))


def ratio(num: str | Column, den: str | Column) -> Column:
    """``num / den``, NULL when the divisor is 0."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def pct(num: str | Column, den: str | Column) -> Column:
    return ratio(num, den) * 100


def growth_pct(now: str | Column, before: str | Column) -> Column:
    return ratio(as_col(now) - as_col(before), before) * 100


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def some_of(*flags: tuple[Column, Column]) -> Column:
    """Array of the values whose condition holds, in the given order.

    Built from slices of one-element arrays, which stay in generated code and may use subqueries.
    """
    parts = [F.slice(F.array(F.when(cond, value)), F.lit(1), F.when(cond, 1).otherwise(0)) for cond, value in flags]
    return F.concat(*parts)
