"""Data-quality checks. Checks are data; all checks of a table are one aggregate over it."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.money import count_if, pct
from ..functions.timeutil import AsOf, as_of_ts, seconds_between
from .joins import orphan_keys

LOG_COLUMNS = ["table_name", "check_name", "check_type", "passed", "expected_value", "actual_value", "severity", "details"]


@dataclass(frozen=True)
class Check:
    """``kind`` is completeness, uniqueness, range, freshness or reference."""

    table: str
    kind: str
    column: str
    low: float | None = None
    high: float | None = None
    parent: str | None = None
    parent_column: str | None = None


# The check suite with its bounds.
SUITE = [
    Check("dim_customers", "completeness", "email", 1.0),
    Check("dim_customers", "completeness", "name", 1.0),
    Check("dim_customers", "uniqueness", "email"),
    Check("dim_customers", "range", "total_spent", 0, 1000000),
    Check("dim_products", "completeness", "sku", 1.0),
    Check("dim_products", "completeness", "name", 1.0),
    Check("dim_products", "uniqueness", "sku"),
    Check("dim_products", "range", "price", 0.01, 100000),
    Check("dim_products", "range", "stock", 0, 100000),
    Check("fact_orders", "completeness", "order_number", 1.0),
    Check("fact_orders", "completeness", "total_amount", 1.0),
    Check("fact_orders", "uniqueness", "order_number"),
    Check("fact_orders", "range", "total_amount", 0, 1000000),
    Check("fact_order_items", "range", "quantity", 1, 1000),
    Check("fact_order_items", "range", "unit_price", 0.01, 100000),
    Check("fact_orders", "reference", "user_id", parent="dim_customers", parent_column="id"),
    Check("fact_order_items", "reference", "order_id", parent="fact_orders", parent_column="id"),
    Check("fact_order_items", "reference", "product_id", parent="dim_products", parent_column="id"),
    Check("sales_daily", "completeness", "created_at", 1.0),
    Check("sales_daily", "range", "total_revenue", 0, 10000000),
    Check("sales_daily", "range", "cancellation_rate", 0, 100),
    Check("customer_360", "completeness", "rfm_segment", 0.95),
    Check("customer_360", "range", "churn_risk_score", 0, 1),
    Check("inventory_analytics", "range", "days_of_inventory", 0, 1000),
]


def _number(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


def _result(check: Check, name: str, passed: Column, expected: str | Column, actual: Column, failed_severity: str, details: Column) -> Column:
    return F.struct(
        F.lit(check.table).alias("table_name"), F.lit(name).alias("check_name"), F.lit(check.kind).alias("check_type"), passed.alias("passed"),
        (F.lit(expected) if isinstance(expected, str) else expected).alias("expected_value"), actual.alias("actual_value"),
        F.when(passed, "low").otherwise(failed_severity).alias("severity"), details.alias("details"),
    )


def _measures(check: Check, n: int) -> list[Column]:
    c = F.col(check.column)
    if check.kind == "completeness":
        return [F.count(c).alias(f"m{n}")]
    if check.kind == "range":
        return [count_if((c < check.low) | (c > check.high)).alias(f"m{n}")]
    if check.kind == "freshness":
        return [F.max(c).alias(f"m{n}")]
    return []


def run_table(df: DataFrame, checks: list[Check], as_of: AsOf | None = None) -> DataFrame:
    """Completeness, uniqueness, range and freshness checks of one table in one scan.

    Distinct counts get an aggregate of their own: mixed with other measures they would expand
    every row once per column.
    """
    measures = [F.count(F.lit(1)).alias("total")]
    rows = []
    total = F.col("total")
    unique = []
    for n, check in enumerate(checks):
        measures += _measures(check, n)
        m = F.col(f"m{n}")
        if check.kind == "completeness":
            share = F.coalesce(F.try_divide(m, total), F.lit(0.0))
            details = F.concat(m.cast("string"), F.lit("/"), total.cast("string"), F.lit(" non-null values"))
            rows.append(_result(check, f"{check.column}_completeness", share >= check.low, f">={_number(check.low * 100)}%",
                                F.format_string("%.2f%%", share * 100), "high", details))
        elif check.kind == "range":
            rows.append(_result(check, f"{check.column}_range", m == 0, f"[{_number(check.low)}, {_number(check.high)}]",
                                F.concat(m.cast("string"), F.lit(" out of range")), "high", F.lit(None).cast("string")))
        elif check.kind == "freshness":
            hours = seconds_between(m, as_of_ts(as_of)) / 3600
            rows.append(_result(check, f"{check.column}_freshness", F.coalesce(hours <= check.high, F.lit(False)), f"<={_number(check.high)}h",
                                F.format_string("%.1fh delay", hours), "medium", F.lit(None).cast("string")))
        elif check.kind == "uniqueness":
            unique.append(check)
    parts = []
    if rows:
        parts.append(df.agg(*measures).select(F.explode(F.array(*rows)).alias("r")).select("r.*"))
    for check in unique:
        copies = df.groupBy(check.column).agg(F.count(F.lit(1)).alias("n"))
        one = copies.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("d"))
        d = F.col("d")
        details = F.when(total == d, "All unique").otherwise(F.concat((total - d).cast("string"), F.lit(" duplicates found")))
        row = _result(check, f"{check.column}_uniqueness", total == d, F.concat(total.cast("string"), F.lit(" distinct")),
                      F.concat(d.cast("string"), F.lit(" distinct")), "critical", details)
        parts.append(one.select(row.alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def run_reference(child: DataFrame, parent: DataFrame, check: Check) -> DataFrame:
    orphans = orphan_keys(child, check.column, parent, check.parent_column).agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    details = F.lit(f"Foreign key {check.column} references {check.parent}.{check.parent_column}")
    row = _result(check, f"fk_{check.column}_integrity", n == 0, "0 orphans", F.concat(n.cast("string"), F.lit(" orphans")), "critical", details)
    return orphans.select(row.alias("r")).select("r.*").withColumn("check_type", F.lit("referential_integrity"))


def run_suite(tables: dict[str, DataFrame], checks: list[Check] = SUITE, as_of: AsOf | None = None) -> DataFrame:
    """All checks as one log frame; every table is aggregated once, each reference is one anti-join."""
    parts = []
    for name in dict.fromkeys(c.table for c in checks):
        own = [c for c in checks if c.table == name and c.kind != "reference"]
        if own:
            parts.append(run_table(tables[name], own, as_of))
    for c in checks:
        if c.kind == "reference":
            parts.append(run_reference(tables[c.table], tables[c.parent], c))
    return reduce(lambda a, b: a.unionByName(b), parts)


def stamped(log: DataFrame, as_of: AsOf) -> DataFrame:
    """The log with check time and execution date, ready to append."""
    return log.withColumns({"check_timestamp": as_of_ts(as_of), "execution_date": as_of_ts(as_of).cast("date").cast("string")})


def staging_checks(fact_orders: DataFrame, fact_items: DataFrame, dim_customers: DataFrame, dim_products: DataFrame) -> DataFrame:
    """Five staging checks with a message each."""
    def line(one, name, passed, message):
        return one.select(F.lit(name).alias("check_name"), passed.alias("passed"), message.alias("message"))

    n = F.col("n")
    copies = fact_orders.groupBy("order_number").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").agg(F.count(F.lit(1)).alias("n"))
    with_items = fact_items.select("order_id").distinct().agg(F.count(F.lit(1)).alias("n"))
    orders = fact_orders.agg(F.count(F.lit(1)).alias("t"), count_if(F.col("total_amount") < 0).alias("n"))
    segments = dim_customers.agg(count_if(F.col("customer_segment").isNull()).alias("n"))
    categories = dim_products.agg(count_if(F.col("category").isNull()).alias("n"))
    from .onerow import beside

    text = n.cast("string")
    frames = [
        line(copies, "Duplicate Orders", n == 0, F.concat(F.lit("Found "), text, F.lit(" duplicates"))),
        line(beside(with_items, orders.select("t")), "Orders with Items", n > 0, F.concat(text, F.lit("/"), F.col("t").cast("string"), F.lit(" orders have items"))),
        line(orders, "No Negative Amounts", n == 0, F.concat(F.lit("Found "), text, F.lit(" negative amounts"))),
        line(segments, "Customer Segments", n == 0, F.concat(text, F.lit(" customers without segment"))),
        line(categories, "Product Categories", n == 0, F.concat(text, F.lit(" products without category"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), frames)


def table_summary(log: DataFrame) -> DataFrame:
    """Checks, passes, failures and pass rate per table and in total (table NULL)."""
    return log.rollup("table_name").agg(
        F.count(F.lit(1)).alias("total_checks"), count_if(F.col("passed")).alias("passed"), count_if(~F.col("passed")).alias("failed"),
        count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("critical_failures"),
    ).withColumn("pass_rate", F.round(pct("passed", "total_checks"), 2))


def quality_score(log: DataFrame) -> DataFrame:
    """One row: score and PASS, WARNING or FAIL."""
    df = log.agg(
        F.count(F.lit(1)).alias("total_checks"), count_if(F.col("passed")).alias("passed_checks"), count_if(~F.col("passed")).alias("failed_checks"),
        count_if(~F.col("passed") & (F.col("severity") == "critical")).alias("critical_failures"),
    ).withColumn("quality_score", F.coalesce(F.round(pct("passed_checks", "total_checks"), 2), F.lit(0.0)))
    score = F.col("quality_score")
    status = F.when((score >= 95) & (F.col("critical_failures") == 0), "PASS").when(score >= 90, "WARNING").otherwise("FAIL")
    return df.withColumn("status", status)


def quality_alerts(log: DataFrame) -> DataFrame:
    """Failed checks of critical or high severity with their alert line."""
    bad = log.filter(~F.col("passed") & F.col("severity").isin("critical", "high"))
    text = F.concat(F.lit("• "), "table_name", F.lit("."), "check_name", F.lit(": "), "actual_value", F.lit(" ("), "severity", F.lit(")"))
    return bad.select("table_name", "check_name", "severity", "actual_value", text.alias("alert"))


def _all(flags: dict[str, Column], df: DataFrame) -> DataFrame:
    return df.agg(*[F.coalesce(F.bool_and(c), F.lit(True)).alias(n) for n, c in flags.items()])


def curated_report(daily: DataFrame, c360: DataFrame, inventory: DataFrame) -> DataFrame:
    """Three all-rows checks over curated tables with score and status."""
    from .onerow import beside

    row = beside(
        _all({"sales": F.coalesce(F.col("total_revenue"), F.lit(0.0)) > 0}, daily),
        _all({"segments": F.coalesce(F.col("rfm_segment"), F.lit("")) != ""}, c360),
        _all({"stock": F.coalesce(F.col("stock_status"), F.lit("")) != ""}, inventory),
    )
    return _scored(row, ["sales", "segments", "stock"], 90)


def file_report(series: DataFrame) -> DataFrame:
    """Non-negative revenue and orders, dates present; WARNING from 80."""
    row = _all({"revenue": F.col("revenue") >= 0, "orders": F.col("orders") >= 0, "dates": F.col("date").isNotNull()}, series)
    return _scored(row, ["revenue", "orders", "dates"], 80)


def _scored(row: DataFrame, checks: list[str], warn_from: float) -> DataFrame:
    passed = reduce(lambda a, b: a + b, [F.col(c).cast("int") for c in checks])
    df = row.select(F.lit(len(checks)).alias("total_checks"), passed.alias("passed_checks"))
    df = df.withColumns({"failed_checks": F.col("total_checks") - F.col("passed_checks"), "quality_score": F.round(pct("passed_checks", "total_checks"), 2)})
    score = F.col("quality_score")
    return df.withColumn("status", F.when(score >= 95, "PASS").when(score >= warn_from, "WARNING").otherwise("FAIL"))


class QualityGateError(RuntimeError):
    """Raised when the quality gate stops a run."""


def gate(log: DataFrame, stop: bool = True) -> dict:
    """Read the one-row score; raise on FAIL when ``stop`` is set, else hand the score back."""
    score = quality_score(log).first().asDict()
    if stop and score["status"] == "FAIL":
        raise QualityGateError(f"quality score {score['quality_score']}, {score['critical_failures']} critical failures")
    return score


def sufficiency(series: DataFrame, keys: list[str], value: str = "revenue", minimum: dict[str, int] | None = None) -> DataFrame:
    """Per series: enough points for each method and any positive value?"""
    # Fewest points per method.
    minimum = minimum or {"seasonal": 7, "autoregressive": 7, "sequence": 14}
    stats = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("points"), F.coalesce(F.bool_or(F.col(value) != 0), F.lit(False)).alias("any_value"))
    return stats.withColumns({f"{name}_ok": (F.col("points") >= n) & F.col("any_value") for name, n in minimum.items()})
