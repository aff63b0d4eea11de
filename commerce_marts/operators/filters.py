"""Filtered list views and flag filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import labels
from ..functions.money import count_if, money_sum
from ..functions.timeutil import AsOf, as_of_ts, since
from .ordered import top_n


def any_like(columns: list[str], text: str) -> Column:
    """Case-insensitive substring match on any of the columns; wildcards in the text are literal."""
    safe = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(lambda a, b: a | b, [F.ilike(F.col(c), F.lit(f"%{safe}%")) for c in columns])


def filter_products(products: DataFrame, category: str | None = None, search: str | None = None, stock_status: str | None = None) -> DataFrame:
    """Products by category, name or SKU text and stock state, newest first."""
    out = products
    if category:
        out = out.filter(F.col("category") == category)
    if search:
        out = out.filter(any_like(["name", "sku"], search))
    states = {"low": F.col("stock") < 10, "out": F.col("stock") == 0, "in": F.col("stock") > 0}
    if stock_status in states:
        out = out.filter(states[stock_status])
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def filter_orders(orders: DataFrame, status: str | None = None, date_from: str | None = None, date_to: str | None = None, whole_last_day: bool = True) -> DataFrame:
    """Orders by status and date range. A date that does not parse is ignored.

    The last day counts in full unless ``whole_last_day`` is off; then the range ends at its midnight.
    """
    out = orders
    if status:
        out = out.filter(F.col("status") == status)

    def parsed(text):
        return F.to_timestamp_ntz(F.try_to_timestamp(F.lit(text), F.lit("yyyy-MM-dd")).cast("string"))

    if date_from:
        low = parsed(date_from)
        out = out.filter(low.isNull() | (F.col("created_at") >= low))
    if date_to:
        high = parsed(date_to)
        inside = F.col("created_at") < high + F.expr("interval 1 day") if whole_last_day else F.col("created_at") <= high
        out = out.filter(high.isNull() | inside)
    return out.orderBy(F.desc("created_at"), F.desc("id"))


def filter_tickets(tickets: DataFrame, status: str | None = None, priority: str | None = None) -> DataFrame:
    """Tickets in priority order, newest first inside a priority."""
    out = tickets
    if status:
        out = out.filter(F.col("status") == status)
    if priority:
        out = out.filter(F.col("priority") == priority)
    return out.orderBy(labels.priority_rank(), F.desc("created_at"), F.desc("id"))


def search_customers(users: DataFrame, orders: DataFrame, search: str | None = None) -> DataFrame:
    """Customers matching a text, with order count and spend on paid orders."""
    found = users.filter(~F.col("is_admin"))
    if search:
        found = found.filter(any_like(["name", "email", "phone"], search))
    paid = F.col("payment_status").isin("Paid", "Completed")
    sums = orders.groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("order_count"), money_sum(F.when(paid, F.col("total_amount"))).alias("total_spent")
    )
    out = found.join(sums, "id", "left").withColumns(
        {"order_count": F.coalesce("order_count", F.lit(0)), "total_spent": F.coalesce("total_spent", F.lit(0.0))}
    )
    return out.select("id", "name", "email", "phone", "created_at", "order_count", "total_spent").orderBy(F.desc("created_at"), "id")


def audit_log_view(logs: DataFrame, user_id: int | None = None, entity_type: str | None = None, limit: int | None = 100) -> DataFrame:
    """Audit rows newest first; values parsed from JSON, NULL when blank or malformed."""
    out = logs
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    if entity_type:
        out = out.filter(F.col("entity_type") == entity_type)

    def parsed(c):
        return F.when(F.trim(c) != "", F.try_parse_json(c))

    out = out.withColumns({"old_values": parsed("old_values"), "new_values": parsed("new_values")})
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(limit) if limit else out


def live_alerts(alerts: DataFrame, as_of: AsOf, unread_only: bool = False, per_user: int | None = None) -> DataFrame:
    """Alerts that have not expired; optionally the newest ``per_user`` of each user."""
    out = alerts.filter(F.col("expires_at").isNull() | (F.col("expires_at") > as_of_ts(as_of)))
    if unread_only:
        out = out.filter(~F.col("is_read"))
    return top_n(out, ["user_id"], [F.desc("created_at"), F.desc("id")], per_user) if per_user else out


def expired_alerts(alerts: DataFrame, as_of: AsOf) -> DataFrame:
    return alerts.filter(F.col("expires_at") <= as_of_ts(as_of))


def filter_documents(documents: DataFrame, document_type: str | None = None, status: str | None = None, limit: int = 100) -> DataFrame:
    out = documents
    if document_type:
        out = out.filter(F.col("document_type") == document_type)
    if status:
        out = out.filter(F.col("status") == status)
    return out.orderBy(F.desc("created_at"), F.desc("document_id")).limit(limit)


def active_sessions(sessions: DataFrame, as_of: AsOf, hours: int = 24, n: int = 20) -> DataFrame:
    live = sessions.filter(F.col("is_active") & since("last_activity", as_of, hours=hours))
    return live.orderBy(F.desc("last_activity"), F.desc("id")).limit(n)


def shipping_queue(orders: DataFrame) -> DataFrame:
    return orders.filter(F.col("status").isin(fv.SHIPPING_QUEUE))


def shipping_counts(orders: DataFrame) -> DataFrame:
    return shipping_queue(orders).agg(
        count_if(F.col("status") == "Processing").alias("to_ship"),
        count_if(F.col("status") == "Shipped").alias("in_transit"),
        count_if(F.col("status") == "Delivered").alias("delivered"),
    )


def apply_rules(df: DataFrame, rules: list[tuple[str, str, str]], key: Column) -> DataFrame:
    """One row per (rule, key) whose condition holds, all rules in one pass. Rules are (name, condition, severity)."""
    hits = F.array(
        *[
            F.when(F.expr(cond), F.struct(F.lit(name).alias("rule"), F.lit(sev).alias("severity")))
            for name, cond, sev in rules
        ]
    )
    return df.select(key.cast("string").alias("key"), F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("hit")).select(
        "hit.rule", "hit.severity", "key"
    )


def rules_for(table: str) -> list[tuple[str, str, str]]:
    return [(name, cond, sev) for name, of, cond, sev in fv.ALERT_RULES if of == table]
