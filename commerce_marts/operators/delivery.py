"""Delivery estimates, delay flags, notifications and order texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import labels
from ..functions.money import as_col, some_of
from ..functions.timeutil import AsOf, as_of_ts, whole_days
from .ordered import top_n


def delivery_eta() -> Column:
    """Created plus days by region and status; delivered orders take the fixed span, cancelled ones none."""
    status = F.col("status")
    by_status = F.coalesce(labels.keyed("status", fv.STATUS_DAYS), F.lit(0))
    days = F.when(status == "Delivered", fv.STATUS_DAYS["Delivered"]).otherwise(labels.delivery_base_days() + by_status)
    return F.when(status != "Cancelled", F.col("created_at") + F.make_dt_interval(days))


def delivery_risk(orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Estimate, delay and risk flags with the reason; finished orders carry no flags."""
    now = as_of_ts(as_of)
    df = orders.withColumns({"estimated_delivery": delivery_eta(), "_open": ~F.col("status").isin("Delivered", "Cancelled"), "_now": now})
    late = F.col("_open") & (F.col("_now") > F.col("estimated_delivery"))
    left = whole_days("_now", "estimated_delivery")
    risky = F.col("_open") & ~late & (left < 2) & (F.col("status") != "Out for Delivery")
    reason = F.when(late, labels.keyed("status", fv.DELAY_REASONS, fv.DEFAULT_DELAY_REASON)).when(risky, "Order is taking longer than expected")
    return df.withColumns(
        {
            "is_delayed": F.when(F.col("_open"), late), "at_risk": F.when(F.col("_open"), risky),
            "delay_days": F.when(late, whole_days("estimated_delivery", "_now")), "delay_reason": reason,
        }
    ).drop("_open", "_now")


def order_notifications(orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Notifications per order, one row each."""
    df = delivery_risk(orders, as_of).withColumn("_age", whole_days("created_at", as_of_ts(as_of)))

    def note(kind, priority, message, action):
        act = F.lit(action) if action else F.lit(None).cast("string")
        return F.struct(F.lit(kind).alias("type"), F.lit(priority).alias("priority"), message.alias("message"), act.alias("action"))

    num, status = F.col("order_number"), F.col("status")
    keep = (status == "Delivered") & (F.col("return_status") == "Not Requested") & (F.col("_age") >= 5)
    found = some_of(
        (F.col("is_delayed"), note("delay", "high", F.format_string("Order %s is delayed by %d days", num, F.col("delay_days")), "Contact support")),
        (F.col("at_risk"), note("at_risk", "medium", F.format_string("Order %s may be delayed", num), "Track order")),
        (status == "Shipped", note("shipped", "low", F.format_string("Order %s has been shipped", num), "Track delivery")),
        (status == "Out for Delivery", note("out_for_delivery", "low", F.format_string("Order %s is out for delivery", num), None)),
        (keep, note("return_reminder", "low", F.format_string("Return window for order %s closes in %d days", num, 7 - F.col("_age")), "View order")),
    )
    return df.select("id", "user_id", "created_at", F.inline(found))


def user_notifications(notifications: DataFrame, n: int = 10) -> DataFrame:
    """The first ``n`` notifications of every user by priority, oldest order first."""
    rank = labels.keyed("priority", {"high": 0, "medium": 1, "low": 2}, 3)
    return top_n(notifications, ["user_id"], [rank, F.asc("id"), F.asc("type")], n, rank="rank")


def order_insights(orders: DataFrame, items: DataFrame, products: DataFrame, as_of: AsOf) -> DataFrame:
    """Estimate, advice list, line count and categories of every order."""
    typed = items.select("order_id", "product_id").join(products.select(F.col("id").alias("product_id"), "category"), "product_id", "left")
    parts = typed.groupBy(F.col("order_id").alias("id")).agg(
        F.count(F.lit(1)).alias("total_items"), F.array_sort(F.collect_set("category")).alias("categories")
    )
    df = delivery_risk(orders, as_of).join(parts, "id", "left")
    done = (F.col("status") == "Delivered") & (F.col("return_status") == "Not Requested")
    advice = some_of(
        (F.col("is_delayed"), F.lit("Your order is delayed. Contact support for urgent assistance.")),
        (F.col("is_delayed"), F.format_string("Expected delay: %d days", "delay_days")),
        (F.col("status") == "Shipped", F.lit("Track your package using the tracking ID for real-time updates")),
        (done, F.lit("Rate your purchase experience")),
        (done, F.lit("Return window: 7 days from delivery date")),
    )
    hint = F.when(F.size("categories") > 0, F.concat(F.lit("Explore more "), F.get("categories", F.lit(0)), F.lit(" items")))
    return df.select(
        "id", "order_number", "status", "created_at", "estimated_delivery", "is_delayed", "delay_days", advice.alias("recommendations"),
        F.coalesce("total_items", F.lit(0)).alias("total_items"), "categories", hint.alias("suggestion"),
    )


def order_timeline(status: str | Column = "status") -> Column:
    """Steps of an order with done and active flags; an unknown status counts as the first step."""
    steps = F.array(*[F.lit(x) for x in fv.ORDER_TIMELINE])
    at = F.greatest(F.array_position(steps, as_col(status)), F.lit(1)) - 1
    return F.transform(steps, lambda x, i: F.struct(x.alias("label"), (i <= at).alias("done"), (i == at).alias("active")))


def invoice_text(orders: DataFrame, items: DataFrame, title: str = "STORE INVOICE") -> DataFrame:
    """Invoice as text, one row for each order, its lines in product order. Amounts are rounded to whole units, halves up."""
    whole = lambda c: F.round(c, 0).cast("bigint").cast("string")
    amount = whole(F.col("unit_price") * F.col("quantity"))
    line = F.concat(F.lit("- "), "product_name", F.lit(" | Size: "), "size", F.lit(" | Qty: "), F.col("quantity").cast("string"), F.lit(" | Amount: ₹"), amount)
    listed = items.select(F.col("order_id").alias("id"), F.struct("product_id", "quantity", "size", line.alias("text")).alias("l"))
    blocks = listed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("l")), lambda x: x["text"]), "\n").alias("lines"))
    df = orders.join(blocks, "id", "left")

    def row(label, c):
        return F.concat(F.lit(label + ": "), c)

    place = F.concat("address", F.lit(", "), "city", F.lit(", "), "state", F.lit(" - "), "pincode")
    text = F.concat_ws(
        "\n", F.lit(title), row("Order Number", F.col("order_number")), row("Tracking ID", F.col("tracking_id")), row("Customer", F.col("customer_name")),
        row("Phone", F.col("phone")), row("Address", place), row("Status", F.col("status")), row("Payment Method", F.col("payment_method")),
        row("Payment Status", F.col("payment_status")), F.lit(""), F.lit("Items:"), "lines", F.lit(""),
        F.concat(F.lit("Total Amount: ₹"), whole(F.col("total_amount"))),
    )
    return df.select("id", text.alias("invoice"))


