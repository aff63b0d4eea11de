"""Bands, tiers and flags: one expression per business label."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .money import as_col


def banded(value: str | Column, steps: list[tuple[float, object]], default, op: str = "gt") -> Column:
    """First label whose threshold the value passes; ``op`` is gt, ge, lt or le."""
    c = as_col(value)
    out = None
    for limit, label in steps:
        test = {"gt": c > limit, "ge": c >= limit, "lt": c < limit, "le": c <= limit}[op]
        out = F.when(test, F.lit(label)) if out is None else out.when(test, F.lit(label))
    return out.otherwise(F.lit(default))


def keyed(value: str | Column, labels: dict, default=None) -> Column:
    """Label of an exact value."""
    c = as_col(value)
    out = None
    for key, label in labels.items():
        out = F.when(c == key, F.lit(label)) if out is None else out.when(c == key, F.lit(label))
    return out.otherwise(F.lit(default))


def customer_tier(spend: str | Column = "total_spent") -> Column:
    return banded(spend, [(10000, "VIP"), (5000, "Gold"), (1000, "Silver")], "Bronze")


def stock_status(stock: str | Column = "stock") -> Column:
    return F.when(as_col(stock) == 0, "Out of Stock").otherwise(
        banded(stock, [(10, "Low Stock"), (50, "Medium Stock")], "In Stock", "lt")
    )


def sales_band(units: str | Column = "total_sold") -> Column:
    return banded(units, [(100, "High"), (20, "Medium")], "Low")


def sla_days(status: str | Column = "status") -> Column:
    return keyed(status, {"Delivered": 3, "Shipped": 2, "Processing": 5})


def severity_score(priority: str | Column = "priority") -> Column:
    return keyed(priority, {"Critical": 4, "High": 3, "Medium": 2}, 1)


def requires_followup(sentiment: str | Column = "sentiment", status: str | Column = "status") -> Column:
    return (as_col(sentiment) == "negative") & (as_col(status) != "Closed")


def priority_rank(priority: str | Column = "priority") -> Column:
    return keyed(priority, {"High": 1, "Medium": 2, "Low": 3}, 4)


def stock_alert(stock: str | Column = "stock", days: str | Column = "days_of_inventory") -> Column:
    return F.when(as_col(stock) == 0, "OUT_OF_STOCK").otherwise(
        banded(days, [(7, "CRITICAL"), (14, "LOW"), (30, "MODERATE")], "HEALTHY", "lt")
    )


def abc_class(share: str | Column = "cumulative_revenue_pct") -> Column:
    return banded(share, [(0.8, "A"), (0.95, "B")], "C", "le")


def rfm_segment(r: str | Column = "r_score", f: str | Column = "f_score", m: str | Column = "m_score") -> Column:
    r, f, m = as_col(r), as_col(f), as_col(m)
    return (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when((r >= 3) & (f >= 3) & (m >= 3), "Loyal Customers")
        .when((r >= 4) & (f <= 2), "New Customers")
        .when((r <= 2) & (f >= 3), "At Risk")
        .when((r <= 2) & (f <= 2), "Lost Customers")
        .otherwise("Potential Loyalists")
    )


def churn_score(recency: str | Column = "recency", segment: str | Column = "rfm_segment") -> Column:
    """Branch order matters: age first, then segment. A customer without orders has no score."""
    age = as_col(recency)
    return (
        F.when(age.isNull(), F.lit(None).cast("double"))
        .when(age > 60, 0.9)
        .when(age > 30, 0.6)
        .when(as_col(segment).isin("At Risk", "Lost Customers"), 0.8)
        .otherwise(0.1)
    )


def churn_band(score: str | Column = "churn_risk_score") -> Column:
    return F.when(as_col(score).isNull(), "No Orders").otherwise(
        banded(score, [(0.7, "High Risk"), (0.4, "Medium Risk")], "Low Risk", "ge")
    )


def performance_tier(revenue="total_revenue", margin="profit_margin_pct", units="units_sold") -> Column:
    revenue, margin, units = as_col(revenue), as_col(margin), as_col(units)
    return (
        F.when((revenue > 50000) & (margin > 30), "Star")
        .when((revenue > 20000) & (margin > 20), "Strong")
        .when(revenue > 5000, "Average")
        .when(units > 0, "Weak")
        .otherwise("No Sales")
    )


def segment_priority(segment: str | Column = "rfm_segment") -> Column:
    order = ["Champions", "Loyal Customers", "Potential Loyalists", "New Customers", "At Risk"]
    return keyed(segment, {name: i + 1 for i, name in enumerate(order)}, 6)


def stock_alert_priority(alert: str | Column = "stock_alert") -> Column:
    return keyed(alert, {"OUT_OF_STOCK": 1, "CRITICAL": 2, "LOW": 3, "MODERATE": 4}, 5)


def time_of_day(hour: str | Column) -> Column:
    h = as_col(hour)
    return (
        F.when(h.isNull(), "unknown")
        .when((h >= 6) & (h < 12), "morning")
        .when((h >= 12) & (h < 17), "afternoon")
        .when((h >= 17) & (h < 21), "evening")
        .otherwise("night")
    )


def price_sensitivity(aov: str | Column) -> Column:
    c = as_col(aov)
    return F.when(c.isNull(), "unknown").otherwise(
        banded(c, [(1000, "budget_conscious"), (3000, "moderate_spender")], "premium_shopper", "lt")
    )


def delivery_base_days(state: str | Column = "state") -> Column:
    low = F.lower(as_col(state))

    def any_of(names):
        test = low.contains(names[0])
        for name in names[1:]:
            test = test | low.contains(name)
        return test

    return (
        F.when(any_of(fv.METRO_STATES), fv.REGION_DAYS["metro"])
        .when(any_of(fv.TIER1_STATES), fv.REGION_DAYS["tier1"])
        .otherwise(fv.REGION_DAYS["default"])
    )
