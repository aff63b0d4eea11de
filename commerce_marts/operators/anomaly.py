"""Outlier and fraud detectors.

Every detector scores rows with column expressions against one-row statistics (scalar subqueries)
and per-user or per-day counts that are aggregated first and joined back. Reasons are arrays of
texts; the first one is the main reason. All detectors share the columns of :data:`SHAPE`.

The reason texts and the points of the rules are fixed values: results must carry them as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import as_col, count_if, money_avg, money_sum, ratio, some_of
from ..functions.timeutil import AsOf, ago, as_of_ts, day, seconds_between, since, whole_days
from ..session import cut_lineage
from . import ordered
from .onerow import beside

SHAPE = ["order_number", "user_id", "type", "severity", "risk_score", "reason", "reasons", "amount", "created_at", "detection_method"]


def severity4(score: str | Column = "risk_score", steps=(70, 50, 30)) -> Column:
    c = as_col(score)
    return F.when(c >= steps[0], "critical").when(c >= steps[1], "high").when(c >= steps[2], "medium").otherwise("low")


def money_text(c: str | Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(as_col(c), 0))


def points(*rules: tuple[Column, float]) -> Column:
    """Sum of the points of all rules that hold."""
    return reduce(lambda a, b: a + b, [F.when(cond, F.lit(float(p))).otherwise(0.0) for cond, p in rules])


def first_points(*rules: tuple[Column, float]) -> Column:
    """Points of the first rule that holds."""
    out = None
    for cond, p in rules:
        out = F.when(cond, float(p)) if out is None else out.when(cond, float(p))
    return out.otherwise(0.0)


def amount_stats(orders: DataFrame, quartiles: bool = False) -> DataFrame:
    """One row with a struct ``_s``: n, mean, population deviation, bounds and optionally the indexed quartiles."""
    base = orders.agg(
        F.count(F.lit(1)).alias("n"), money_avg("total_amount").alias("mean"), F.stddev_pop("total_amount").alias("std"),
        F.min("total_amount").alias("lo"), F.max("total_amount").alias("hi"),
    )
    if quartiles:
        ranks = {"q1": ordered.index_quantile(0.25), "q3": ordered.index_quantile(0.75)}
        base = beside(base, ordered.values_at_ranks(orders, "total_amount", ranks))
    return base.select(F.struct(*base.columns).alias("_s"))


def _shaped(df: DataFrame, kind: str, method: str, *extra: str) -> DataFrame:
    return df.withColumns({"type": F.lit(kind), "detection_method": F.lit(method), "reason": F.get("reasons", F.lit(0))}).select(*SHAPE, *extra)


def order_outliers(orders: DataFrame, as_of: AsOf, days: int | None = 30) -> DataFrame:
    """Outliers by z-score with size-dependent thresholds, quartile fences and multiples of the mean.

    Orders of the last ``days`` days are judged, or all orders where ``days`` is None.
    """
    kept = orders if days is None else orders.filter(since("created_at", as_of, days=days))
    kept = beside(kept, amount_stats(kept, quartiles=True))
    s = F.col("_s")
    n, mean, std = s.getField("n"), s.getField("mean"), s.getField("std")
    spread = s.getField("q3") - s.getField("q1")
    upper, lower = s.getField("q3") + spread * 1.5, s.getField("q1") - spread * 1.5
    hard = F.when(n > 50, 2.5).when(n > 20, 1.8).otherwise(1.2)
    soft = F.when(n > 50, 1.8).when(n > 20, 1.2).otherwise(0.8)
    amount = F.col("total_amount")
    z = F.col("z_score")
    df = kept.filter(n >= 3).withColumn("z_score", ratio(amount - mean, std))
    far, near = F.abs(z) > hard, (F.abs(z) > soft) & (F.abs(z) <= hard)
    above, below = amount > upper, amount < lower
    times5, times3 = amount > mean * 5, (amount > mean * 3) & (amount <= mean * 5)
    zt = F.format_string("%.1f", F.abs(z))
    reasons = some_of(
        (far & (z > 0), F.concat(F.lit("HIGH VALUE: "), money_text(amount), F.lit(" is "), zt, F.lit("σ above average ("), money_text(mean), F.lit(")"))),
        (far & (z > 0), F.format_string("This is %.0f%% higher than typical - check for price manipulation", F.abs(amount - mean) / mean * 100)),
        (far & (z <= 0), F.concat(F.lit("LOW VALUE: "), money_text(amount), F.lit(" is "), zt, F.lit("σ below average"))),
        (far & (z <= 0), F.lit("Unusually low value may indicate testing or error")),
        (near & (z > 0), F.concat(F.lit("Elevated value: "), money_text(amount), F.lit(" ("), zt, F.lit("σ above mean)"))),
        (above, F.concat(F.lit("Order exceeds upper outlier threshold of "), money_text(upper))),
        (below, F.concat(F.lit("Order below lower outlier threshold of "), money_text(lower))),
        (times5, F.format_string("Order value is %.1fx the average - extremely high value transaction", amount / mean)),
        (times3, F.format_string("Order value is %.1fx the typical order amount", amount / mean)),
    )
    score = points((far, 35), (near, 25), (above, 25), (below, 20), (times5, 15), (times3, 10))
    df = df.withColumns({"risk_score": score, "reasons": reasons, "amount": amount}).filter(F.size("reasons") > 0)
    return _shaped(df.withColumn("severity", severity4()), "statistical", "Statistical Analysis", "z_score")


def global_zscores(daily: DataFrame, limit: float = 2.5) -> DataFrame:
    """z-score of each day against the whole series (sample deviation, floor 1); needs more than 7 days."""
    stats = daily.agg(F.count(F.lit(1)).alias("_n"), F.avg("total_revenue").alias("_m"), F.stddev_samp("total_revenue").alias("_d"))
    z = (F.col("total_revenue") - F.col("_m")) / F.greatest(F.col("_d"), F.lit(1.0))
    size = F.abs("revenue_zscore")
    return beside(daily, stats).filter("_n > 7").select("created_at", "total_revenue", "total_orders", z.alias("revenue_zscore")).withColumns(
        {"is_anomaly": size > limit, "severity": F.when(size > 3, "High").when(size > limit, "Medium").otherwise("Low")}
    )


def series_anomalies(series: DataFrame, limit: float = 2.5) -> DataFrame:
    """Rows of a (date, revenue, orders) series at ``limit`` population deviations or more."""
    stats = series.agg(F.avg("revenue").alias("_m"), F.stddev_pop("revenue").alias("_d"))
    z = F.abs(ratio(F.col("revenue") - F.col("_m"), "_d"))
    out = beside(series, stats).select("date", "revenue", "orders", z.alias("z_score")).filter(F.col("z_score") >= limit)
    return out.withColumn("severity", F.when(F.col("z_score") > 3, "High").otherwise("Medium"))


def velocity_bursts(orders: DataFrame, as_of: AsOf, windows: list[tuple[str, int, int]] = fv.BURST_WINDOWS) -> DataFrame:
    """Users with many orders shortly before ``as_of``, all windows in one aggregate."""
    widest = max(minutes for _, minutes, _ in windows)
    kept = orders.filter(since("created_at", as_of, minutes=widest) & (F.col("created_at") <= as_of_ts(as_of)))
    measures = []
    for _, minutes, _ in windows:
        inside = since("created_at", as_of, minutes=minutes)
        ts = F.when(inside, F.col("created_at"))
        measures += [
            count_if(inside).alias(f"n{minutes}"), money_sum(F.when(inside, F.col("total_amount"))).alias(f"s{minutes}"),
            F.min(ts).alias(f"f{minutes}"), F.max(ts).alias(f"l{minutes}"),
        ]
    per_user = kept.groupBy("user_id").agg(*measures)
    rows = [
        F.when(
            F.col(f"n{m}") >= limit,
            F.struct(
                F.lit(name).alias("time_window"), F.lit(limit).alias("threshold"), F.col(f"n{m}").alias("order_count"),
                F.col(f"s{m}").alias("total_spent"), F.col(f"f{m}").alias("first_order"), F.col(f"l{m}").alias("last_order"),
            ),
        )
        for name, m, limit in windows
    ]
    hits = per_user.select("user_id", F.inline(F.filter(F.array(*rows), lambda x: x.isNotNull())))
    return score_bursts(hits)


def score_bursts(hits: DataFrame) -> DataFrame:
    """Rate, spend and severity of (user, window) order bursts."""
    n, spent = F.col("order_count"), F.col("total_spent")
    minutes = F.greatest(seconds_between("first_order", "last_order") / 60, F.lit(1.0))
    df = hits.withColumn("order_rate", n / minutes)
    rate = F.col("order_rate")
    score = F.least(n * 3, F.lit(60)) + first_points((rate > 2, 20), (rate > 1, 10)) + first_points((spent > 50000, 25), (spent > 20000, 15))
    reasons = some_of(
        (n > 0, F.concat(F.lit("User placed "), n.cast("string"), F.lit(" orders within "), F.col("time_window"))),
        (rate > 2, F.format_string("Bot-like activity detected: %.1f orders per minute", rate)),
        (rate > 2, F.lit("Pattern suggests automated ordering system or script")),
        ((rate > 1) & (rate <= 2), F.format_string("Unusually fast ordering: %.1f orders per minute", rate)),
        (spent > 50000, F.concat(F.lit("High-value burst activity: "), money_text(spent), F.lit(" spent in "), F.col("time_window"))),
        (spent > 50000, F.lit("Rapid high-value transactions may indicate stolen payment method testing")),
        ((spent > 20000) & (spent <= 50000), F.concat(F.lit("Significant spending: "), money_text(spent), F.lit(" in short period"))),
        (n > F.col("threshold") * 2, F.format_string("Activity level is %.1fx above normal threshold", n / F.col("threshold"))),
    )
    df = df.withColumns({"risk_score": score, "reasons": reasons})
    grade = F.when(F.col("risk_score") >= 70, "critical").when(F.col("risk_score") >= 50, "high").otherwise("medium")
    return _shaped(
        df.withColumns({"severity": grade, "order_number": F.lit(None).cast("string"), "amount": spent, "created_at": F.col("last_order")}),
        "velocity", "Velocity Analysis", "time_window", "order_count", "total_spent", "order_rate", "first_order", "last_order",
    )


def cancellation_risk(orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Risk of every cancelled order from its age, the user's habit, value and same-day cancellations."""
    now = as_of_ts(as_of)
    is_cancelled = F.col("status") == "Cancelled"
    per_user = orders.groupBy("user_id").agg(count_if(is_cancelled).alias("user_cancellations"), F.count(F.lit(1)).alias("user_orders"))
    gone = orders.filter(is_cancelled).withColumn("_day", day("created_at"))
    per_day = gone.groupBy("_day").agg(F.count(F.lit(1)).alias("same_day"))
    df = gone.join(per_user, "user_id").join(per_day, "_day").withColumn("_age", seconds_between("created_at", now))
    age, cancels, amount = F.col("_age"), F.col("user_cancellations"), F.col("total_amount")
    repeat = cancels > 3
    rate = ratio("user_cancellations", "user_orders") * 100
    day_old, week_old = age < 86400, (age >= 86400) & (age < 604800)
    score = (
        F.lit(10.0) + points((day_old, 15), (week_old, 5), (repeat, 20), (repeat & (rate > 50), 15), (~repeat & (cancels > 1), 10))
        + first_points((amount > 7000, 15), (amount > 5000, 8)) + points((F.col("same_day") > 2, 10))
    )
    flags = some_of(
        (day_old, F.lit("Recent cancellation")), (repeat, F.lit("Repeat canceller")), (repeat & (rate > 50), F.lit("High cancellation rate")),
        (amount > 7000, F.lit("High-value cancellation")), (F.col("same_day") > 2, F.lit("Coordinated pattern")),
    )
    reasons = some_of(
        (amount.isNotNull(), F.concat(F.lit("Order cancelled ("), money_text(amount), F.lit(")"))),
        (day_old, F.lit("Cancelled within last 24 hours")),
        (week_old, F.lit("Cancelled within last 7 days")),
        (repeat, F.format_string("User has %d total cancellations", cancels)),
        (repeat & (rate > 50), F.format_string("CRITICAL: User cancelled %.0f%% of all orders", rate)),
        (~repeat & (cancels > 1), F.format_string("%d cancellations by this user", cancels)),
        (amount > 7000, F.concat(F.lit("High-value cancellation: "), money_text(amount))),
        ((amount > 5000) & (amount <= 7000), F.concat(F.lit("Moderate-value cancellation: "), money_text(amount))),
        (F.col("same_day") > 2, F.format_string("%d orders cancelled on same day - possible system issue or coordinated activity", "same_day")),
    )
    df = df.withColumns(
        {"risk_score": score, "reasons": reasons, "fraud_indicators": flags, "amount": amount, "days_since_order": F.round(age / 86400, 1)}
    ).withColumn("severity", severity4(steps=(50, 30, 15)))
    return _shaped(df, "payment", "Payment Pattern Analysis", "fraud_indicators", "days_since_order", "user_cancellations", "user_orders")


def rule_anomalies(orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Plain rules: extreme values, large deviation, stale pending orders, cancellations."""
    s = F.col("_s")
    n, mean, lo, hi = (s.getField(x) for x in ("n", "mean", "lo", "hi"))
    per_user = orders.groupBy("user_id").agg(count_if(F.col("status") == "Cancelled").alias("_c"), F.count(F.lit(1)).alias("_n"))
    df = beside(orders, amount_stats(orders)).filter(n >= 2).join(per_user, "user_id").withColumns(
        {"_dev": F.abs(F.col("total_amount") - mean) / mean, "_age": whole_days("created_at", as_of_ts(as_of))}
    )
    amount, dev = F.col("total_amount"), F.col("_dev")
    top, bottom = (amount == hi) & (n > 3), (amount == lo) & (lo < mean * 0.5) & (n > 3)
    stale = (F.col("status") == "Pending") & (F.col("_age") > 7)
    gone = F.col("status") == "Cancelled"
    rate = ratio("_c", "_n") * 100
    reasons = some_of(
        (top, F.concat(F.lit("HIGHEST VALUE ORDER: "), money_text(amount), F.lit(" (max in dataset)"))),
        (top, F.format_string("%.0f%% above average order value", (hi / mean - 1) * 100)),
        (bottom, F.concat(F.lit("LOW VALUE ORDER: "), money_text(amount), F.lit(" (minimum in dataset)"))),
        (bottom, F.lit("Significantly below typical range")),
        ((dev > 0.8) & (amount > mean), F.concat(F.lit("High value: "), money_text(amount), F.format_string(" (%.0f%% above avg)", dev * 100))),
        ((dev > 0.8) & (amount <= mean), F.concat(F.lit("Low value: "), money_text(amount), F.format_string(" (%.0f%% below avg)", dev * 100))),
        (stale, F.format_string("STALE PENDING: Order pending for %d days", "_age")),
        (stale, F.lit("Long-pending orders may indicate payment issues")),
        (gone, F.concat(F.lit("CANCELLED ORDER: "), money_text(amount))),
        (gone & (rate > 30), F.format_string("User cancellation rate: %.0f%% (%d/%d)", rate, F.col("_c"), F.col("_n"))),
    )
    df = df.withColumns(
        {"risk_score": points((top, 20), (bottom, 15), (dev > 0.8, 15), (stale, 20), (gone, 25)), "reasons": reasons, "amount": amount}
    ).filter(F.size("reasons") > 0)
    score = F.col("risk_score")
    grade = F.when(score >= 30, "high").when(score >= 15, "medium").otherwise("low")
    return _shaped(df.withColumn("severity", grade), "simple_rule", "Rule-Based Analysis")


def fraud_features(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Orders with line count, orders of the user in the last hour, earlier orders and cancellation rate; a null user is a user."""
    lines = items.groupBy(F.col("order_id").alias("id")).agg(F.count(F.lit(1)).alias("item_count"))
    cols = ["id", "order_number", "user_id", "status", "total_amount", "created_at"]
    base = orders.select(*cols, *[c for c in ("cancelled_at",) if c in orders.columns])
    df = ordered.prior_count(base, "user_id", "created_at", "user_history")
    df = ordered.trailing_count(df, "user_id", "created_at", 3600, "last_hour")
    rate = ordered.filled_key(orders, "user_id").groupBy("_k", "_none").agg(ratio(count_if(F.col("status") == "Cancelled"), F.count(F.lit(1))).alias("cancel_rate"))
    df = ordered.filled_key(df, "user_id").join(rate, ["_k", "_none"]).drop("_k", "_none").join(lines, "id", "left")
    return df.withColumn("item_count", F.coalesce("item_count", F.lit(0)))


def fraud_score(features: DataFrame, stats: DataFrame) -> DataFrame:
    """Composite score from 0 to 100 with reasons, over :func:`fraud_features` and :func:`amount_stats`."""
    mean, std = F.col("_s.mean"), F.col("_s.std")
    amount, hour = F.col("total_amount"), F.hour("created_at")
    z = F.coalesce(F.abs(ratio(amount - mean, std)), F.lit(0.0))
    recent, lines, past, rate = F.col("last_hour"), F.col("item_count"), F.col("user_history"), F.col("cancel_rate")
    quick = F.lit(None).cast("bigint")
    if "cancelled_at" in features.columns:
        quick = F.when(F.col("status") == "Cancelled", seconds_between("created_at", "cancelled_at"))
    minute, five = F.coalesce(quick < 60, F.lit(False)), F.coalesce((quick >= 60) & (quick < 300), F.lit(False))
    score = (
        first_points((z > 4, 40), (z > 3, 30), (z > 2, 15))
        + first_points((amount > mean * 10, 35), (amount > mean * 5, 25))
        + first_points((recent > 10, 25), (recent > 5, 15))
        + first_points((lines > 50, 15), (lines > 20, 8))
        + first_points((hour < 5, 10))
        + first_points((past == 0, 10), (past < 3, 5))
        + points((minute, 20), (five, 15), (rate > 0.5, 15))
    )
    reasons = some_of(
        (z > 3, F.concat(F.format_string("Amount %.1fσ above normal (", z), money_text(amount), F.lit(")"))),
        ((z > 2) & (z <= 3), F.format_string("Amount %.1fσ above normal", z)),
        (amount > mean * 10, F.concat(F.lit("Extremely high value order ("), money_text(amount), F.lit(")"))),
        ((amount > mean * 5) & (amount <= mean * 10), F.concat(F.lit("High value order ("), money_text(amount), F.lit(")"))),
        (recent > 10, F.format_string("%d orders in last hour - possible bot activity", recent)),
        ((recent > 5) & (recent <= 10), F.format_string("%d orders in last hour - unusual velocity", recent)),
        (lines > 50, F.format_string("Abnormal item count: %d items", lines)),
        ((lines > 20) & (lines <= 50), F.format_string("High item count: %d items", lines)),
        (hour < 5, F.format_string("Unusual time: %d:00 AM order", hour)),
        (past == 0, F.lit("First-time customer")),
        ((past > 0) & (past < 3), F.lit("New customer (< 3 orders)")),
        (minute, F.lit("Cancelled within 1 minute - possible test transaction")),
        (five, F.lit("Cancelled within 5 minutes")),
        (rate > 0.5, F.format_string("High cancellation rate: %.0f%%", rate * 100)),
    )
    df = beside(features, stats).withColumns({"risk_score": F.least(score, F.lit(100.0)), "reasons": reasons, "amount": amount}).drop("_s")
    return df.withColumn("severity", severity4())


FEATURES = ["total_amount", "item_count", "hour", "weekday", "cancelled", "user_history"]


def multivariate_outliers(orders: DataFrame, items: DataFrame, as_of: AsOf, share: float = 0.05, days: int | None = 30) -> DataFrame:
    """The ``share`` of recent orders that lie farthest out over six standardised features, with fraud score.

    History and hourly counts use all orders of the users seen in the period. The cut is the exact
    rank value of the distance.
    """
    if days is None:
        df = fraud_features(orders, items)
    else:
        recent = since("created_at", as_of, days=days)
        seen = orders.filter(recent).select(F.col("user_id").alias("_user")).distinct()
        df = fraud_features(orders.join(seen, F.col("user_id").eqNullSafe(F.col("_user")), "left_semi"), items).filter(recent)
    df = df.withColumns(
        {"hour": F.hour("created_at"), "weekday": F.weekday("created_at"), "cancelled": (F.col("status") == "Cancelled").cast("int")}
    )
    # Statistics, ranks, amounts and the result read the features; they are made once.
    df = cut_lineage(df, "features")
    stats = df.agg(
        *[F.avg(c).alias(f"_m_{c}") for c in FEATURES], *[F.stddev_pop(c).alias(f"_d_{c}") for c in FEATURES], F.count(F.lit(1)).alias("_n")
    )

    def unit(c):
        d = F.col(f"_d_{c}")
        return (F.col(c) - F.col(f"_m_{c}")) / F.when(d > 0, d).otherwise(1.0)

    squared = reduce(lambda a, b: a + b, [F.pow(unit(c), 2) for c in FEATURES])
    amounts = amount_stats(df)
    df = beside(df, stats).withColumn("distance", F.round(squared, 6))
    ranks = ordered.running_total(df, "distance", F.lit(1))
    smaller = F.col("running") - F.col("weight")
    cut = ranks.agg(F.min(F.when(smaller >= (F.col("total") - 1) * (1 - share), F.col("distance"))).alias("_cut"))
    far = beside(df, cut).filter("_n >= 3 AND distance >= _cut")
    scored = fraud_score(far, amounts)
    reasons = F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit("Unusual combination of features")))
    return _shaped(scored.withColumn("reasons", reasons), "multivariate", "Multivariate Distance", "distance", "item_count", "user_history")


def marked_fraud(orders: DataFrame) -> DataFrame:
    df = orders.filter("status = 'Fraud'").withColumns(
        {
            "severity": F.lit("critical"), "risk_score": F.lit(100.0), "amount": F.col("total_amount"),
            "reasons": F.array(F.lit("ORDER MARKED AS FRAUD by admin"), F.lit("Manually flagged as fraudulent"), F.lit("Requires immediate investigation")),
        }
    )
    return _shaped(df, "manual_fraud", "Manual Review")


def union_detections(*frames: DataFrame) -> DataFrame:
    """All detections in one frame; columns a detector lacks are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def all_detections(orders: DataFrame, items: DataFrame, as_of: AsOf, with_rules: bool = True) -> DataFrame:
    frames = [
        multivariate_outliers(orders, items, as_of), order_outliers(orders, as_of), velocity_bursts(orders, as_of), cancellation_risk(orders, as_of),
    ]
    if with_rules:
        frames += [rule_anomalies(orders, as_of), marked_fraud(orders)]
    return union_detections(*[f.select(*SHAPE) for f in frames])


def live_feed(detections: DataFrame, n: int = 50) -> DataFrame:
    """Highest risk first, then newest."""
    return detections.orderBy(F.desc("risk_score"), F.desc("created_at"), F.asc("order_number"), F.asc("type"), F.asc("user_id")).limit(n)


def top_risk_users(detections: DataFrame, users: DataFrame, k: int = 10, n_reasons: int = 2) -> DataFrame:
    """Users by summed risk with their first reasons."""
    sums = detections.filter("user_id IS NOT NULL").groupBy("user_id").agg(
        F.sum("risk_score").alias("risk_score"), F.count(F.lit(1)).alias("anomaly_count"), money_sum("amount").alias("total_spent")
    )
    best = sums.orderBy(F.desc("risk_score"), F.asc("user_id")).limit(k)
    heads = ordered.top_n(
        detections.join(best.select("user_id"), "user_id", "left_semi"), ["user_id"],
        [F.desc("risk_score"), F.asc("type"), F.asc("order_number")], n_reasons, rank="_pos",
    )
    heads = heads.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "reason"))).alias("r"))
    named = best.join(heads, "user_id").join(users.select(F.col("id").alias("user_id"), "email"), "user_id", "left")
    return named.select(
        "user_id", "email", "risk_score", "anomaly_count", "total_spent", F.array_join(F.transform("r", lambda x: x["reason"]), "; ").alias("reason")
    )


def detection_counts(detections: DataFrame) -> DataFrame:
    """Detections by type and severity, by type, and overall."""
    return detections.groupingSets([["type", "severity"], ["type"], []], "type", "severity").agg(
        F.count(F.lit(1)).alias("detections"), F.avg("risk_score").alias("average_risk")
    )


def fraud_metrics(orders: DataFrame, scored: DataFrame, other: DataFrame, as_of: AsOf) -> DataFrame:
    """Rates and counts. ``scored`` holds multivariate and statistical detections, ``other`` velocity and cancellation ones."""
    from ..plans.kpis import one_row

    risk = F.col("risk_score")
    today = F.col("created_at") >= ago(as_of, hours=24)
    week = since("created_at", as_of, days=7)
    fraud = F.col("status") == "Fraud"
    base = orders.agg(
        F.count(F.lit(1)).alias("total_orders"), count_if(today).alias("orders_today"), count_if(week).alias("orders_week"),
        count_if(fraud).alias("marked_fraud"), count_if(fraud & today).alias("marked_today"), count_if(fraud & week).alias("marked_week"),
        count_if(F.col("status") == "Cancelled").alias("cancelled"),
    )
    hits = scored.agg(
        F.count(F.lit(1)).alias("scored"), count_if(risk >= 70).alias("critical"), count_if((risk >= 50) & (risk < 70)).alias("high"),
        count_if((risk >= 30) & (risk < 50)).alias("medium"), count_if((risk >= 70) & today).alias("critical_today"),
        F.coalesce(F.round(F.avg("risk_score"), 1), F.lit(0.0)).alias("average_risk_score"),
    )
    extra = other.agg(count_if(F.col("type") == "velocity").alias("velocity"), count_if(F.col("type") == "payment").alias("payment"))
    df = one_row(base, hits, extra)

    def rate(num, den, digits):
        return F.coalesce(F.round(ratio(num, den) * 100, digits), F.lit(0.0))

    return df.withColumns(
        {
            "detected_anomalies": F.col("scored") + F.col("velocity") + F.col("payment"),
            "low": F.col("scored") - F.col("critical") - F.col("high") - F.col("medium"),
            "fraud_rate": rate(F.col("critical") + F.col("marked_fraud"), "total_orders", 1),
            "fraud_rate_today": rate(F.col("critical_today") + F.col("marked_today"), "orders_today", 2),
            "fraud_rate_week": rate(F.col("critical") + F.col("marked_week"), "orders_week", 2),
            "cancellation_rate": rate(F.col("cancelled"), "total_orders", 1),
        }
    )


def anomaly_report(detections: DataFrame) -> DataFrame:
    """Totals, critical and high counts, count per detector and risk level."""
    risk = F.col("risk_score")
    kinds = ["multivariate", "statistical", "velocity", "payment", "simple_rule", "manual_fraud"]
    df = detections.agg(
        F.count(F.lit(1)).alias("total_anomalies"), count_if(risk >= 70).alias("critical"), count_if((risk >= 50) & (risk < 70)).alias("high"),
        *[count_if(F.col("type") == k).alias(k) for k in kinds],
    )
    level = F.when(F.col("critical") > 5, "HIGH").when(F.col("critical") > 0, "MEDIUM").otherwise("LOW")
    return df.withColumns({"requires_immediate_attention": F.col("critical") > 0, "risk_level": level})


def score_transactions(transactions: DataFrame) -> DataFrame:
    """Score from amount, hour and orders in the last hour, capped at 1; flagged above 0.7."""
    amount, hour, recent = F.col("amount"), F.col("hour"), F.col("orders_last_hour")
    score = first_points((amount > 50000, 0.4), (amount > 20000, 0.2)) + points(((hour < 5) | (hour > 23), 0.3), (recent > 10, 0.3))
    df = transactions.withColumn("anomaly_score", F.least(score, F.lit(1.0)))
    return df.withColumns(
        {
            "is_anomaly": F.col("anomaly_score") > 0.7,
            "confidence": F.least(F.col("anomaly_score") * 100, F.lit(100.0)),
            "amount_deviation": F.abs(amount - 5000) / 5000,
            "time_risk": F.when(hour < 6, 1).otherwise(0),
            "velocity_risk": recent / 10,
        }
    )


def remove_outliers(series: DataFrame, value: str = "revenue", method: str = "iqr", keys: list[str] = []) -> DataFrame:
    """Drop outlying rows of each calendar series; series of fewer than 10 rows stay whole."""
    if method == "iqr":
        q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.75)))
        stats = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), q.alias("_q"))
        q1, q3 = F.element_at("_q", 1), F.element_at("_q", 2)
        fence = (q3 - q1) * 1.5
        keep = F.col(value).between(q1 - fence, q3 + fence)
    else:
        stats = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.stddev_samp(value).alias("_d"))
        keep = F.abs(ratio(F.col(value) - F.col("_m"), "_d")) < 3
    joined = series.join(stats, keys) if keys else beside(series, stats)
    return joined.filter((F.col("_n") < 10) | keep).select(*series.columns)
