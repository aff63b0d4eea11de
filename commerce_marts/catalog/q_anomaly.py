"""Outlier and fraud queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anomaly, metrics, ordered
from ..plans import kpis
from ..session import cut_lineage
from . import shared as s
from .registry import add_cte, query

CORE = ["order_number", "user_id", "severity", "risk_score", "amount", "created_at"]


def brief(df, *extra):
    """Core columns with the number of reasons instead of their text."""
    return df.select(*CORE, F.size("reasons").cast("bigint").alias("n_reasons"), *extra)


def sev4(steps=(70, 50, 30)):
    a, b, c = steps
    return f"CASE WHEN risk_score >= {a} THEN 'critical' WHEN risk_score >= {b} THEN 'high' WHEN risk_score >= {c} THEN 'medium' ELSE 'low' END AS severity"


def b2i(*conds):
    return " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c in conds)


def outlier_ctes(prefix, source, as_of):
    """SQL blocks that score the outliers of ``source``; the last one is named ``<prefix>s``."""
    add_cte(f"{prefix}_kept", f"SELECT * FROM {source} WHERE created_at >= {as_of} - INTERVAL 30 DAY")
    add_cte(f"{prefix}_rank", f"SELECT total_amount, row_number() OVER (ORDER BY total_amount) AS rn, count(*) OVER () AS n FROM {prefix}_kept")
    add_cte(f"{prefix}_stats", f"""SELECT (SELECT count(*) FROM {prefix}_kept) AS n, (SELECT mavg(total_amount) FROM {prefix}_kept) AS mean, (SELECT stddev_pop(total_amount) FROM {prefix}_kept) AS std,
        (SELECT total_amount FROM {prefix}_rank WHERE rn = floor(n * 0.25) + 1) AS q1, (SELECT total_amount FROM {prefix}_rank WHERE rn = floor(n * 0.75) + 1) AS q3""")
    add_cte(f"{prefix}_flags", f"""SELECT k.*, total_amount AS amount, (total_amount - mean) / std AS z, mean, q3 + 1.5 * (q3 - q1) AS upper, q1 - 1.5 * (q3 - q1) AS lower,
        CASE WHEN n > 50 THEN 2.5 WHEN n > 20 THEN 1.8 ELSE 1.2 END AS hard, CASE WHEN n > 50 THEN 1.8 WHEN n > 20 THEN 1.2 ELSE 0.8 END AS soft FROM {prefix}_kept k, {prefix}_stats""")
    add_cte(f"{prefix}_scored", f"""SELECT *, (CASE WHEN abs(z) > hard THEN 35 WHEN abs(z) > soft THEN 25 ELSE 0 END + CASE WHEN amount > upper THEN 25 WHEN amount < lower THEN 20 ELSE 0 END
        + CASE WHEN amount > mean * 5 THEN 15 WHEN amount > mean * 3 THEN 10 ELSE 0 END)::double AS risk_score,
        CASE WHEN abs(z) > hard THEN 2 WHEN abs(z) > soft AND z > 0 THEN 1 ELSE 0 END + {b2i('amount > upper', 'amount < lower', 'amount > mean * 3')} AS n_reasons FROM {prefix}_flags""")
    add_cte(f"{prefix}s", f"SELECT *, {sev4()} FROM {prefix}_scored WHERE n_reasons > 0")


outlier_ctes("s_outlier", "r_orders", "AS_OF")
add_cte("s_purchases", "SELECT event_id AS id, 'E' || event_id AS order_number, user_id, value * 100 AS total_amount, ts AS created_at FROM events")
outlier_ctes("s_event_outlier", "s_purchases", "EV_AS_OF")


@query("N01_order_outliers", """SELECT order_number, user_id, severity, risk_score, amount, created_at, n_reasons::bigint AS n_reasons, round(z, 6) AS z_score FROM s_outliers""")
def _(t):
    return brief(anomaly.order_outliers(t.orders, t.as_of), F.round("z_score", 6).alias("z_score"))


@query("N01_purchase_outliers", """SELECT order_number, user_id, severity, risk_score, amount, created_at, n_reasons::bigint AS n_reasons, round(z, 6) AS z_score FROM s_event_outliers""")
def _(t):
    found = anomaly.order_outliers(purchases(t), t.events_as_of)
    return brief(found, F.round("z_score", 6).alias("z_score"))


@query("N02_global_zscores", """WITH z AS (SELECT created_at, total_revenue, total_orders, (total_revenue - avg(total_revenue) OVER ()) / greatest(stddev_samp(total_revenue) OVER (), 1) AS z,
    count(*) OVER () AS n FROM s_daily_sales) SELECT created_at, total_revenue, total_orders, round(z, 4) AS revenue_zscore, abs(z) > 2.5 AS is_anomaly,
    CASE WHEN abs(z) > 3 THEN 'High' WHEN abs(z) > 2.5 THEN 'Medium' ELSE 'Low' END AS severity FROM z WHERE n > 7""")
def _(t):
    daily = metrics.daily_sales(t.orders, metrics.order_item_rollup(t.order_items))
    return anomaly.global_zscores(daily).withColumn("revenue_zscore", F.round("revenue_zscore", 4))


@query("N03_series_anomalies", """WITH z AS (SELECT *, abs((revenue - avg(revenue) OVER ()) / stddev_pop(revenue) OVER ()) AS z FROM s_series)
    SELECT date, revenue, orders, round(z, 4) AS z_score, CASE WHEN z > 3 THEN 'High' ELSE 'Medium' END AS severity FROM z WHERE z >= 2.5""")
def _(t):
    return anomaly.series_anomalies(metrics.sales_series(t.orders, t.as_of, None)).withColumn("z_score", F.round("z_score", 4))


BURSTS = [("1 hour", 60, 2), ("24 hours", 1440, 3), ("7 days", 10080, 12)]


def purchases(t):
    """Store events as a stream of purchases, at a hundred times their value."""
    return t.raw("events").selectExpr("event_id AS id", "'E' || event_id AS order_number", "user_id", "value * 100 AS total_amount", "ts AS created_at")


def burst_sql(windows):
    arms = " UNION ALL ".join(
        f"""SELECT user_id, '{name}' AS time_window, {limit} AS threshold, count(*) AS order_count, msum(value * 100) AS total_spent, min(ts) AS first_order,
        max(ts) AS last_order FROM events WHERE ts >= EV_AS_OF - INTERVAL {minutes} MINUTE GROUP BY 1 HAVING count(*) >= {limit}"""
        for name, minutes, limit in windows
    )
    return f"""WITH h AS ({arms}), r AS (SELECT *, order_count / greatest(datediff('second', date_trunc('second', first_order), date_trunc('second', last_order)) / 60, 1) AS order_rate FROM h),
        c AS (SELECT *, (least(order_count * 3, 60) + CASE WHEN order_rate > 2 THEN 20 WHEN order_rate > 1 THEN 10 ELSE 0 END
        + CASE WHEN total_spent > 50000 THEN 25 WHEN total_spent > 20000 THEN 15 ELSE 0 END)::double AS risk_score FROM r)
        SELECT user_id, time_window, order_count, total_spent, first_order, last_order, risk_score,
        CASE WHEN risk_score >= 70 THEN 'critical' WHEN risk_score >= 50 THEN 'high' ELSE 'medium' END AS severity,
        (1 + CASE WHEN order_rate > 2 THEN 2 WHEN order_rate > 1 THEN 1 ELSE 0 END + CASE WHEN total_spent > 50000 THEN 2 WHEN total_spent > 20000 THEN 1 ELSE 0 END
        + CASE WHEN order_count > threshold * 2 THEN 1 ELSE 0 END)::bigint AS n_reasons FROM c"""


@query("N04_velocity_bursts", burst_sql(BURSTS))
def _(t):
    found = anomaly.velocity_bursts(purchases(t), t.events_as_of, BURSTS)
    return found.select(
        "user_id", "time_window", "order_count", "total_spent", "first_order", "last_order", "risk_score", "severity", F.size("reasons").cast("bigint").alias("n_reasons")
    )


@query("N04_velocity_history", """SELECT event_id AS id, user_id, ts AS created_at, count(*) OVER w AS last_day FROM events
    WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE INTERVAL 24 HOUR PRECEDING) QUALIFY last_day >= 5""")
def _(t):
    seen = ordered.trailing_count(purchases(t).drop("total_amount", "order_number"), "user_id", "created_at", 86400, "last_day")
    return seen.filter("last_day >= 5")


add_cte("s_cancel", f"""SELECT o.*, o.total_amount AS amount, c.cancels, c.total, d.same_day, epoch(AS_OF - o.created_at) AS age, c.cancels / c.total * 100 AS rate FROM r_orders o
    JOIN (SELECT user_id, count(*) FILTER (status = 'Cancelled') AS cancels, count(*) AS total FROM r_orders GROUP BY 1) c ON o.user_id = c.user_id
    JOIN (SELECT created_at::date AS d, count(*) AS same_day FROM r_orders WHERE status = 'Cancelled' GROUP BY 1) d ON o.created_at::date = d.d WHERE status = 'Cancelled'""")
add_cte("s_cancel_scored", f"""SELECT *, (10 + CASE WHEN age < 86400 THEN 15 WHEN age < 604800 THEN 5 ELSE 0 END
    + CASE WHEN cancels > 3 THEN 20 + CASE WHEN rate > 50 THEN 15 ELSE 0 END WHEN cancels > 1 THEN 10 ELSE 0 END
    + CASE WHEN amount > 7000 THEN 15 WHEN amount > 5000 THEN 8 ELSE 0 END + CASE WHEN same_day > 2 THEN 10 ELSE 0 END)::double AS risk_score,
    1 + {b2i('age < 604800', 'cancels > 1', 'cancels > 3 AND rate > 50', 'amount > 5000', 'same_day > 2')} AS n_reasons,
    {b2i('age < 86400', 'cancels > 3', 'cancels > 3 AND rate > 50', 'amount > 7000', 'same_day > 2')} AS n_flags FROM s_cancel""")


@query("N05_cancellation_risk", f"""SELECT order_number, user_id, risk_score, amount, created_at, n_reasons::bigint AS n_reasons, n_flags::bigint AS n_flags,
    {sev4((50, 30, 15))} FROM s_cancel_scored""")
def _(t):
    return brief(anomaly.cancellation_risk(t.orders, t.as_of), F.size("fraud_indicators").cast("bigint").alias("n_flags"))


add_cte("s_rule_scored", f"""WITH st AS (SELECT min(total_amount) AS lo, max(total_amount) AS hi, mavg(total_amount) AS mean FROM r_orders),
    u AS (SELECT user_id, count(*) FILTER (status = 'Cancelled') / count(*) AS rate FROM r_orders GROUP BY 1),
    f AS (SELECT o.*, total_amount AS amount, total_amount = hi AS top, total_amount = lo AND lo < mean * 0.5 AS bottom, abs(total_amount - mean) / mean > 0.8 AS far,
        status = 'Pending' AND floor(epoch(AS_OF - created_at) / 86400) > 7 AS stale, status = 'Cancelled' AS gone, rate FROM r_orders o JOIN u ON o.user_id = u.user_id, st)
    SELECT *, (CASE WHEN top THEN 20 ELSE 0 END + CASE WHEN bottom THEN 15 ELSE 0 END + CASE WHEN far THEN 15 ELSE 0 END + CASE WHEN stale THEN 20 ELSE 0 END
        + CASE WHEN gone THEN 25 ELSE 0 END)::double AS risk_score,
    2 * ({b2i('top', 'bottom', 'stale')}) + {b2i('far', 'gone', 'gone AND rate > 0.3')} AS n_reasons FROM f""")


@query("N06_rule_anomalies", """SELECT order_number, user_id, risk_score, amount, created_at, n_reasons::bigint AS n_reasons,
    CASE WHEN risk_score >= 30 THEN 'high' WHEN risk_score >= 15 THEN 'medium' ELSE 'low' END AS severity FROM s_rule_scored WHERE n_reasons > 0""")
def _(t):
    return brief(anomaly.rule_anomalies(t.orders, t.as_of))


add_cte("s_fraud_features", """SELECT o.id, o.order_number, o.user_id, o.status, o.total_amount, o.created_at, o.cancelled_at, coalesce(l.n, 0) AS item_count,
    count(*) OVER (PARTITION BY o.user_id ORDER BY o.created_at RANGE INTERVAL 3600 SECOND PRECEDING) AS last_hour,
    count(*) OVER (PARTITION BY o.user_id ORDER BY o.created_at RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS user_history,
    r.cancel_rate FROM r_orders o LEFT JOIN (SELECT order_id, count(*) AS n FROM r_items GROUP BY 1) l ON o.id = l.order_id
    JOIN (SELECT user_id, count(*) FILTER (status = 'Cancelled') / count(*) AS cancel_rate FROM r_orders GROUP BY 1) r ON o.user_id = r.user_id""")


def fraud_sql(source, stats):
    return f"""SELECT *, total_amount AS amount, {sev4()} FROM (SELECT *, least(100, CASE WHEN z > 4 THEN 40 WHEN z > 3 THEN 30 WHEN z > 2 THEN 15 ELSE 0 END
        + CASE WHEN total_amount > mean * 10 THEN 35 WHEN total_amount > mean * 5 THEN 25 ELSE 0 END + CASE WHEN last_hour > 10 THEN 25 WHEN last_hour > 5 THEN 15 ELSE 0 END
        + CASE WHEN item_count > 50 THEN 15 WHEN item_count > 20 THEN 8 ELSE 0 END + CASE WHEN hour(created_at) < 5 THEN 10 ELSE 0 END
        + CASE WHEN user_history = 0 THEN 10 WHEN user_history < 3 THEN 5 ELSE 0 END + CASE WHEN quick < 60 THEN 20 WHEN quick < 300 THEN 15 ELSE 0 END
        + CASE WHEN cancel_rate > 0.5 THEN 15 ELSE 0 END)::double AS risk_score,
        {b2i('z > 2', 'total_amount > mean * 5', 'last_hour > 5', 'item_count > 20', 'hour(created_at) < 5', 'user_history < 3', 'quick < 300', 'cancel_rate > 0.5')} AS n_reasons
        FROM (SELECT f.*, mean, abs((total_amount - mean) / std) AS z, CASE WHEN status = 'Cancelled' THEN epoch(cancelled_at - created_at) END AS quick FROM {source} f, {stats}))"""


add_cte("s_all_stats", "SELECT mavg(total_amount) AS mean, stddev_pop(total_amount) AS std FROM r_orders")


@query("N07_fraud_score", "SELECT order_number, user_id, severity, risk_score, amount, created_at, n_reasons::bigint AS n_reasons FROM (" + fraud_sql("s_fraud_features", "s_all_stats") + ")")
def _(t):
    scored = anomaly.fraud_score(anomaly.fraud_features(t.orders, t.order_items), anomaly.amount_stats(t.orders))
    return brief(scored)


MV = {"total_amount": "total_amount", "item_count": "item_count", "h": "hour(created_at)", "w": "(isodow(created_at) - 1)",
      "c": "(CASE WHEN status = 'Cancelled' THEN 1 ELSE 0 END)", "user_history": "user_history"}
add_cte("s_mv", "SELECT * FROM s_fraud_features WHERE created_at >= AS_OF - INTERVAL 30 DAY")
add_cte("s_mv_dist", "SELECT *, round(" + " + ".join(
    f"pow(({e} - avg({e}) OVER ()) / (CASE WHEN stddev_pop({e}) OVER () > 0 THEN stddev_pop({e}) OVER () ELSE 1 END), 2)" for e in MV.values()) + ", 6) AS distance FROM s_mv")
add_cte("s_mv_stats", "SELECT mavg(total_amount) AS mean, stddev_pop(total_amount) AS std FROM s_mv")
add_cte("s_mv_cut", "SELECT * FROM s_mv_dist QUALIFY percent_rank() OVER (ORDER BY distance) >= 0.95")
add_cte("s_mv_scored", fraud_sql("s_mv_cut", "s_mv_stats"))


@query("N08_multivariate_outliers", """SELECT order_number, user_id, severity, risk_score, amount, created_at, greatest(n_reasons, 1)::bigint AS n_reasons,
    round(distance, 4) AS distance, item_count, user_history FROM s_mv_scored""")
def _(t):
    found = anomaly.multivariate_outliers(t.orders, t.order_items, t.as_of)
    return brief(found, F.round("distance", 4).alias("distance"), "item_count", "user_history")


@query("N09_marked_fraud", "SELECT order_number, user_id, 'critical' AS severity, 100.0::double AS risk_score, total_amount AS amount, created_at, 3::bigint AS n_reasons FROM r_orders WHERE status = 'Fraud'")
def _(t):
    return brief(anomaly.marked_fraud(t.orders))


add_cte("s_detections", f"""SELECT order_number, user_id, 'multivariate' AS type, severity, risk_score, amount, created_at FROM s_mv_scored UNION ALL
    SELECT order_number, user_id, 'statistical', severity, risk_score, amount, created_at FROM s_outliers UNION ALL
    SELECT order_number, user_id, 'payment', {sev4((50, 30, 15))}, risk_score, amount, created_at FROM s_cancel_scored""")
add_cte("s_detections_all", """SELECT * FROM s_detections UNION ALL SELECT order_number, user_id, 'simple_rule', CASE WHEN risk_score >= 30 THEN 'high'
    WHEN risk_score >= 15 THEN 'medium' ELSE 'low' END, risk_score, amount, created_at FROM s_rule_scored WHERE n_reasons > 0 UNION ALL
    SELECT order_number, user_id, 'manual_fraud', 'critical', 100, total_amount, created_at FROM r_orders WHERE status = 'Fraud'""")


def two(t):
    scored = anomaly.union_detections(
        anomaly.multivariate_outliers(t.orders, t.order_items, t.as_of).select(*anomaly.SHAPE), anomaly.order_outliers(t.orders, t.as_of).select(*anomaly.SHAPE)
    )
    other = anomaly.union_detections(
        anomaly.velocity_bursts(t.orders, t.as_of).select(*anomaly.SHAPE), anomaly.cancellation_risk(t.orders, t.as_of).select(*anomaly.SHAPE)
    )
    return scored, other


@query("N10_fraud_metrics", """WITH b AS (SELECT count(*) AS total_orders, count(*) FILTER (created_at >= AS_OF - INTERVAL 24 HOUR) AS orders_today,
    count(*) FILTER (created_at >= AS_OF - INTERVAL 7 DAY) AS orders_week, count(*) FILTER (status = 'Fraud') AS marked_fraud,
    count(*) FILTER (status = 'Fraud' AND created_at >= AS_OF - INTERVAL 24 HOUR) AS marked_today,
    count(*) FILTER (status = 'Fraud' AND created_at >= AS_OF - INTERVAL 7 DAY) AS marked_week, count(*) FILTER (status = 'Cancelled') AS cancelled FROM r_orders),
    h AS (SELECT count(*) AS scored, count(*) FILTER (risk_score >= 70) AS critical, count(*) FILTER (risk_score >= 50 AND risk_score < 70) AS high,
    count(*) FILTER (risk_score >= 30 AND risk_score < 50) AS medium, count(*) FILTER (risk_score >= 70 AND created_at >= AS_OF - INTERVAL 24 HOUR) AS critical_today,
    round(avg(risk_score), 1) AS average_risk_score FROM s_detections WHERE type <> 'payment')
    SELECT b.*, h.*, 0::bigint AS velocity, cancelled AS payment, scored + cancelled AS detected_anomalies, scored - critical - high - medium AS low,
    round((critical + marked_fraud) / total_orders * 100, 1) AS fraud_rate, round((critical_today + marked_today) / orders_today * 100, 2) AS fraud_rate_today,
    round((critical + marked_week) / orders_week * 100, 2) AS fraud_rate_week, round(cancelled / total_orders * 100, 1) AS cancellation_rate FROM b, h""")
def _(t):
    return anomaly.fraud_metrics(t.orders, *two(t), t.as_of)


@query("N11_anomaly_report", """SELECT count(*) AS total_anomalies, count(*) FILTER (risk_score >= 70) AS critical, count(*) FILTER (risk_score >= 50 AND risk_score < 70) AS high,
    count(*) FILTER (type = 'multivariate') AS multivariate, count(*) FILTER (type = 'statistical') AS statistical, 0::bigint AS velocity,
    count(*) FILTER (type = 'payment') AS payment, count(*) FILTER (type = 'simple_rule') AS simple_rule, count(*) FILTER (type = 'manual_fraud') AS manual_fraud,
    critical > 0 AS requires_immediate_attention, CASE WHEN critical > 5 THEN 'HIGH' WHEN critical > 0 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level FROM s_detections_all""")
def _(t):
    return anomaly.anomaly_report(anomaly.all_detections(t.orders, t.order_items, t.as_of))


@query("N12_score_transactions", """WITH x AS (SELECT *, hour(created_at) AS h, count(*) OVER (PARTITION BY user_id ORDER BY created_at RANGE INTERVAL 3600 SECOND PRECEDING) AS recent FROM r_orders),
    y AS (SELECT *, least(CASE WHEN total_amount > 50000 THEN 0.4::double WHEN total_amount > 20000 THEN 0.2::double ELSE 0.0::double END + CASE WHEN h < 5 OR h > 23 THEN 0.3::double ELSE 0.0::double END
    + CASE WHEN recent > 10 THEN 0.3::double ELSE 0.0::double END, 1.0::double) AS anomaly_score FROM x)
    SELECT id, anomaly_score, anomaly_score > 0.7 AS is_anomaly, least(anomaly_score * 100, 100) AS confidence, abs(total_amount - 5000) / 5000 AS amount_deviation,
    CASE WHEN h < 6 THEN 1 ELSE 0 END AS time_risk, recent / 10 AS velocity_risk FROM y""")
def _(t):
    df = ordered.trailing_count(t.orders.select("id", "user_id", "created_at", "total_amount"), "user_id", "created_at", 3600, "orders_last_hour")
    df = df.select("id", F.col("total_amount").alias("amount"), F.hour("created_at").alias("hour"), "orders_last_hour")
    return anomaly.score_transactions(df).drop("amount", "hour", "orders_last_hour")


@query("N13_remove_outliers_iqr", """WITH q AS (SELECT quantile_cont(revenue, 0.25) AS q1, quantile_cont(revenue, 0.75) AS q3, count(*) AS n FROM s_series)
    SELECT s.* FROM s_series s, q WHERE n < 10 OR revenue BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def _(t):
    return anomaly.remove_outliers(metrics.sales_series(t.orders, t.as_of, None))


@query("N13_remove_outliers_zscore", """SELECT date, product_id, quantity FROM (SELECT created_at::date AS date, product_id, sum(quantity)::bigint AS quantity FROM s_items_user
    WHERE status IN ('Delivered', 'Shipped') GROUP BY 1, 2) WINDOW w AS (PARTITION BY product_id) QUALIFY count(*) OVER w < 10
    OR abs((quantity - avg(quantity) OVER w) / nullif(stddev_samp(quantity) OVER w, 0)) < 3""")
def _(t):
    series = metrics.product_series(t.orders, t.order_items, t.as_of, None)
    return anomaly.remove_outliers(series, "quantity", "zscore", ["product_id"])


@query("U01_union_detections", """SELECT type, severity, count(*) AS detections, round(avg(risk_score), 6) AS average_risk FROM s_detections_all
    GROUP BY GROUPING SETS ((type, severity), (type), ())""")
def _(t):
    found = anomaly.all_detections(t.orders, t.order_items, t.as_of)
    return anomaly.detection_counts(found).withColumn("average_risk", F.round("average_risk", 6))


@query("T04_live_feed", """SELECT order_number, user_id, type, severity, risk_score, created_at FROM s_detections
    ORDER BY risk_score DESC, created_at DESC, order_number, type, user_id LIMIT 50""")
def _(t):
    feed = anomaly.live_feed(anomaly.all_detections(t.orders, t.order_items, t.as_of, with_rules=False))
    return feed.select("order_number", "user_id", "type", "severity", "risk_score", "created_at")


@query("T05_top_risk_users", """SELECT d.user_id, u.email, sum(risk_score) AS risk_score, count(*) AS anomaly_count, msum(amount) AS total_spent FROM s_detections_all d
    JOIN r_users u ON d.user_id = u.id GROUP BY 1, 2 ORDER BY risk_score DESC, d.user_id LIMIT 10""")
def _(t):
    # The ranking reads the detections three times, so they are written once, to the shared folder.
    found = cut_lineage(anomaly.all_detections(t.orders, t.order_items, t.as_of), "detections")
    return anomaly.top_risk_users(found, t.users).drop("reason")


@query("W14_prior_orders_within_day", """SELECT id, count(*) OVER (PARTITION BY user_id, created_at::date ORDER BY created_at
    RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS earlier FROM r_activities""")
def _(t):
    keyed = t.activities.select("id", "created_at", F.concat_ws("/", "user_id", F.col("created_at").cast("date")).alias("key"))
    return ordered.prior_count(keyed, "key", "created_at", "earlier").select("id", "earlier")


@query("W18_anomaly_grid_all_time", "SELECT dayofweek(created_at)::int AS day_index, hour(created_at)::int AS hour, count(*) AS order_count FROM r_orders GROUP BY 1, 2")
def _(t):
    return kpis.order_hour_grid(t.orders, t.as_of, None).filter("order_count > 0").select("day_index", "hour", "order_count")
