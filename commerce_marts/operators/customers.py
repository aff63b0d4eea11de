"""Customer analytics: RFM, churn, rule segments, shopping behaviour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions import labels
from ..functions.money import as_col, count_if, money_avg, money_sum, ratio, some_of
from ..functions.timeutil import AsOf, ago, as_of_ts, since, whole_days
from . import joins, metrics, ordered
from .onerow import beside

QUINTILES = [0.2, 0.4, 0.6, 0.8]


def rfm_metrics(orders: DataFrame, as_of: AsOf) -> DataFrame:
    return orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("frequency"),
        money_sum("total_amount").alias("monetary"),
        F.datediff(as_of_ts(as_of).cast("date"), F.max("created_at")).alias("recency"),
    )


def rfm_scores(orders: DataFrame, as_of: AsOf, exact: bool = True) -> DataFrame:
    """Scores 1 to 5 by quintile of recency (reversed), frequency and spend.

    Cuts are exact discrete quantiles found by bucketed ranks; ``exact=False`` takes them from the
    one-pass approximate sketch instead.
    """
    base = rfm_metrics(orders, as_of)
    names = ("recency", "frequency", "monetary")
    if exact:
        ranks = {f"q{i}": ordered.disc_quantile(q) for i, q in enumerate(QUINTILES)}
        rows = [
            ordered.values_at_ranks(base, name, ranks).select(F.array(*ranks).alias(f"_{name}")) for name in names
        ]
        cuts = beside(*rows)
    else:
        cuts = base.agg(*[F.percentile_approx(name, QUINTILES, 10000).alias(f"_{name}") for name in names])

    def at(name):
        return [F.get(f"_{name}", F.lit(i)) for i in range(4)]

    def rising(name):
        q, c = at(name), F.col(name)
        return F.when(c >= q[3], 5).when(c >= q[2], 4).when(c >= q[1], 3).when(c >= q[0], 2).otherwise(1)

    q, c = at("recency"), F.col("recency")
    falling = F.when(c <= q[0], 5).when(c <= q[1], 4).when(c <= q[2], 3).when(c <= q[3], 2).otherwise(1)
    scored = beside(base, cuts).withColumns({"r_score": falling, "f_score": rising("frequency"), "m_score": rising("monetary")})
    return with_rfm_segment(scored.drop(*[f"_{name}" for name in names]))


def with_rfm_segment(scored: DataFrame) -> DataFrame:
    code = F.concat(*[F.col(c).cast("string") for c in ("r_score", "f_score", "m_score")])
    return scored.withColumns({"rfm_score": code, "rfm_segment": labels.rfm_segment()})


def with_churn(df: DataFrame) -> DataFrame:
    return df.withColumn("churn_risk_score", labels.churn_score()).withColumn("churn_risk_segment", labels.churn_band())


def favourite_category(items_user: DataFrame) -> DataFrame:
    """Most bought category per user; ties go to the first name."""
    return ordered.top_n(
        metrics.category_quantities(items_user), ["user_id"], [F.desc("items_bought"), F.asc("category")], 1
    )


def rfm_fixed(customers: DataFrame, as_of: AsOf) -> DataFrame:
    """RFM by fixed bins over customers that carry orders, spend and last order date."""
    recency = F.datediff(as_of_ts(as_of).cast("date"), F.col("last_order_date"))
    df = customers.select("id", F.col("total_orders").alias("frequency"), F.col("total_spent").alias("monetary"), recency.alias("recency"))
    df = df.withColumns(
        {
            "r_score": F.when(F.col("recency").isNull(), 1).otherwise(
                labels.banded("recency", [(7, 5), (30, 4), (60, 3), (90, 2)], 1, "lt")
            ),
            "f_score": labels.banded("frequency", [(10, 5), (5, 4), (2, 3), (0, 2)], 1),
            "m_score": labels.banded("monetary", [(10000, 5), (5000, 4), (2000, 3), (500, 2)], 1),
        }
    )
    r, f, m = F.col("r_score"), F.col("f_score"), F.col("m_score")
    segment = (
        F.when((r >= 4) & (f >= 4) & (m >= 4), "Champions")
        .when(f >= 4, "Loyal Customers")
        .when(r >= 4, "New Customers")
        .when(r <= 2, "At Risk")
        .otherwise("Average")
    )
    df = df.withColumn("rfm_segment", segment)
    risk = F.when(F.col("rfm_segment") == "At Risk", 0.8).when(r < 3, 0.5).otherwise(0.1)
    df = df.withColumn("churn_risk_score", risk)
    return df.withColumns(
        {
            "rfm_score": F.concat(r.cast("string"), f.cast("string"), m.cast("string")),
            "churn_risk_segment": labels.banded("churn_risk_score", [(0.7, "High Risk"), (0.4, "Medium Risk")], "Low Risk"),
        }
    )


def customer_features(users: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, as_of: AsOf) -> DataFrame:
    """Behaviour features of every customer; customers without orders get the defaults."""
    age = as_of_ts(as_of)
    by_order = orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"),
        money_sum("total_amount").alias("total_spent"),
        F.greatest(F.lit(1.0), whole_days(F.min("created_at"), age) / 30).alias("_months"),
        whole_days(F.max("created_at"), age).alias("recency_days"),
        count_if(F.col("status") == "Cancelled").alias("_cancelled"),
    )
    lines = joins.items_with_user(items.select("order_id", "product_id"), orders)
    sold = lines.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("_lines")).join(
        products.select(F.col("id").alias("product_id"), "category"), "product_id", "left"
    )
    by_line = sold.groupBy("user_id").agg(
        F.countDistinct("category").alias("category_diversity"), F.sum("_lines").alias("_lines")
    )
    out = users.select("id").join(by_order.withColumnRenamed("user_id", "id"), "id", "left").join(
        by_line.withColumnRenamed("user_id", "id"), "id", "left"
    )
    zero = F.lit(0.0)
    return out.select(
        F.col("id").alias("user_id"),
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("total_spent", zero).alias("total_spent"),
        F.coalesce(ratio("total_spent", "total_orders"), zero).alias("avg_order_value"),
        F.coalesce(F.col("total_orders") / F.col("_months"), zero).alias("order_frequency"),
        F.coalesce("recency_days", F.lit(999)).alias("recency_days"),
        F.coalesce("category_diversity", F.lit(0)).alias("category_diversity"),
        F.coalesce(ratio("_lines", "total_orders"), zero).alias("avg_items_per_order"),
        F.coalesce(ratio("_cancelled", "total_orders"), zero).alias("return_rate"),
    )


def customer_segment() -> Column:
    """Rule segment over :func:`customer_features`; the first rule that holds wins."""
    spent, freq, recency = F.col("total_spent"), F.col("order_frequency"), F.col("recency_days")
    variety = F.col("category_diversity")
    return (
        F.when(F.col("total_orders") == 0, "new_customer")
        .when((spent > 10000) & (freq > 2), "vip_customer")
        .when((spent > 5000) & (freq > 1), "high_value")
        .when((recency < 30) & (freq > 1), "active_shopper")
        .when(recency > 90, "at_risk")
        .when(variety >= 3, "explorer")
        .when(variety == 1, "niche_shopper")
        .otherwise("regular_customer")
    )


def segment_actions(segment: str | Column = "segment") -> Column:
    pairs = [x for name, acts in fv.SEGMENT_ACTIONS.items() for x in (F.lit(name), F.array(*[F.lit(a) for a in acts]))]
    return F.try_element_at(F.create_map(*pairs), as_col(segment))


def segment_counts(segmented: DataFrame) -> DataFrame:
    """Population of every segment, empty ones kept."""
    spark = segmented.sparkSession
    names = spark.createDataFrame([(s,) for s in fv.SEGMENT_ACTIONS], "segment string")
    counts = segmented.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"))
    return names.join(counts, "segment", "left").withColumn("customers", F.coalesce("customers", F.lit(0)))


def peak_hour(orders: DataFrame) -> DataFrame:
    """Most frequent order hour per user; ties go to the earlier hour."""
    hours = orders.groupBy("user_id", F.hour("created_at").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return ordered.top_n(hours, ["user_id"], [F.desc("n"), F.asc("hour")], 1).select("user_id", F.col("hour").alias("peak_hour"))


def shopping_behaviour(users: DataFrame, orders: DataFrame, items: DataFrame, cart: DataFrame, wishlist: DataFrame) -> DataFrame:
    """Time preference, cart abandonment and wishlist conversion per user.

    Abandonment is the share of distinct cart products never bought; conversion counts distinct
    wished products that were bought, per wishlist row.
    """
    bought = joins.items_with_user(items.select("order_id", "product_id"), orders).select("user_id", "product_id").distinct()
    bought = bought.withColumn("_hit", F.lit(1))

    def kept(rows, name):
        pairs = rows.groupBy("user_id", "product_id").agg(F.count(F.lit(1)).alias("_rows"))
        return pairs.join(bought, ["user_id", "product_id"], "left").groupBy("user_id").agg(
            F.sum("_rows").alias(f"{name}_size"),
            F.count(F.lit(1)).alias(f"_{name}_products"),
            F.count("_hit").alias(f"_{name}_bought"),
        )

    counts = orders.groupBy("user_id").agg(F.count(F.lit(1)).alias("total_orders"))
    out = users.select(F.col("id").alias("user_id"))
    for part in (counts, peak_hour(orders), kept(cart, "cart"), kept(wishlist, "wishlist")):
        out = out.join(part, "user_id", "left")
    abandoned = 1 - ratio("_cart_bought", "_cart_products")
    return out.select(
        "user_id",
        labels.time_of_day("peak_hour").alias("time_preference"),
        F.coalesce(F.round(abandoned * 100, 2), F.lit(0.0)).alias("cart_abandonment_rate"),
        F.coalesce(F.round(ratio("_wishlist_bought", "wishlist_size") * 100, 2), F.lit(0.0)).alias("wishlist_conversion_rate"),
        F.coalesce("cart_size", F.lit(0)).alias("avg_cart_size"),
        F.coalesce("wishlist_size", F.lit(0)).alias("wishlist_size"),
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
    )


def price_sensitivity(users: DataFrame, orders: DataFrame) -> DataFrame:
    aov = orders.groupBy(F.col("user_id").alias("id")).agg(money_avg("total_amount").alias("aov"))
    return users.select("id").join(aov, "id", "left").select(
        F.col("id").alias("user_id"), labels.price_sensitivity("aov").alias("price_sensitivity")
    )


def category_affinity(items_user: DataFrame) -> DataFrame:
    """Share of each category in a user's units, with rank."""
    counts = metrics.category_quantities(items_user).withColumnRenamed("items_bought", "count")
    by_user = Window.partitionBy("user_id")
    return counts.withColumn(
        "affinity_score", F.round(F.col("count") / F.sum("count").over(by_user) * 100, 2)
    ).withColumn("rank", F.row_number().over(by_user.orderBy(F.desc("count"), "category")))


def behaviour_hints(behaviour: DataFrame, sensitivity: DataFrame, favourite: DataFrame) -> DataFrame:
    """Action hints per user, in rule order."""
    df = behaviour.join(sensitivity, "user_id").join(favourite.select("user_id", "category"), "user_id", "left")
    hints = some_of(
        (F.col("price_sensitivity") == "budget_conscious", F.lit("Show budget-friendly options and discounts")),
        (F.col("price_sensitivity") == "premium_shopper", F.lit("Highlight premium and exclusive products")),
        (F.col("cart_abandonment_rate") > 50, F.lit("Send cart abandonment reminders with incentives")),
        (F.col("wishlist_conversion_rate") < 30, F.lit("Promote wishlist items with discounts")),
        (F.col("category").isNotNull(), F.concat(F.lit("Prioritize "), "category", F.lit(" recommendations"))),
        (F.col("time_preference") != "unknown", F.concat(F.lit("Send promotions during "), "time_preference")),
    )
    return df.select("user_id", hints.alias("hints"))


def churn_list(users: DataFrame, orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Customers whose additive churn score passes 50."""
    seen = orders.groupBy("user_id").agg(
        F.max("created_at").alias("last_order_date"), count_if(since("created_at", as_of, days=60)).alias("_recent")
    )
    idle = whole_days("last_order_date", as_of_ts(as_of))
    scored = seen.withColumn("days_since_last_order", idle)
    d = F.col("days_since_last_order")
    score = (
        F.when(d > 60, 50).otherwise(0)
        + F.when(d > 30, 30).otherwise(0)
        + F.when((F.col("_recent") == 0) & (d > 30), 20).otherwise(0)
    )
    scored = scored.withColumn("risk_score", score).filter("risk_score > 50")
    return scored.join(users.select(F.col("id").alias("user_id"), "email"), "user_id").select(
        "user_id", "email", "risk_score", "days_since_last_order", "last_order_date"
    )


def suspicious_users(users: DataFrame, orders: DataFrame, activities: DataFrame, as_of: AsOf, activity_as_of: AsOf | None = None) -> DataFrame:
    """Failed-login bursts, cancellation bursts and old accounts with a sudden run of orders, last 24 hours."""
    login_time = as_of if activity_as_of is None else activity_as_of

    def burst(rows, kind, limit, severity, text):
        hit = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") >= limit)
        return hit.select(
            "user_id", F.lit(kind).alias("type"), "count", F.lit(severity).alias("severity"),
            F.format_string(text, "count").alias("message"),
        )

    recent = orders.filter(since("created_at", as_of, hours=24))
    old = users.filter(F.col("created_at") <= ago(as_of, days=90)).select(F.col("id").alias("user_id"))
    failed = activities.filter((F.col("activity_type") == "login_failed") & since("created_at", login_time, hours=24))
    found = (
        burst(failed, "multiple_failed_logins", 5, "high", "%d failed login attempts in last 24 hours")
        .unionByName(
            burst(recent.filter("status = 'Cancelled'"), "rapid_cancellations", 3, "medium", "%d orders cancelled in last 24 hours")
        )
        .unionByName(
            burst(recent, "sudden_activity_spike", 5, "medium", "Sudden activity: %d orders in last 24 hours after long inactivity")
            .join(old, "user_id", "left_semi")
        )
    )
    return found.join(users.select(F.col("id").alias("user_id"), "email"), "user_id")


def value_clusters(features: DataFrame) -> DataFrame:
    """Count and mean spend of each value cluster; all five clusters are kept."""
    spent, n, idle = F.col("total_spent"), F.col("total_orders"), F.col("recency_days")
    cluster = (
        F.when((spent > 50000) & (n > 20), 0).when((idle < 30) & (n > 5), 1).when(n < 3, 2).when(idle > 90, 4).otherwise(3)
    )
    names = ["VIP Customers", "Active Shoppers", "New Customers", "At Risk", "Inactive"]
    frame = features.sparkSession.createDataFrame(list(enumerate(names)), "cluster int, name string")
    sums = features.groupBy(cluster.alias("cluster")).agg(
        F.count(F.lit(1)).alias("count"), money_avg("total_spent").alias("avg_spend")
    )
    return frame.join(sums, "cluster", "left").withColumns(
        {"count": F.coalesce("count", F.lit(0)), "avg_spend": F.coalesce("avg_spend", F.lit(0.0))}
    )


def price_drop_alerts(old: DataFrame, new: DataFrame, wishlist: DataFrame, as_of: AsOf) -> DataFrame:
    """Alert every user who wished for a product whose price fell between two product snapshots."""
    drop = (
        old.select("id", F.col("price").alias("old_price"))
        .join(new.select("id", "name", F.col("price").alias("new_price")), "id")
        .filter("new_price < old_price")
    )
    drop = drop.withColumn("discount_percent", F.round(ratio(F.col("old_price") - F.col("new_price"), "old_price") * 100, 2))
    wanted = wishlist.select("user_id", F.col("product_id").alias("id")).distinct()
    return wanted.join(drop, "id").select(
        "user_id", F.col("id").alias("product_id"), F.lit("price_drop").alias("alert_type"), "old_price", "new_price", "discount_percent",
        F.concat(F.lit("Price drop on "), "name", F.lit("!")).alias("title"),
        F.when(F.col("discount_percent") > 20, "high").otherwise("medium").alias("priority"),
        (as_of_ts(as_of) + F.expr("interval 3 days")).alias("expires_at"),
    )


def back_in_stock_alerts(old: DataFrame, new: DataFrame, wishlist: DataFrame, as_of: AsOf) -> DataFrame:
    """Alert every user who wished for a product that went from no stock to some."""
    back = old.filter("stock = 0").select("id").join(new.filter("stock > 0").select("id", "name"), "id")
    wanted = wishlist.select("user_id", F.col("product_id").alias("id")).distinct()
    return wanted.join(back, "id").select(
        "user_id", F.col("id").alias("product_id"), F.lit("stock").alias("alert_type"),
        F.concat("name", F.lit(" is back in stock!")).alias("title"), F.lit("high").alias("priority"),
        (as_of_ts(as_of) + F.expr("interval 7 days")).alias("expires_at"),
    )
