"""Dashboard figures and report packs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import count_if, growth_pct, money_avg, money_sum, money_sum_if, pct, ratio, some_of
from ..functions.timeutil import AsOf, ago, as_of_ts, calendar, day, since
from ..operators import metrics, ordered
from ..operators.onerow import beside


def one_row(*frames: DataFrame) -> DataFrame:
    """Columns of several one-row frames side by side."""
    return beside(frames[0], *frames[1:])


def headline(users: DataFrame, products: DataFrame, orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Revenue, counts, profit at 20 %, average order, today's figures and active users of 30 days."""
    today = day("created_at") == as_of_ts(as_of).cast("date")
    sums = orders.agg(
        F.coalesce(money_sum("total_amount"), F.lit(0.0)).alias("total_revenue"),
        F.count(F.lit(1)).alias("total_orders"),
        money_sum_if(today, "total_amount").alias("today_revenue"),
        count_if(today).alias("today_orders"),
    )
    active = orders.filter(since("created_at", as_of, days=30)).agg(F.countDistinct("user_id").alias("active_users"))
    counts = [users.agg(F.count(F.lit(1)).alias("total_customers")), products.agg(F.count(F.lit(1)).alias("total_products"))]
    out = one_row(sums, active, *counts)
    return out.withColumns(
        {
            "profit": F.round(F.col("total_revenue") * 0.2, 2),
            "avg_order_value": F.coalesce(F.round(ratio("total_revenue", "total_orders"), 2), F.lit(0.0)),
        }
    )


def dense_daily(orders: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """Revenue and orders per day for the ``days`` days before ``as_of``, empty days as 0."""
    start = ago(as_of, days=days)
    per_day = orders.filter(F.col("created_at") >= start.cast("date")).groupBy(day("created_at").alias("date")).agg(
        money_sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders")
    )
    out = calendar(orders.sparkSession, start, days).join(per_day, "date", "left")
    return out.withColumns({"revenue": F.coalesce("revenue", F.lit(0.0)), "orders": F.coalesce("orders", F.lit(0))})


def customer_growth(users: DataFrame, as_of: AsOf, buckets: int = 6) -> DataFrame:
    """New customers in each of the last 30-day buckets, oldest first."""
    start = ago(as_of, days=buckets * 30)
    inside = users.filter((F.col("created_at") >= start) & (F.col("created_at") < as_of_ts(as_of)))
    seconds = F.timestamp_diff("SECOND", start, F.col("created_at"))
    counts = inside.groupBy(F.floor(seconds / (30 * 86400)).cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("new_customers"))
    frame = users.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    label = F.date_format(start + F.make_dt_interval(F.col("bucket") * 30), "yyyy-MM")
    return frame.join(counts, "bucket", "left").select(
        "bucket", label.alias("month"), F.coalesce("new_customers", F.lit(0)).alias("new_customers")
    )


def status_breakdown(orders: DataFrame, statuses: list[str] = fv.ORDER_STATUSES) -> DataFrame:
    """Orders per listed status, zeros kept."""
    frame = orders.sparkSession.createDataFrame([(s,) for s in statuses], "status string")
    counts = orders.groupBy("status").agg(F.count(F.lit(1)).alias("orders"))
    return frame.join(counts, "status", "left").withColumn("orders", F.coalesce("orders", F.lit(0)))


def insight_flags(orders: DataFrame, products: DataFrame, tickets: DataFrame, as_of: AsOf) -> DataFrame:
    """Insight texts whose threshold is passed, one per row."""
    kpi = one_row(
        orders.agg(F.coalesce(money_sum("total_amount"), F.lit(0.0)).alias("revenue"), F.count(F.lit(1)).alias("orders")),
        orders.filter(since("created_at", as_of, days=30)).agg(F.countDistinct("user_id").alias("active")),
        products.agg(count_if(F.col("stock") < 5).alias("low")),
        tickets.agg(count_if(F.col("status") == "Open").alias("open")),
    )
    margin = ratio(F.col("revenue") * 0.2, "revenue") * 100
    texts = some_of(
        (F.col("revenue") > 100000, F.lit(fv.INSIGHTS["revenue"])),
        (F.col("orders") > 500, F.lit(fv.INSIGHTS["orders"])),
        (F.col("low") > 10, F.format_string(fv.INSIGHTS["low_stock"], "low")),
        (F.col("active") > 50, F.lit(fv.INSIGHTS["retention"])),
        ((F.col("revenue") > 0) & (margin < 15), F.lit(fv.INSIGHTS["margin"])),
        (F.col("open") > 20, F.format_string(fv.INSIGHTS["tickets"], "open")),
    )
    return kpi.select(F.posexplode(texts).alias("pos", "insight"))


def period_metrics(orders: DataFrame, users: DataFrame, products: DataFrame, tickets: DataFrame, as_of: AsOf) -> DataFrame:
    """Today, the last 30 days, and the change against the 30 days before."""
    today = day("created_at") == as_of_ts(as_of).cast("date")
    month = since("created_at", as_of, days=30)
    before = since("created_at", as_of, days=60) & ~month
    sums = orders.agg(
        money_sum_if(F.lit(True), "total_amount").alias("revenue_total"),
        money_sum_if(today, "total_amount").alias("revenue_today"),
        money_sum_if(month, "total_amount").alias("revenue_month"),
        money_sum_if(before, "total_amount").alias("revenue_previous"),
        F.count(F.lit(1)).alias("orders_total"),
        count_if(today).alias("orders_today"),
        count_if(month).alias("orders_month"),
    )
    out = one_row(
        sums,
        users.agg(F.count(F.lit(1)).alias("customers_total"), count_if(month).alias("customers_new")),
        products.agg(F.count(F.lit(1)).alias("products_total"), count_if(F.col("stock") < 10).alias("low_stock")),
        tickets.agg(
            count_if(F.col("status") == "Open").alias("open_tickets"),
            count_if((F.col("status") == "Open") & (F.col("priority") == "High")).alias("high_priority"),
        ),
    )
    return out.withColumn("trend_percent", F.coalesce(F.round(growth_pct("revenue_month", "revenue_previous"), 1), F.lit(0.0)))


def seasonal_months(orders: DataFrame) -> DataFrame:
    """Mean completed revenue per calendar month over the years, with peak and low flags."""
    months = metrics.completed_orders(orders).groupBy(F.date_format("created_at", "yyyy-MM").alias("ym")).agg(
        money_sum("total_amount").alias("revenue")
    )
    by_month = months.groupBy(F.substring("ym", 6, 2).cast("int").alias("month")).agg(
        F.count(F.lit(1)).alias("years"), money_avg("revenue").alias("revenue")
    )
    mean = F.avg("revenue").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = ratio("revenue", "mean")
    kind = F.when(level > 1.2, "peak").when(level < 0.8, "low")
    return by_month.withColumn("mean", mean).select("month", "years", "revenue", level.alias("level"), kind.alias("type"))


def trend_pack(orders: DataFrame, items: DataFrame, products: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """Completed sales of the last days by day, by hour and by category, as (kind, label, orders, units, revenue)."""
    done = metrics.completed_orders(orders).filter(since("created_at", as_of, days=days))
    parts = done.select(
        "total_amount", day("created_at").cast("string").alias("day"), F.lpad(F.hour("created_at").cast("string"), 2, "0").alias("hour")
    )
    by_time = parts.groupingSets([["day"], ["hour"]], "day", "hour").agg(
        F.count(F.lit(1)).alias("orders"), F.lit(None).cast("bigint").alias("units"), money_sum("total_amount").alias("revenue")
    )
    by_time = by_time.select(
        F.when(F.col("day").isNotNull(), "day").otherwise("hour").alias("kind"), F.coalesce("day", "hour").alias("label"), "orders", "units", "revenue"
    )
    sold = items.join(done.select(F.col("id").alias("order_id")), "order_id", "left_semi").groupBy("product_id").agg(
        F.sum("quantity").alias("units"), money_sum(metrics.line_value()).alias("revenue")
    )
    by_category = sold.join(products.select(F.col("id").alias("product_id"), "category"), "product_id").groupBy("category").agg(
        F.sum("units").alias("units"), money_sum("revenue").alias("revenue")
    )
    return by_time.unionByName(
        by_category.select(F.lit("category").alias("kind"), F.col("category").alias("label"), F.lit(None).cast("bigint").alias("orders"), "units", "revenue")
    )


def payment_breakdown(orders: DataFrame) -> DataFrame:
    """Per method and in total (method NULL): orders, completed amount, pending amount, cash and online counts."""
    return orders.groupingSets([["payment_method"], []], "payment_method").agg(
        F.count(F.lit(1)).alias("orders"),
        money_sum_if(F.col("payment_status") == "Completed", "total_amount").alias("completed_amount"),
        money_sum_if(F.col("payment_status") == "Pending", "total_amount").alias("pending_amount"),
        count_if(F.col("payment_method") == "COD").alias("cod_orders"),
        count_if(F.col("payment_method") != "COD").alias("online_orders"),
    )


def order_counters(orders: DataFrame) -> DataFrame:
    names = {"pending_orders": "Processing", "shipped_orders": "Shipped", "delivered_orders": "Delivered", "cancelled_orders": "Cancelled"}
    return orders.agg(
        F.count(F.lit(1)).alias("total_orders"),
        money_sum_if(F.lit(True), "total_amount").alias("total_revenue"),
        *[count_if(F.col("status") == status).alias(name) for name, status in names.items()],
    )


def inventory_health(products: DataFrame) -> DataFrame:
    """Stock bands and value per category and overall (category NULL)."""
    stock = F.col("stock")
    return products.groupingSets([["category"], []], "category").agg(
        F.count(F.lit(1)).alias("products"),
        count_if((stock > 0) & (stock < 10)).alias("low_stock"),
        count_if(stock == 0).alias("out_of_stock"),
        count_if(stock >= 10).alias("healthy_stock"),
        money_sum(F.col("price") * stock).alias("value"),
    )


def category_stock(products: DataFrame) -> DataFrame:
    return products.groupBy("category").agg(F.sum("stock").alias("total_stock"), F.count(F.lit(1)).alias("total_products"))


def customer_page(users: DataFrame, orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Order count and spend of every customer, and whether they joined this month."""
    now = as_of_ts(as_of)
    sums = orders.groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("order_count"), money_sum("total_amount").alias("total_spent")
    )
    fresh = (F.year("created_at") == F.year(now)) & (F.month("created_at") == F.month(now))
    return users.filter(~F.col("is_admin")).join(sums, "id", "left").select(
        "id", "name", "email", fresh.alias("new_this_month"),
        F.coalesce("order_count", F.lit(0)).alias("order_count"), F.coalesce("total_spent", F.lit(0.0)).alias("total_spent"),
    )


def product_page(products: DataFrame) -> DataFrame:
    return products.agg(
        F.count(F.lit(1)).alias("total_products"),
        count_if(F.col("stock") < 10).alias("low_stock_count"),
        count_if(F.col("stock") == 0).alias("out_of_stock_count"),
        money_sum(F.col("price") * F.col("stock")).alias("total_value"),
        F.countDistinct("category").alias("categories"),
    )


def ticket_counters(tickets: DataFrame, as_of: AsOf) -> DataFrame:
    status = F.col("status")
    return tickets.agg(
        F.count(F.lit(1)).alias("total_tickets"),
        count_if(status == "Open").alias("open_tickets"),
        count_if((status == "Open") & (F.col("priority") == "High")).alias("high_priority"),
        count_if((status == "Resolved") & (F.col("created_at") >= as_of_ts(as_of))).alias("resolved_today"),
    )


def revenue_by_status(orders: DataFrame, statuses: list[str]) -> DataFrame:
    """Revenue of orders whose payment status is in the set, split by status."""
    return orders.filter(F.col("payment_status").isin(statuses)).groupBy("payment_status").agg(
        money_sum("total_amount").alias("revenue"), F.count(F.lit(1)).alias("orders")
    )


def _three_way(sentiment: str = "sentiment") -> Column:
    """Mixed and missing count as neutral."""
    low = F.lower(F.coalesce(sentiment, F.lit("neutral")))
    return F.when(low == "mixed", "neutral").otherwise(low)


def sentiment_distribution(reviews: DataFrame) -> DataFrame:
    """Reviews, share and mean rating per sentiment, with the overall mean rating."""
    parts = reviews.groupBy(_three_way().alias("sentiment")).agg(F.count(F.lit(1)).alias("reviews"), F.sum("rating").alias("_rating"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.select(
        "sentiment", "reviews",
        F.round(ratio("reviews", F.sum("reviews").over(whole)) * 100, 1).alias("percentage"),
        F.round(ratio(F.sum("_rating").over(whole), F.sum("reviews").over(whole)), 2).alias("average_rating"),
    )


def sentiment_trend(reviews: DataFrame, as_of: AsOf, days: int = 30) -> DataFrame:
    """Positive, neutral and negative reviews per day on a dense calendar that ends the day before ``as_of``."""
    start = ago(as_of, days=days)
    kept = reviews.filter((F.col("created_at") >= start) & (F.col("created_at") < as_of_ts(as_of)))
    names = ["positive", "neutral", "negative"]
    wide = kept.select(day("created_at").alias("date"), _three_way().alias("s")).groupBy("date").pivot("s", names).count()
    out = calendar(reviews.sparkSession, start, days).join(wide, "date", "left")
    return out.select("date", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def product_reviews(reviews: DataFrame) -> DataFrame:
    """Review count, mean rating and sentiment counts (as a map) per product."""
    parts = reviews.groupBy("product_id", F.coalesce("sentiment", F.lit("neutral")).alias("sentiment")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("r")
    )
    return parts.groupBy("product_id").agg(
        F.sum("n").alias("reviews"),
        F.round(ratio(F.sum("r"), F.sum("n")), 1).alias("average_rating"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("sentiment", "n")))).alias("sentiment_distribution"),
    )


def feedback_summary(tickets: DataFrame, activities: DataFrame) -> DataFrame:
    """Sentiment counts over tickets and text-tagged feedback activities."""
    kinds = ["feedback", "review", "review_submitted", "rating", "complaint"]
    text = F.lower(F.coalesce("activity_details", F.lit("")))

    def tagged(*marks):
        out = text.contains(marks[0])
        for mark in marks[1:]:
            out = out | text.contains(mark)
        return out

    label = (
        F.when(tagged("sentiment: positive", "sentiment=positive"), "positive")
        .when(tagged("sentiment: negative", "sentiment=negative"), "negative")
        .when(tagged("sentiment: neutral", "sentiment=mixed", "sentiment: mixed"), "neutral")
    )
    said = activities.filter(F.col("activity_type").isin(kinds)).select(label.alias("sentiment")).filter("sentiment IS NOT NULL")
    both = tickets.select(_three_way().alias("sentiment")).unionByName(said)
    return both.filter(F.col("sentiment").isin("positive", "neutral", "negative")).groupBy("sentiment").agg(F.count(F.lit(1)).alias("feedback"))


def chat_counts(chats: DataFrame) -> DataFrame:
    """Messages per sentiment and in total (sentiment NULL)."""
    return chats.select(F.coalesce("sentiment", F.lit("neutral")).alias("sentiment")).rollup("sentiment").agg(F.count(F.lit(1)).alias("chats"))


def customer_order_analytics(users: DataFrame, orders: DataFrame, items_user: DataFrame, top: int = 5) -> DataFrame:
    """Per customer: totals, status map, first categories, spend by month and offer flags.

    Arrays hold at most one entry per status, category rank or calendar month.
    """
    base = orders.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("total_orders"), money_sum("total_amount").alias("total_spent"), money_avg("total_amount").alias("avg_order_value"),
        F.avg(F.when(F.col("status") == "Delivered", fv.STATUS_DAYS["Delivered"])).alias("avg_delivery_days"),
    )
    statuses = orders.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n")).groupBy("user_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("order_status_breakdown")
    )
    months = orders.groupBy("user_id", F.date_format("created_at", "yyyy-MM").alias("month")).agg(
        money_sum("total_amount").alias("spent"), F.count(F.lit(1)).alias("orders")
    )
    months = months.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("month", "spent", "orders"))).alias("spending_trends"))
    ranked = ordered.top_n(metrics.category_quantities(items_user), ["user_id"], [F.desc("items_bought"), F.asc("category")], top, rank="rank")
    cats = ranked.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("rank", "category", "items_bought"))).alias("favorite_categories"))
    out = users.select(F.col("id").alias("user_id"))
    for part in (base, statuses, months, cats):
        out = out.join(part, "user_id", "left")
    offers = some_of(
        (F.size("favorite_categories") > 0, F.lit("category")),
        (F.col("total_spent") > 5000, F.lit("loyalty")),
        (F.col("total_orders") >= 5, F.lit("frequency")),
    )
    return out.withColumns(
        {
            "total_orders": F.coalesce("total_orders", F.lit(0)),
            "total_spent": F.coalesce("total_spent", F.lit(0.0)),
            "avg_order_value": F.coalesce("avg_order_value", F.lit(0.0)),
            "offers": offers,
        }
    )


def user_activity_summary(users: DataFrame, orders: DataFrame, activities: DataFrame, order_as_of: AsOf, activity_as_of: AsOf, days: int = 30) -> DataFrame:
    """Logins, orders and spend in the period with the last 20 activities (newest first)."""
    bought = orders.filter(since("created_at", order_as_of, days=days)).groupBy(F.col("user_id").alias("id")).agg(
        F.count(F.lit(1)).alias("orders_count"), money_sum("total_amount").alias("total_spent")
    )
    recent = activities.filter(since("created_at", activity_as_of, days=days))
    logins = recent.groupBy(F.col("user_id").alias("id")).agg(count_if(F.col("activity_type") == "login").alias("login_count"))
    last = ordered.top_n(recent, ["user_id"], [F.desc("created_at"), F.desc("id")], 20, rank="_pos")
    last = last.groupBy(F.col("user_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_pos", "activity_type", "activity_details", "created_at"))),
                    lambda x: F.struct(x["activity_type"].alias("type"), x["activity_details"].alias("details"), x["created_at"].alias("ts"))).alias("recent_activities")
    )
    out = users.select("id")
    for part in (bought, logins, last):
        out = out.join(part, "id", "left")
    return out.select(
        F.col("id").alias("user_id"), F.coalesce("login_count", F.lit(0)).alias("login_count"),
        F.coalesce("orders_count", F.lit(0)).alias("orders_count"), F.coalesce("total_spent", F.lit(0.0)).alias("total_spent"), "recent_activities",
    )


def lakehouse_dashboard(daily: DataFrame, c360: DataFrame, inventory: DataFrame, features: DataFrame) -> DataFrame:
    """Headline figures over the four curated tables."""
    sales = daily.agg(money_sum("total_revenue").alias("total_revenue"), F.sum("total_orders").alias("total_orders"))
    people = c360.agg(
        F.count(F.lit(1)).alias("active_customers"), count_if(F.col("rfm_segment") == "Champions").alias("vip_customers"),
        count_if(F.col("churn_risk_segment") == "High Risk").alias("at_risk_customers"),
    )
    goods = inventory.agg(
        count_if(F.col("stock_status").isin("Out of Stock", "Low Stock")).alias("products_critical_stock"),
        count_if(F.col("reorder_recommended")).alias("products_reorder_needed"),
    )
    odd = features.agg(count_if(F.col("is_any_anomaly")).alias("anomalies_detected"))
    return one_row(sales, people, goods, odd).withColumn("avg_order_value", F.round(ratio("total_revenue", "total_orders"), 2))


def file_summary(series: DataFrame) -> DataFrame:
    """Totals and period of a (date, revenue, orders) series."""
    out = series.agg(
        F.coalesce(money_sum("revenue"), F.lit(0.0)).alias("total_revenue"), F.coalesce(F.sum("orders"), F.lit(0)).alias("total_orders"),
        F.count(F.lit(1)).alias("records"), F.min("date").alias("period_start"), F.max("date").alias("period_end"),
    )
    return out.withColumn("avg_order_value", F.coalesce(F.round(ratio("total_revenue", "total_orders"), 2), F.lit(0.0)))


def document_stats(documents: DataFrame) -> DataFrame:
    """Counts per status, per type and in total, from one grouping-sets pass."""
    return documents.groupingSets([["status"], ["document_type"], []], "status", "document_type").agg(F.count(F.lit(1)).alias("documents"))


def newest_documents(documents: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` newest documents."""
    return ordered.top_n(documents, [], [F.desc("created_at"), F.desc("document_id")], n, rank="rank").select("rank", "document_id", "filename", "document_type", "status", "created_at")


def collection_stats(documents: DataFrame) -> DataFrame:
    return documents.groupBy("document_type").agg(
        F.count(F.lit(1)).alias("documents"), count_if(F.col("status") == "processed").alias("processed"), count_if(F.col("status") == "indexed").alias("indexed")
    )


def run_log_summary(runs: DataFrame) -> DataFrame:
    """Last status and start, success rate and number of runs per job."""
    latest = F.struct("start_time", "run_id")
    return runs.groupBy("pipeline_id").agg(
        F.max_by("status", latest).alias("status"), F.max("start_time").alias("last_run"),
        F.round(pct(count_if(F.col("status") == "success"), F.count(F.lit(1))), 1).alias("success_rate"), F.count(F.lit(1)).alias("total_runs"),
    )


def report_measures(sales: DataFrame) -> DataFrame:
    """Total revenue, distinct orders and their quotient over exported sales lines."""
    out = sales.agg(money_sum("total_amount").alias("total_revenue"), F.countDistinct("order_id").alias("total_orders"))
    return out.withColumn("average_order_value", ratio("total_revenue", "total_orders"))


def revenue_trend(sales: DataFrame) -> DataFrame:
    """Monthly revenue of exported sales lines with the change to the month before."""
    months = sales.groupBy(F.trunc("order_date", "month").alias("month")).agg(money_sum("total_amount").alias("revenue"))
    return ordered.add_pct_change(months, "revenue", "revenue_trend_pct", ["month"])


def day_change_alerts(orders: DataFrame, as_of: AsOf) -> DataFrame:
    """Alerts on the day before ``as_of`` against the day before that: revenue, orders, cancellations."""
    this = F.date_sub(as_of_ts(as_of).cast("date"), 1)
    last = F.date_sub(as_of_ts(as_of).cast("date"), 2)
    d = day("created_at")
    k = orders.filter(d.isin(this, last)).agg(
        money_sum_if(d == this, "total_amount").alias("r1"), money_sum_if(d == last, "total_amount").alias("r0"),
        count_if(d == this).alias("o1"), count_if(d == last).alias("o0"), count_if((d == this) & (F.col("status") == "Cancelled")).alias("c1"),
    )
    revenue, volume, cancel = growth_pct("r1", "r0"), growth_pct("o1", "o0"), pct("c1", "o1")

    def alert(kind, severity, text, change, value):
        return F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.format_string(text, change).alias("message"), F.round(value, 2).alias("value")
        )

    found = some_of(
        (F.abs(revenue) > 50, alert("revenue_anomaly", "high", "Revenue changed by %.1f%% compared to yesterday", revenue, F.col("r1"))),
        (F.abs(volume) > 50, alert("order_anomaly", "medium", "Order volume changed by %.1f%% compared to yesterday", volume, F.col("o1").cast("double"))),
        (cancel > 20, alert("cancellation_anomaly", "high", "High cancellation rate: %.1f%% today", cancel, cancel)),
    )
    return k.select(F.inline(found))


def order_hour_grid(orders: DataFrame, as_of: AsOf, days: int | None = 7) -> DataFrame:
    """Orders and outlying orders per weekday and hour, all 168 cells."""
    kept = orders if days is None else orders.filter(since("created_at", as_of, days=days))
    stats = kept.agg(money_avg("total_amount").alias("_mean"), F.stddev_pop("total_amount").alias("_std"))
    odd = F.abs(F.col("total_amount") - F.col("_mean")) > F.col("_std") * 2
    cells = beside(kept, stats).groupBy((F.dayofweek("created_at") - 1).alias("day_index"), F.hour("created_at").alias("hour")).agg(
        F.count(F.lit(1)).alias("order_count"), count_if(odd).alias("anomaly_count")
    )
    names = F.array(*[F.lit(n) for n in ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")])
    grid = orders.sparkSession.range(168).select((F.col("id") / 24).cast("int").alias("day_index"), (F.col("id") % 24).cast("int").alias("hour"))
    out = grid.join(cells, ["day_index", "hour"], "left").withColumns(
        {"order_count": F.coalesce("order_count", F.lit(0)), "anomaly_count": F.coalesce("anomaly_count", F.lit(0))}
    )
    rate = F.coalesce(F.round(pct("anomaly_count", "order_count"), 1), F.lit(0.0))
    return out.select(F.element_at(names, F.col("day_index") + 1).alias("day"), "day_index", "hour", "order_count", "anomaly_count", rate.alias("anomaly_rate"))


def hour_matrix(grid: DataFrame) -> DataFrame:
    """The grid as seven rows with one column per hour."""
    wide = grid.groupBy("day_index", "day").pivot("hour", list(range(24))).agg(F.first("order_count"))
    return wide.select("day_index", "day", *[F.col(f"`{h}`").alias(f"h{h:02d}") for h in range(24)])


def week_buckets(forecast: DataFrame, day_no: str = "step") -> DataFrame:
    """Sums of a forecast by week; the fourth bucket takes all that is left."""
    week = F.least(F.floor((F.col(day_no) - 1) / 7) + 1, F.lit(4)).alias("week")
    return forecast.groupBy(week).agg(F.sum("yhat").alias("forecast"), F.sum("yhat_lower").alias("lower"), F.sum("yhat_upper").alias("upper"))


