"""Joins, recommendations and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import count_if, money_sum
from ..operators import customers, joins, metrics, ordered, recommend
from . import shared as s
from .registry import add_cte, query


@query("J01_users_metrics", "SELECT u.id, m.* EXCLUDE (user_id) FROM r_users u LEFT JOIN s_cust_metrics m ON u.id = m.user_id")
def _(t):
    return joins.join_metrics(t.users.select("id"), metrics.customer_metrics(t.orders), "user_id")


@query("J02_products_sales", "SELECT p.id, m.* EXCLUDE (product_id) FROM r_products p LEFT JOIN s_product_sales m ON p.id = m.product_id")
def _(t):
    return joins.join_metrics(t.products.select("id"), metrics.product_sales(t.order_items), "product_id")


@query("J03_orders_rollup", "SELECT p.id, m.* EXCLUDE (order_id) FROM r_orders p LEFT JOIN s_rollup m ON p.id = m.order_id")
def _(t):
    return joins.join_metrics(t.orders.select("id"), metrics.order_item_rollup(t.order_items), "order_id")


@query("J04_enriched_items", """SELECT category, order_status, cast(created_at AS date) AS day, count(*) AS lines, sum(quantity)::bigint AS units
    FROM s_fact_items GROUP BY ALL""")
def _(t):
    rich = joins.enrich_items(t.order_items, t.products, t.orders)
    return rich.groupBy("category", "order_status", F.col("created_at").cast("date").alias("day")).agg(
        F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units")
    )


@query("J05_items_with_user", "SELECT user_id, count(*) AS lines, sum(quantity)::bigint AS units FROM s_items_user GROUP BY 1")
def _(t):
    sold = joins.items_with_user(t.order_items, t.orders)
    return sold.groupBy("user_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("quantity").alias("units"))


@query("J06_customer_360_join", "SELECT id, recency, rfm_segment, favorite_category FROM s_c360")
def _(t):
    favourite = customers.favourite_category(joins.items_with_user(s.fact_items(t), t.orders))
    rfm = customers.rfm_scores(t.orders, t.as_of).select("user_id", "recency", "rfm_segment")
    return joins.assemble_customer_360(t.users.select("id"), rfm, favourite)


@query("J07_daily_with_profit", """SELECT d.created_at, d.total_revenue, p.item_revenue, p.total_profit FROM s_daily_sales d
    LEFT JOIN s_daily_profit p ON d.created_at = p.created_at""")
def _(t):
    daily = metrics.daily_sales(t.orders, metrics.order_item_rollup(t.order_items)).select("created_at", "total_revenue")
    return daily.join(metrics.daily_profit(s.fact_items(t)).drop("avg_profit_margin"), "created_at", "left")


@query("J08_orphan_keys", """SELECT 'order_items.order_id' AS reference, count(*) AS orphans FROM (SELECT DISTINCT order_id FROM r_items
    WHERE order_id NOT IN (SELECT id FROM r_orders)) UNION ALL SELECT 'cart_items.product_id', count(*) FROM (SELECT DISTINCT product_id FROM r_cart
    WHERE product_id NOT IN (SELECT id FROM r_products)) UNION ALL SELECT 'reviews.order_id', count(*) FROM (SELECT DISTINCT order_id FROM r_reviews
    WHERE order_id NOT IN (SELECT id FROM r_orders WHERE status = 'Delivered'))""")
def _(t):
    delivered = t.orders.filter("status = 'Delivered'")
    checks = [
        ("order_items.order_id", joins.orphan_keys(t.order_items, "order_id", t.orders, "id")),
        ("cart_items.product_id", joins.orphan_keys(t.cart_items, "product_id", t.products, "id")),
        ("reviews.order_id", joins.orphan_keys(t.reviews, "order_id", delivered, "id")),
    ]
    frames = [df.agg(F.count(F.lit(1)).alias("orphans")).withColumn("reference", F.lit(name)) for name, df in checks]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query("J09_orders_with_and_without_items", """SELECT order_number, id IN (SELECT order_id FROM r_items) AS has_items FROM r_orders""")
def _(t):
    with_items = joins.orders_with_items(t.orders, t.order_items).select("order_number", F.lit(True).alias("has_items"))
    return with_items.unionByName(joins.orders_without_items(t.orders, t.order_items).select("order_number", F.lit(False).alias("has_items")))


@query("J10_review_eligibility", """WITH q AS (SELECT o.user_id, r.order_id, r.product_id FROM r_reviews r JOIN r_orders o ON r.order_id = o.id
    UNION SELECT user_id, order_id, product_id FROM s_items_user UNION SELECT user_id, order_id, product_id FROM r_reviews),
    b AS (SELECT DISTINCT order_id, product_id FROM r_items), d AS (SELECT DISTINCT user_id, order_id, product_id FROM r_reviews),
    z AS (SELECT q.*, o.status, CASE WHEN o.id IS NULL THEN 'Order not found' WHEN o.status <> 'Delivered' THEN
        'Order status is ''' || o.status || '''. Only delivered orders can be reviewed.' WHEN b.order_id IS NULL THEN 'Product not found in this order'
        WHEN d.order_id IS NOT NULL THEN 'You have already reviewed this product' END AS reason
        FROM q LEFT JOIN r_orders o ON q.order_id = o.id AND q.user_id = o.user_id LEFT JOIN b ON q.order_id = b.order_id AND q.product_id = b.product_id
        LEFT JOIN d ON q.user_id = d.user_id AND q.order_id = d.order_id AND q.product_id = d.product_id)
    SELECT *, reason IS NULL AS eligible FROM z""")
def _(t):
    keys = ["user_id", "order_id", "product_id"]
    owners = t.orders.select(F.col("id").alias("order_id"), "user_id")
    asked = (
        t.reviews.select("order_id", "product_id").join(owners, "order_id").select(*keys)
        .unionByName(joins.items_with_user(t.order_items, t.orders).select(*keys))
        .unionByName(t.reviews.select(*keys))
        .distinct()
    )
    return joins.review_eligibility(asked, t.orders, t.order_items, t.reviews)


@query("J11_cart_lines", """SELECT c.id, c.user_id, c.product_id, c.quantity, c.created_at, p.name, p.price, p.stock, p.price * c.quantity AS line_total
    FROM r_cart c JOIN r_products p ON c.product_id = p.id""")
def _(t):
    return joins.cart_lines(t.cart_items, t.products)


@query("J11_cart_totals", """SELECT u.id AS user_id, u.email, sum(c.quantity)::bigint AS total_items, msum(p.price * c.quantity) AS subtotal
    FROM r_cart c JOIN r_products p ON c.product_id = p.id JOIN r_users u ON c.user_id = u.id GROUP BY 1, 2""")
def _(t):
    return joins.cart_totals(t.cart_items, t.products, t.users)


COPURCHASE = """WITH l AS (SELECT order_id, product_id, count(*) AS lines FROM r_items GROUP BY 1, 2),
    f AS (SELECT a.product_id, b.product_id AS other_id, sum(b.lines)::bigint AS frequency FROM l a JOIN l b ON a.order_id = b.order_id
        AND a.product_id <> b.product_id GROUP BY 1, 2),
    best AS (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY frequency DESC, other_id) AS rank FROM f QUALIFY rank <= 4),
    fb AS (SELECT p.id AS product_id, q.id AS other_id, 0::bigint AS frequency, row_number() OVER (PARTITION BY p.id ORDER BY q.stock DESC, q.id) AS rank
        FROM r_products p JOIN r_products q ON p.category = q.category AND p.id <> q.id AND q.stock > 0
        WHERE p.id NOT IN (SELECT product_id FROM best) QUALIFY rank <= 4)
    SELECT product_id, other_id, frequency, rank, 'orders' AS source FROM best UNION ALL SELECT *, 'category' FROM fb"""


@query("J12_copurchase", COPURCHASE)
def _(t):
    return recommend.copurchase(t.order_items, t.products, 4)


@query("J12_copurchase_large_orders", COPURCHASE)
def _(t):
    return recommend.copurchase(t.order_items, t.products, 4, block=4)


@query("J13_category_neighbours", """SELECT p.id AS product_id, q.id AS other_id, row_number() OVER (PARTITION BY p.id ORDER BY q.id) AS rank
    FROM r_products p JOIN r_products q ON p.category = q.category AND p.id <> q.id QUALIFY rank <= 6""")
def _(t):
    return recommend.category_neighbours(t.products, 6)


@query("J14_recommend_unseen", """WITH bought AS (SELECT DISTINCT user_id, product_id FROM s_items_user),
    cats AS (SELECT DISTINCT user_id, category FROM s_items_user),
    own AS (SELECT c.user_id, p.id AS product_id, row_number() OVER (PARTITION BY c.user_id ORDER BY stock DESC, created_at DESC, p.id) AS rank
        FROM cats c JOIN r_products p ON c.category = p.category AND p.stock > 0 ANTI JOIN bought b ON c.user_id = b.user_id AND p.id = b.product_id
        QUALIFY rank <= 8),
    gen AS (SELECT id AS product_id, row_number() OVER (ORDER BY stock DESC, created_at DESC, id) AS rank FROM r_products QUALIFY rank <= 8)
    SELECT user_id, product_id, rank, 'category' AS source FROM own UNION ALL
    SELECT u.id, g.product_id, g.rank, 'popular' FROM r_users u, gen g WHERE u.id NOT IN (SELECT user_id FROM own)""")
def _(t):
    return recommend.recommend_unseen(t.users, t.orders, t.order_items, t.products, 8)


add_cte("s_behaviour", """SELECT u.id AS user_id,
    CASE WHEN h.hour IS NULL THEN 'unknown' WHEN h.hour BETWEEN 6 AND 11 THEN 'morning' WHEN h.hour BETWEEN 12 AND 16 THEN 'afternoon'
        WHEN h.hour BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_preference,
    coalesce(round((1 - c.bought / c.products) * 100, 2), 0.0) AS cart_abandonment_rate,
    coalesce(round(w.bought / w.n * 100, 2), 0.0) AS wishlist_conversion_rate,
    coalesce(c.n, 0) AS avg_cart_size, coalesce(w.n, 0) AS wishlist_size, coalesce(o.total_orders, 0) AS total_orders
    FROM r_users u LEFT JOIN (SELECT user_id, count(*) AS total_orders FROM r_orders GROUP BY 1) o ON u.id = o.user_id
    LEFT JOIN (SELECT user_id, hour(created_at) AS hour, count(*) AS n FROM r_orders GROUP BY 1, 2
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, hour) = 1) h ON u.id = h.user_id
    LEFT JOIN (SELECT user_id, count(*) AS n, count(DISTINCT product_id) AS products,
        count(DISTINCT CASE WHEN (user_id, product_id) IN (SELECT (user_id, product_id) FROM s_items_user) THEN product_id END) AS bought
        FROM r_cart GROUP BY 1) c ON u.id = c.user_id
    LEFT JOIN (SELECT user_id, count(*) AS n,
        count(DISTINCT CASE WHEN (user_id, product_id) IN (SELECT (user_id, product_id) FROM s_items_user) THEN product_id END) AS bought
        FROM r_wishlist GROUP BY 1) w ON u.id = w.user_id""")


@query("J15_cart_and_wishlist_match", "SELECT user_id, cart_abandonment_rate, wishlist_conversion_rate FROM s_behaviour")
def _(t):
    seen = customers.shopping_behaviour(t.users, t.orders, t.order_items, t.cart_items, t.wishlist_items)
    return seen.select("user_id", "cart_abandonment_rate", "wishlist_conversion_rate")


@query("J16_users_with_roles", """SELECT u.id, u.name, u.email, u.is_admin, coalesce(r.roles, CASE WHEN is_admin THEN 'admin' ELSE 'customer' END) AS roles,
    u.created_at, a.last_activity FROM r_users u LEFT JOIN (SELECT user_id, string_agg(DISTINCT name, ',' ORDER BY name) AS roles
    FROM r_user_roles JOIN r_roles ON role_id = id GROUP BY 1) r ON u.id = r.user_id
    LEFT JOIN (SELECT user_id, max(created_at) AS last_activity FROM r_activities GROUP BY 1) a ON u.id = a.user_id""")
def _(t):
    return joins.users_with_roles(t.users, t.roles, t.user_roles, t.activities).withColumn("roles", F.array_join("roles", ","))


@query("J17_effective_permissions", f"""SELECT id AS user_id, unnest({fv.PERMISSIONS}) AS permission FROM r_users WHERE is_admin UNION ALL
    SELECT * FROM (SELECT DISTINCT u.id, unnest(from_json(permissions, '["varchar"]')) FROM r_users u JOIN r_user_roles ur ON u.id = ur.user_id
    JOIN r_roles r ON ur.role_id = r.id WHERE NOT u.is_admin)""")
def _(t):
    return joins.effective_permissions(t.users, t.roles, t.user_roles)


@query("J18_prior_order_count", """SELECT id, user_id, created_at, count(*) OVER (PARTITION BY user_id ORDER BY created_at
    RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS user_history FROM r_orders""")
def _(t):
    return ordered.prior_count(t.orders.select("id", "user_id", "created_at"), "user_id", "created_at", "user_history")


@query("J19_repair_missing_items", """WITH e AS (SELECT * FROM r_orders WHERE id NOT IN (SELECT order_id FROM r_items)),
    s AS (SELECT o.id, o.order_number, o.created_at, m.price * (1 + o.id % 5) AS total_amount FROM e o JOIN r_products m ON m.id = o.id % 100),
    t AS (SELECT *, total_amount / q AS exact, round(total_amount / q, 2) AS unit_price FROM s, (SELECT unnest([4, 3, 2, 1]) AS q)),
    p AS (SELECT round(price * 100)::bigint AS cents, max(id) AS pid, arg_max(name, id) AS name, arg_max(sizes, id) AS sizes FROM r_products GROUP BY 1)
    SELECT t.id AS order_id, pid AS product_id, name AS product_name, CASE WHEN sizes = '' THEN 'Standard' ELSE split_part(sizes, ',', 1) END AS size,
    q AS quantity, unit_price FROM t JOIN p ON round(unit_price * 100)::bigint = cents WHERE abs(exact - unit_price) <= 1e-6
    QUALIFY row_number() OVER (PARTITION BY t.id ORDER BY q DESC) = 1""")
def _(t):
    # Totals of the orders without lines are set to a multiple of a list price, so that some can be repaired.
    price = t.products.select((F.col("id")).alias("_p"), "price")
    total = (F.col("price") * (1 + F.col("id") % 5)).alias("total_amount")
    orders = t.orders.withColumn("_p", F.col("id") % 100).join(price, "_p").select("id", "order_number", total)
    return joins.repair_missing_items(orders, t.order_items, t.products)


@query("J21_campaign_lookup", f"""SELECT user_id, segment, CASE segment {' '.join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in fv.SEGMENT_CAMPAIGNS.items())} END AS title
    FROM s_segments""")
def _(t):
    titles = {k: v[0] for k, v in fv.SEGMENT_CAMPAIGNS.items()}
    return segments(t).withColumn("title", joins.lookup(F.col("segment"), titles)).select("user_id", "segment", "title")


def segments(t):
    features = customers.customer_features(t.users, t.orders, t.order_items, t.products, t.as_of)
    return features.select("user_id", customers.customer_segment().alias("segment"))


add_cte("s_cfeat", """SELECT u.id AS user_id, coalesce(o.total_orders, 0) AS total_orders, coalesce(o.total_spent, 0.0) AS total_spent,
    coalesce(o.total_spent / o.total_orders, 0.0) AS avg_order_value, coalesce(o.total_orders / o.months, 0.0) AS order_frequency,
    coalesce(o.recency_days, 999) AS recency_days, coalesce(l.diversity, 0) AS category_diversity,
    coalesce(l.lines / o.total_orders, 0.0) AS avg_items_per_order, coalesce(o.cancelled / o.total_orders, 0.0) AS return_rate
    FROM r_users u LEFT JOIN (SELECT user_id, count(*) AS total_orders, msum(total_amount) AS total_spent,
        greatest(1.0::double, floor(epoch(AS_OF - min(created_at)) / 86400) / 30) AS months,
        floor(epoch(AS_OF - max(created_at)) / 86400)::bigint AS recency_days,
        count(*) FILTER (status = 'Cancelled') AS cancelled FROM r_orders GROUP BY 1) o ON u.id = o.user_id
    LEFT JOIN (SELECT user_id, count(DISTINCT category) AS diversity, count(*) AS lines FROM s_items_user GROUP BY 1) l ON u.id = l.user_id""")
add_cte("s_segments", """SELECT *, CASE WHEN total_orders = 0 THEN 'new_customer' WHEN total_spent > 10000 AND order_frequency > 2 THEN 'vip_customer'
    WHEN total_spent > 5000 AND order_frequency > 1 THEN 'high_value' WHEN recency_days < 30 AND order_frequency > 1 THEN 'active_shopper'
    WHEN recency_days > 90 THEN 'at_risk' WHEN category_diversity >= 3 THEN 'explorer' WHEN category_diversity = 1 THEN 'niche_shopper'
    ELSE 'regular_customer' END AS segment FROM s_cfeat""")


@query("J22_segment_recommendations", """WITH pop AS (SELECT row_number() OVER (ORDER BY stock DESC, created_at DESC, id) AS rank, id FROM r_products QUALIFY rank <= 8),
    prem AS (SELECT row_number() OVER (ORDER BY created_at DESC, id) AS rank, id FROM r_products WHERE price > 2000 QUALIFY rank <= 8),
    shelf AS (SELECT category, arg_min(id, (-stock, id)) AS id FROM r_products GROUP BY 1),
    expl AS (SELECT row_number() OVER (ORDER BY category) AS rank, id, category FROM shelf QUALIFY rank <= 8),
    shared AS (SELECT 'new_customer' AS segment, rank, id, 'Trending Now' AS reason FROM pop UNION ALL SELECT s, rank, id, 'Premium Selection' FROM prem,
        (SELECT unnest(['vip_customer', 'high_value']) AS s) UNION ALL SELECT 'explorer', rank, id, 'Try ' || category FROM expl),
    a AS (SELECT user_id, category FROM s_favourite), n AS (SELECT category, id, row_number() OVER (PARTITION BY category ORDER BY created_at DESC, id) AS rank
        FROM r_products QUALIFY rank <= 8),
    o AS (SELECT * FROM s_segments WHERE segment NOT IN ('new_customer', 'vip_customer', 'high_value', 'active_shopper', 'explorer')),
    lo AS (SELECT user_id, id FROM r_orders QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) = 1),
    bk AS (SELECT DISTINCT lo.user_id, i.product_id FROM lo JOIN r_items i ON lo.id = i.order_id),
    nb AS (SELECT p.id AS product_id, q.id AS other_id, row_number() OVER (PARTITION BY p.id ORDER BY q.id) AS rank FROM r_products p
        JOIN r_products q ON p.category = q.category AND p.id <> q.id QUALIFY rank <= 2),
    sim AS (SELECT o.user_id, o.segment, other_id AS product_id, 0 AS tier, min((nb.product_id, nb.rank)) AS pos FROM o JOIN bk ON o.user_id = bk.user_id
        JOIN nb ON bk.product_id = nb.product_id GROUP BY 1, 2, 3),
    st AS (SELECT id, row_number() OVER (ORDER BY stock DESC, id) AS b FROM r_products QUALIFY b <= 8),
    mixed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY tier, pos, product_id) AS rank FROM (SELECT * FROM sim UNION ALL
        SELECT o.user_id, o.segment, st.id, 1, (0, st.b) FROM o, st) QUALIFY rank <= 8)
    SELECT g.user_id, g.segment, h.rank, h.id AS product_id, h.reason FROM s_segments g JOIN shared h ON g.segment = h.segment UNION ALL
    SELECT g.user_id, g.segment, n.rank, n.id, 'New in ' || a.category FROM s_segments g JOIN a ON g.user_id = a.user_id JOIN n ON a.category = n.category
        WHERE g.segment = 'active_shopper' UNION ALL
    SELECT g.user_id, g.segment, w.rank, w.id, 'New Arrivals' FROM s_segments g, (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM r_products QUALIFY rank <= 8) w
        WHERE g.segment = 'active_shopper' AND g.user_id NOT IN (SELECT user_id FROM a) UNION ALL
    SELECT user_id, segment, rank, product_id, CASE tier WHEN 0 THEN 'Similar to your purchase' ELSE 'Trending' END FROM mixed""")
def _(t):
    affinity = customers.category_affinity(joins.items_with_user(s.fact_items(t), t.orders))
    return recommend.segment_recommendations(segments(t), affinity, t.orders, t.order_items, t.products, 8)


@query("U02_distinct_categories", "SELECT DISTINCT category FROM r_products")
def _(t):
    return t.products.select("category").distinct()


@query("U03_dedup_reviews", """SELECT id, user_id, product_id, created_at FROM r_reviews
    QUALIFY row_number() OVER (PARTITION BY user_id, product_id ORDER BY created_at, id) = 1""")
def _(t):
    return joins.dedup_first(t.reviews.select("id", "user_id", "product_id", "created_at"), ["user_id", "product_id"], ["created_at", "id"])


@query("U05_duplicate_keys", "SELECT order_id, product_id, count(*) AS copies FROM r_items GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return joins.duplicate_keys(t.order_items, ["order_id", "product_id"])


@query("U06_wishlist_purchased", "SELECT user_id, product_id FROM r_wishlist INTERSECT SELECT user_id, product_id FROM s_items_user")
def _(t):
    return joins.wishlist_purchased(t.wishlist_items, joins.items_with_user(t.order_items, t.orders))


@query("F05_status_counts", "SELECT status, count(*) AS orders, msum(total_amount) AS revenue, count(*) FILTER (return_status = 'Approved') AS returned FROM r_orders GROUP BY 1")
def _(t):
    return t.orders.groupBy("status").agg(
        F.count(F.lit(1)).alias("orders"), money_sum("total_amount").alias("revenue"), count_if(F.col("return_status") == "Approved").alias("returned")
    )
