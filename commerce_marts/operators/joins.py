"""Joins of the retail model. Aggregates run before joins, so most joins are one to one; join
strategy and skew splitting are left to the optimizer, which broadcasts a side only by its size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.money import money_sum
from .ordered import top_n


def join_metrics(entities: DataFrame, metrics: DataFrame, key: str, zero: dict[str, object] = {}) -> DataFrame:
    """Left join of one metric row per entity; ``zero`` gives defaults for entities without facts."""
    out = entities.join(metrics.withColumnRenamed(key, "id"), "id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in zero.items()})


def enrich_items(items: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """Lines with category, order date and order status."""
    return items.join(
        products.select(F.col("id").alias("product_id"), "category"), "product_id", "left"
    ).join(
        orders.select(F.col("id").alias("order_id"), "created_at", F.col("status").alias("order_status")), "order_id", "left"
    )


def items_with_user(items: DataFrame, orders: DataFrame) -> DataFrame:
    return items.join(orders.select(F.col("id").alias("order_id"), "user_id"), "order_id")


def assemble_customer_360(customers: DataFrame, rfm: DataFrame, favourite: DataFrame) -> DataFrame:
    return customers.join(rfm.withColumnRenamed("user_id", "id"), "id", "left").join(
        favourite.select(F.col("user_id").alias("id"), F.col("category").alias("favorite_category")), "id", "left"
    )


def orphan_keys(child: DataFrame, child_col: str, parent: DataFrame, parent_col: str) -> DataFrame:
    """Distinct child keys without a parent row."""
    keys = child.select(F.col(child_col).alias("key")).filter("key IS NOT NULL").distinct()
    return keys.join(parent.select(F.col(parent_col).alias("key")), "key", "left_anti")


def orders_with_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    return orders.join(items.select(F.col("order_id").alias("id")), "id", "left_semi")


def orders_without_items(orders: DataFrame, items: DataFrame) -> DataFrame:
    return orders.join(items.select(F.col("order_id").alias("id")), "id", "left_anti")


def review_eligibility(requests: DataFrame, orders: DataFrame, items: DataFrame, reviews: DataFrame) -> DataFrame:
    """May this user review this product of this order? One row per request with the first reason against."""
    own = orders.select(F.col("id").alias("order_id"), "user_id", "status")
    bought = items.select("order_id", "product_id").distinct().withColumn("_bought", F.lit(True))
    done = reviews.select("user_id", "order_id", "product_id").distinct().withColumn("_done", F.lit(True))
    seen = (
        requests.join(own, ["order_id", "user_id"], "left")
        .join(bought, ["order_id", "product_id"], "left")
        .join(done, ["user_id", "order_id", "product_id"], "left")
    )
    reason = (
        F.when(F.col("status").isNull(), "Order not found")
        .when(
            F.col("status") != "Delivered",
            F.concat(F.lit("Order status is '"), "status", F.lit("'. Only delivered orders can be reviewed.")),
        )
        .when(F.col("_bought").isNull(), "Product not found in this order")
        .when(F.col("_done").isNotNull(), "You have already reviewed this product")
    )
    return seen.withColumns({"reason": reason, "eligible": reason.isNull()}).drop("_bought", "_done")


def cart_lines(cart: DataFrame, products: DataFrame) -> DataFrame:
    """Cart rows with product data and line total."""
    goods = products.select(F.col("id").alias("product_id"), "name", "price", "stock")
    return cart.join(goods, "product_id").withColumn("line_total", F.col("price") * F.col("quantity"))


def cart_totals(cart: DataFrame, products: DataFrame, users: DataFrame) -> DataFrame:
    """Items and subtotal of each user's cart."""
    sums = cart_lines(cart, products).groupBy("user_id").agg(
        F.sum("quantity").alias("total_items"), money_sum("line_total").alias("subtotal")
    )
    return sums.join(users.select(F.col("id").alias("user_id"), "email"), "user_id")


def wishlist_purchased(wishlist: DataFrame, items_user: DataFrame) -> DataFrame:
    """Distinct (user, product) pairs that were wished for and bought."""
    return wishlist.select("user_id", "product_id").intersect(items_user.select("user_id", "product_id"))


def users_with_roles(users: DataFrame, roles: DataFrame, user_roles: DataFrame, activities: DataFrame) -> DataFrame:
    """Role list and last activity per user; without roles the admin flag decides."""
    named = user_roles.join(roles.select(F.col("id").alias("role_id"), F.col("name").alias("role")), "role_id")
    held = named.groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_set("role")).alias("_roles"))
    seen = activities.groupBy(F.col("user_id").alias("id")).agg(F.max("created_at").alias("last_activity"))
    default = F.when(F.col("is_admin"), F.array(F.lit("admin"))).otherwise(F.array(F.lit("customer")))
    return (
        users.join(held, "id", "left")
        .join(seen, "id", "left")
        .withColumn("roles", F.coalesce("_roles", default))
        .select("id", "name", "email", "is_admin", "roles", "created_at", "last_activity")
    )


def effective_permissions(users: DataFrame, roles: DataFrame, user_roles: DataFrame) -> DataFrame:
    """One row per user and permission: administrators hold all, others the union over roles."""
    granted = roles.select(F.col("id").alias("role_id"), F.explode(F.from_json("permissions", "array<string>")).alias("permission"))
    plain = users.filter(~F.col("is_admin")).select(F.col("id").alias("user_id"))
    admins = users.filter("is_admin").select(
        F.col("id").alias("user_id"), F.explode(F.array(*[F.lit(p) for p in fv.PERMISSIONS])).alias("permission")
    )
    from_roles = plain.join(user_roles, "user_id").join(granted, "role_id").select("user_id", "permission").distinct()
    return admins.unionByName(from_roles)


def repair_missing_items(orders: DataFrame, items: DataFrame, products: DataFrame) -> DataFrame:
    """Guess the single line of an order without lines: a quantity of 4, 3, 2 or 1 whose price is a list price."""
    empty = orders_without_items(orders, items).select("id", "order_number", "total_amount")
    tries = empty.withColumn("quantity", F.explode(F.array(*[F.lit(q) for q in (4, 3, 2, 1)])))
    exact = F.col("total_amount") / F.col("quantity")
    tries = tries.withColumn("unit_price", F.round(exact, 2)).filter(F.abs(exact - F.col("unit_price")) <= 1e-6)
    cents = F.round(F.col("unit_price") * 100).cast("bigint")
    listed = products.groupBy(F.round(F.col("price") * 100).cast("bigint").alias("_cents")).agg(
        F.max_by(F.struct("id", "name", "sizes"), "id").alias("p")
    )
    found = tries.withColumn("_cents", cents).join(listed, "_cents")
    first_size = F.when(F.col("p.sizes") == "", F.lit("Standard")).otherwise(F.split("p.sizes", ",")[0])
    picked = found.select(
        F.col("id").alias("order_id"), F.col("p.id").alias("product_id"), F.col("p.name").alias("product_name"),
        F.coalesce(first_size, F.lit("Standard")).alias("size"), "quantity", "unit_price",
    )
    return top_n(picked, ["order_id"], [F.desc("quantity")], 1)


def lookup(value: Column, table: dict[str, str], default: str | None = None) -> Column:
    """Value of a fixed small lookup, as an expression."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, value), F.lit(default))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the first row of each key in a fixed order."""
    return top_n(df, keys, [F.asc(c) for c in order], 1)


def new_rows(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not present yet."""
    return candidates.join(existing.select(*keys), keys, "left_anti")


