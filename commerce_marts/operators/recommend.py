"""Recommendations. Lists per category are cut to what a reader can need before they are joined; products
bought together are counted block by block of an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import joins
from .onerow import beside
from .ordered import top_n


#: Parts of the pairing for each part of the lines.
PAIR_PARTS = 16


def by_popularity() -> list[Column]:
    return [F.desc("stock"), F.desc("created_at"), F.asc("id")]


def copurchase_counts(items: DataFrame, block: int = 200) -> DataFrame:
    """All pairs of products with the number of orders that hold both.

    The products of an order are dealt to blocks of about ``block`` and blocks are paired, so the
    pairs of one order are made and summed by many tasks, none of which holds more than two blocks
    of it. Repeated lines count as often as they occur on the partner side. Two products are summed once
    for both directions, which are told apart after the sum.
    """
    lines = items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("lines"))
    sizes = lines.groupBy("order_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_blocks"))
    dealt = lines.join(sizes, "order_id").withColumn("_own", F.pmod(F.xxhash64("product_id"), "_blocks").cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    left = dealt.select("order_id", F.col("_own").alias("_p"), each.alias("_q"), "product_id", F.col("lines").alias("_back"))
    right = dealt.select("order_id", each.alias("_p"), F.col("_own").alias("_q"), F.col("product_id").alias("other_id"), "lines")
    meet = ["order_id", "_p", "_q"]
    # A task's table of pairs grows with its lines, so parts follow the input and are not merged again.
    parts = PAIR_PARTS * items.rdd.getNumPartitions()
    pairs = left.repartition(parts, *meet).join(right.repartition(parts, *meet), meet).filter("product_id < other_id")
    sums = pairs.groupBy("product_id", "other_id").agg(F.sum("lines").alias("_there"), F.sum("_back").alias("_back"))
    there = F.struct("product_id", "other_id", F.col("_there").alias("frequency"))
    back = F.struct(F.col("other_id").alias("product_id"), F.col("product_id").alias("other_id"), F.col("_back").alias("frequency"))
    return sums.select(F.inline(F.array(there, back)))


def copurchase(items: DataFrame, products: DataFrame, k: int = 4, block: int = 200) -> DataFrame:
    """The ``k`` products most often in the same orders; category neighbours where there are none."""
    best = top_n(copurchase_counts(items, block), ["product_id"], [F.desc("frequency"), F.asc("other_id")], k, rank="rank")
    alone = products.join(best.select(F.col("product_id").alias("id")), "id", "left_anti")
    stocked = products.filter("stock > 0")
    fallback = category_neighbours(alone, k, [F.desc("stock"), F.asc("id")], pool=stocked).withColumn("frequency", F.lit(0).cast("bigint"))
    return best.withColumn("source", F.lit("orders")).unionByName(fallback.withColumn("source", F.lit("category")))


def category_neighbours(products: DataFrame, k: int, order: list[Column] | None = None, pool: DataFrame | None = None) -> DataFrame:
    """The first ``k`` other products of the same category for every product.

    Only the first ``k + 1`` products of a category can be anyone's neighbours.
    """
    pool = products if pool is None else pool
    heads = top_n(pool, ["category"], order or [F.asc("id")], k + 1, rank="_pos").select("category", F.col("id").alias("other_id"), "_pos")
    pairs = products.select(F.col("id").alias("product_id"), "category").join(heads, "category").filter("product_id <> other_id")
    w = Window.partitionBy("product_id").orderBy("_pos")
    return pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("product_id", "other_id", "rank")


def recommend_unseen(users: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, k: int = 8) -> DataFrame:
    """In-stock products the user has not bought, from categories the user bought in, by popularity.

    A user who bought ``m`` products of a category needs only its first ``k + m`` products, so each
    user asks for those list positions and not for the whole category. Users without any candidate,
    or without orders, get the general popularity list.
    """
    bought = joins.items_with_user(items.select("order_id", "product_id"), orders).select("user_id", "product_id").distinct()
    typed = bought.join(products.select(F.col("id").alias("product_id"), "category", "stock"), "product_id")
    wants = typed.groupBy("user_id", "category").agg(F.count(F.when(F.col("stock") > 0, 1)).alias("_m"))
    wants = wants.withColumn("_pos", F.explode(F.sequence(F.lit(1), (F.col("_m") + k).cast("int"))))
    listed = _positions(products.filter("stock > 0"))
    offers = wants.join(listed, ["category", "_pos"]).select("user_id", F.col("id").alias("product_id"), "stock", "created_at")
    fresh = offers.join(bought, ["user_id", "product_id"], "left_anti").withColumnRenamed("product_id", "id")
    own = top_n(fresh, ["user_id"], by_popularity(), k, rank="rank").select("user_id", F.col("id").alias("product_id"), "rank")
    rest = users.select(F.col("id").alias("user_id")).join(own.select("user_id"), "user_id", "left_anti")
    general = popular(products, k)
    everyone = _each(rest, general)
    return own.withColumn("source", F.lit("category")).unionByName(everyone.select("user_id", "product_id", "rank").withColumn("source", F.lit("popular")))


def _positions(stocked: DataFrame) -> DataFrame:
    """Position of each product in its category's popularity list, counted per stock level first.

    Stock levels split a large category, so no task orders all its products.
    """
    levels = stocked.groupBy("category", "stock").agg(F.count(F.lit(1)).alias("_c"))
    above = Window.partitionBy("category").orderBy(F.desc("stock")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.select("category", "stock", F.coalesce(F.sum("_c").over(above), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("category", "stock").orderBy(F.desc("created_at"), F.asc("id"))
    placed = stocked.withColumn("_in", F.row_number().over(inside)).join(levels, ["category", "stock"])
    return placed.select("category", (F.col("_before") + F.col("_in")).cast("int").alias("_pos"), "id", "stock", "created_at")


def _each(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Every row with every entry of a short list, which goes to the tasks as one array."""
    one = listed.agg(F.collect_list(F.struct(*listed.columns)).alias("_list"))
    return beside(rows, one).select(*rows.columns, F.inline("_list"))


def popular(products: DataFrame, k: int) -> DataFrame:
    """The ``k`` best stocked, newest products with their rank."""
    return top_n(products, [], by_popularity(), k, rank="rank").select("rank", F.col("id").alias("product_id"))


def segment_recommendations(segments: DataFrame, affinity: DataFrame, orders: DataFrame, items: DataFrame, products: DataFrame, k: int = 8) -> DataFrame:
    """Product list per customer chosen by segment.

    New customers see what is popular, high spenders premium goods, active shoppers new goods of
    their first category or, without one, any new goods, explorers the best stocked product of each category, and all others
    neighbours of the products in their last order, filled up with well-stocked goods.
    Lists are ranked once per strategy and joined by segment.
    """
    newest = [F.desc("created_at"), F.asc("id")]
    shape = ["segment", "rank", "product_id", "reason"]

    def listed(df, order, segs, reason):
        top = top_n(df, [], order, k, rank="rank").withColumn("reason", reason)
        return top.select(F.explode(F.array(*[F.lit(x) for x in segs])).alias("segment"), "rank", F.col("id").alias("product_id"), "reason")

    shelves = top_n(products, ["category"], [F.desc("stock"), F.asc("id")], 1)
    shared = (
        listed(products, by_popularity(), ["new_customer"], F.lit("Trending Now"))
        .unionByName(listed(products.filter("price > 2000"), newest, ["vip_customer", "high_value"], F.lit("Premium Selection")))
        .unionByName(listed(shelves, [F.asc("category")], ["explorer"], F.concat(F.lit("Try "), F.col("category"))))
        .select(*shape)
    )
    by_segment = segments.join(shared, "segment").select("user_id", "segment", "rank", "product_id", "reason")

    first = affinity.filter("rank = 1").select("user_id", "category")
    fresh = top_n(products, ["category"], newest, k, rank="rank").select("category", "rank", F.col("id").alias("product_id"))
    active = segments.filter("segment = 'active_shopper'")
    by_category = active.join(first, "user_id").join(fresh, "category").select(
        "user_id", "segment", "rank", "product_id", F.concat(F.lit("New in "), "category").alias("reason")
    )

    anything = top_n(products, [], newest, k, rank="rank").select("rank", F.col("id").alias("product_id"), F.lit("New Arrivals").alias("reason"))
    untold = _each(active.join(first.select("user_id"), "user_id", "left_anti").select("user_id", "segment"), anything)

    others = segments.filter(~F.col("segment").isin("new_customer", "vip_customer", "high_value", "active_shopper", "explorer"))
    last = top_n(orders.select("user_id", "id", "created_at"), ["user_id"], [F.desc("created_at"), F.desc("id")], 1)
    basket = last.select("user_id", F.col("id").alias("order_id")).join(items.select("order_id", "product_id"), "order_id").distinct()
    near = category_neighbours(products, 2)
    similar = (
        others.select("user_id", "segment").join(basket, "user_id").join(near, "product_id")
        .groupBy("user_id", "segment", "other_id").agg(F.min(F.struct("product_id", "rank")).alias("_at"))
        .select("user_id", "segment", F.col("other_id").alias("product_id"), F.lit(0).alias("_tier"), "_at.product_id", "_at.rank")
    ).toDF("user_id", "segment", "product_id", "_tier", "_a", "_b")
    stocked = top_n(products, [], [F.desc("stock"), F.asc("id")], k, rank="_b").select(F.col("id").alias("product_id"), "_b")
    filler = _each(others.select("user_id", "segment"), stocked)
    filler = filler.select("user_id", "segment", "product_id", F.lit(1).alias("_tier"), F.lit(0).cast("bigint").alias("_a"), "_b")
    mixed = top_n(similar.unionByName(filler), ["user_id"], [F.asc("_tier"), F.asc("_a"), F.asc("_b"), F.asc("product_id")], k, rank="rank")
    reason = F.when(F.col("_tier") == 0, "Similar to your purchase").otherwise("Trending")
    rest = mixed.select("user_id", "segment", "rank", "product_id", reason.alias("reason"))
    return by_segment.unionByName(by_category).unionByName(untold).unionByName(rest)
