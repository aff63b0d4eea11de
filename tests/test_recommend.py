"""Recommendations against brute force, with orders that hold a large share of all lines."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from commerce_marts.operators import recommend


def brute(lines, k):
    held, count = defaultdict(set), defaultdict(Counter)
    for order, product in lines:
        held[order].add(product)
        count[order][product] += 1
    freq = defaultdict(Counter)
    for order, products in held.items():
        for p in products:
            for q in products:
                if p != q:
                    freq[p][q] += count[order][q]
    return {p: sorted(c.items(), key=lambda x: (-x[1], x[0]))[:k] for p, c in freq.items()}


def test_copurchase_with_large_orders(spark):
    rng = random.Random(4)
    lines = [(o, rng.randrange(60)) for o in range(150) for _ in range(rng.randrange(1, 6))]
    lines += [(1000, p) for p in range(60)] + [(1001, p) for p in range(0, 60, 2)] + [(1002, rng.randrange(60)) for _ in range(200)]
    items = spark.createDataFrame(lines, "order_id bigint, product_id bigint").repartition(4)
    products = spark.createDataFrame([(p, "x", p % 7, None) for p in range(65)], "id bigint, category string, stock int, created_at date")
    want = brute(lines, 4)
    for large in (1, 8, 1000):
        got = defaultdict(list)
        rows = recommend.copurchase(items, products, 4, large).filter("source = 'orders'").collect()
        for r in sorted(rows, key=lambda r: (r["product_id"], r["rank"])):
            got[r["product_id"]].append((r["other_id"], r["frequency"]))
        assert dict(got) == want
    alone = recommend.copurchase(items, products, 4).filter("source = 'category' AND product_id = 62").orderBy("rank").collect()
    assert [r["other_id"] for r in alone] == [6, 13, 20, 27]


def test_copurchase_of_a_dozen_large_orders(spark):
    """Orders over 500 of 600 products, each product in its own set of orders."""
    rng = random.Random(6)
    lines = [(o, p) for o in range(12) for p in rng.sample(range(600), 500)]
    items = spark.createDataFrame(lines, "order_id bigint, product_id bigint").repartition(4)
    want = brute(lines, 4)
    counts = recommend.copurchase_counts(items)
    got = defaultdict(list)
    for r in recommend.top_n(counts, ["product_id"], [F.desc("frequency"), F.asc("other_id")], 4).collect():
        got[r["product_id"]].append((r["other_id"], r["frequency"]))
    assert {p: sorted(v, key=lambda x: (-x[1], x[0])) for p, v in got.items()} == want


def test_category_neighbours_excludes_self(spark):
    products = spark.createDataFrame([(i, "a" if i < 5 else "b") for i in range(6)], "id bigint, category string")
    got = defaultdict(list)
    for r in recommend.category_neighbours(products, 2).orderBy("product_id", "rank").collect():
        got[r["product_id"]].append(r["other_id"])
    assert got == {0: [1, 2], 1: [0, 2], 2: [0, 1], 3: [0, 1], 4: [0, 1]}


def test_copurchase_sums_a_pair_once(spark):
    """Pairs are made in one direction, in parts that follow the input and are not merged again."""
    items = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (2, 1), (2, None), (None, 3), (3, 4)], "order_id bigint, product_id bigint").repartition(2)
    counts = recommend.copurchase_counts(items)
    assert sorted(map(tuple, counts.collect())) == [(1, 2, 2), (2, 1, 1)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert "(product_id#" in plan and " < other_id#" in plan and f", {2 * recommend.PAIR_PARTS}" in plan
