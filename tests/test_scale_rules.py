"""Results that must not depend on sizes, and merges of repeated keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from commerce_marts import session
from commerce_marts.operators import chunking, delivery, metrics, ordered, vectors
from commerce_marts.sources import sinks

ITEM = "id long, order_id long, product_id long, product_name string, size string, quantity int, unit_price double"


def lines(spark, n):
    rows = spark.range(n).selectExpr(
        "id", "1L AS order_id", "(id * 7919) % 30011 AS product_id", "concat('Item ', id) AS product_name", "'M' AS size", "cast(1 + id % 3 AS int) AS quantity", "2.5D AS unit_price"
    )
    return rows.unionByName(spark.createDataFrame([(10**6, 2, 5, "x", "S", 1, 0.5)], ITEM))


def test_large_order_has_one_row(spark):
    items = lines(spark, 25_000)
    got = {r["order_id"]: r["product_ids"] for r in metrics.order_product_lists(items).collect()}
    assert got[1] == sorted(i * 7919 % 30011 for i in range(25_000)) and got[2] == [5]
    orders = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    nested = {r["id"]: len(r["items"]) for r in metrics.orders_nested(orders, items).collect()}
    assert nested == {1: 25_000, 2: 1, 3: 0}
    heads = ["order_number", "tracking_id", "customer_name", "phone", "address", "city", "state", "pincode", "status", "payment_method", "payment_status"]
    full = orders.select("id", *[F.lit("h").alias(h) for h in heads], F.lit(2.5).alias("total_amount"))
    text = {r["id"]: r["invoice"] for r in delivery.invoice_text(full, items).collect()}
    assert len(text) == 3 and text[1].count("- Item") == 25_000 and text[1].endswith("Total Amount: ₹3")


def test_trailing_count_of_one_busy_key(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1, 23, 30)
    rows = [(i, 1 if i % 5 else None, start + dt.timedelta(milliseconds=500 * rng.randrange(14_000))) for i in range(4000)]
    got = {r["id"]: r["n"] for r in ordered.trailing_count(spark.createDataFrame(rows, "id int, k int, ts timestamp_ntz"), "k", "ts", 600, "n").collect()}
    times = {k: sorted(t for _, x, t in rows if x == k) for k in (1, None)}
    span = dt.timedelta(seconds=600)
    assert got == {i: sum(t - span <= x <= t for x in times[k]) for i, k, t in rows}


def test_repeated_keys_in_one_batch(spark):
    kind = "k int, a string, effective_date date, expiration_date date, is_current boolean"
    old, day, end = dt.date(2020, 1, 1), dt.date(2021, 1, 1), dt.date(9999, 12, 31)
    current = spark.createDataFrame([(1, "x", old, end, True), (1, "w", dt.date(2019, 1, 1), old, False), (2, "y", old, end, True)], kind)
    incoming = spark.createDataFrame([(1, "z"), (1, "zz"), (3, "q"), (3, "q")], "k int, a string")
    merged = sinks.scd2_merge(current, incoming, "k", ["a"], day)
    want = {(1, "x", old, day, False), (1, "w", dt.date(2019, 1, 1), old, False), (1, "zz", day, end, True), (2, "y", old, end, True), (3, "q", day, end, True)}
    rows = [tuple(r) for r in merged.collect()]
    assert len(rows) == 5 and set(rows) == want
    again = [tuple(r) for r in sinks.scd2_merge(spark.createDataFrame(rows, kind), incoming, "k", ["a"], day).collect()]
    assert sorted(again, key=str) == sorted(rows, key=str)
    changes = spark.createDataFrame([(1, 5, "a"), (1, 5, "b"), (1, 4, "c")], "k int, at int, v string").repartition(3)
    assert [tuple(r) for r in sinks.newest_per_key(changes, ["k"], "at").collect()] == [(1, 5, "b")]


def test_word_chunks_equal_a_scan(spark):
    rng = random.Random(5)
    texts = ["", "a", " ".join("w" * rng.randrange(1, 9) for _ in range(900)), "x" * 700 + " y " + "z" * 600, " ".join(["word"] * 100)]
    for overlap in (0, 3, 50):
        got = {}
        for r in chunking.chunk_words(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), size=100, overlap=overlap).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["chunk_text"]))
        for i, t in enumerate(texts):
            words, want, held = t.split(), [], []
            for w in words:
                held.append(w)
                if sum(len(x) + 1 for x in held) >= 100:
                    want.append(" ".join(held))
                    held = held[-overlap:] if overlap else []
            if held:
                want.append(" ".join(held))
            assert [c for _, c in sorted(got.get(i, []))] == want


@pytest.mark.parametrize("blocks", [(1, 1), (3, 5)])
def test_vector_topk_does_not_depend_on_blocks(spark, blocks):
    rng = random.Random(8)
    base = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(80)] + [(100, [0.0] * 6)]
    asked = [(i, v) for i, v in base[:9]]
    got = vectors.vector_topk(
        spark.createDataFrame(asked, "query_id long, query array<double>"), spark.createDataFrame(base, "vec_id long, embedding array<double>"), 4, query_blocks=blocks[0], vector_blocks=blocks[1]
    ).collect()
    assert len(got) == 36
    for q, v in asked:
        norm = lambda x: sum(e * e for e in x) ** 0.5 or 1.0
        sims = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / norm(v) / norm(w), 6), i) for i, w in base)
        assert [r["vector_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == [i for _, i in sims[:4]]


def test_shared_folder_needs_a_setting_off_local_masters(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = spark.conf, Context()

    if not spark.conf.get("spark.checkpoint.dir", None):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Session(), "x")
    assert session.shared_dir(spark, "x") != session.shared_dir(spark, "x")
