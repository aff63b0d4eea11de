"""Snapshots, history, uploads and the quality gate."""

import datetime as dt

import pytest
from pyspark.sql import types as T

from commerce_marts.operators import customers, joins, metrics, quality
from commerce_marts.plans import medallion
from commerce_marts.sources import readers, schemas, sinks
from commerce_marts.sources.canonical import Retail


def day(n, hour=0):
    return dt.datetime(2024, 1, n, hour)


def test_snapshot_table(spark, tmp_path):
    table = sinks.SnapshotTable(spark, str(tmp_path / "t"))
    rows = lambda r: spark.createDataFrame(r, "k int, v string, seq int")
    assert table.latest() is None
    table.commit(rows([(1, "a", 0), (2, "b", 0)]), day(1))
    changes = rows([(2, "c", 1), (2, "d", 2), (3, "e", 1)])
    table.upsert(changes, ["k"], "seq", day(9))
    want = [(1, "a"), (2, "d"), (3, "e")]
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == want
    table.upsert(changes, ["k"], "seq", day(10))
    assert sorted((r["k"], r["v"]) for r in table.read().collect()) == want
    assert table.read(as_of=day(5)).count() == 2 and table.read(version=1).count() == 3
    with pytest.raises(ValueError):
        table.read(as_of=dt.datetime(2023, 1, 1))
    assert table.expire(168, day(12)) == [0]
    assert not (tmp_path / "t" / "version=0").exists() and (tmp_path / "t" / "version=2").exists()
    assert table.expire(168, dt.datetime(2025, 1, 1)) == [1]
    assert table.latest() == 2


def test_scd2(spark):
    cols = "id int, city string, tier string, effective_date date, expiration_date date, is_current boolean"
    far = dt.date(9999, 12, 31)
    start = spark.createDataFrame([(1, "x", None, day(1).date(), far, True), (2, "y", "A", day(1).date(), far, True), (4, "w", "A", day(1).date(), far, True)], cols)
    new = spark.createDataFrame([(1, "x", None), (2, "z", "A"), (3, "n", "B")], "id int, city string, tier string")
    once = sinks.scd2_merge(start, new, "id", ["city", "tier"], day(5).date())
    got = sorted((r["id"], r["city"], r["effective_date"].day, r["expiration_date"].year, r["is_current"]) for r in once.collect())
    assert got == [(1, "x", 1, 9999, True), (2, "y", 1, 2024, False), (2, "z", 5, 9999, True), (3, "n", 5, 9999, True), (4, "w", 1, 9999, True)]
    again = sinks.scd2_merge(once, new, "id", ["city", "tier"], day(5).date())
    assert sorted(map(str, again.collect())) == sorted(map(str, once.collect()))


def test_schema_enforcement(spark):
    df = spark.createDataFrame([(1, "a")], "id bigint, name string")
    with pytest.raises(ValueError):
        schemas.conform(df, schemas.schema_of("raw", "users"))
    with pytest.raises(TypeError):
        schemas.evolve(df, T.StructType.fromDDL("id string"))
    for layer, tables in schemas.LAYERS.items():
        for table in tables:
            assert len(schemas.schema_of(layer, table)) > 3


def test_uploaded_file(spark, tmp_path):
    lines = ["Date ,Sales,Quantity", "2024-01-05,\"$1,200.50\",3", "05/01/2024,10,x", "31-12-2023,5,", "2024-02-30,5,1", ",5,1", "2024-01-06,-4,1", "2024-01-06,,1", "2024-01-06,abc,1", "20240106,7,2"]
    (tmp_path / "u.csv").write_text("\n".join(lines))
    raw = readers.with_row_numbers(spark.read.option("header", True).csv(str(tmp_path / "u.csv")))
    good, bad = readers.normalize_sales_upload(raw)
    assert sorted((str(r["date"]), r["revenue"], r["orders"]) for r in good.collect()) == [("2023-12-31", 5.0, 1), ("2024-01-05", 1210.5, 4), ("2024-01-06", 7.0, 2)]
    assert [r["reason"] for r in bad.orderBy("row").collect()] == [
        "Row 5: Invalid date format '2024-02-30'", "Row 6: Missing date value", "Row 7: Revenue cannot be negative",
        "Row 8: Missing revenue value", "Row 9: Invalid revenue value 'abc'",
    ]
    with pytest.raises(ValueError):
        readers.normalize_sales_upload(raw.drop("Sales"))


def test_row_numbers_over_partitions(spark, tmp_path):
    spark.range(0, 1000, 1, 4).selectExpr("cast(id as string) AS v").write.text(str(tmp_path / "t"))
    df = readers.with_row_numbers(spark.read.text(str(tmp_path / "t")))
    assert sorted(r["row"] for r in df.collect()) == list(range(2, 1002))


def test_payload_rows(spark):
    got = readers.rows_to_df(spark, [{"date": "2024-01-01", "revenue": 5, "orders": 2}, {"date": "no", "revenue": 1}, {"date": "2024-01-02", "revenue": "x"}])
    assert [(str(r["date"]), r["revenue"], r["orders"]) for r in got.collect()] == [("2024-01-01", 5.0, 2)]


def test_quality_gate(spark):
    df = spark.createDataFrame([(1, "a", -1.0), (1, None, 5.0)], "id int, name string, v double")
    checks = [quality.Check("t", "uniqueness", "id"), quality.Check("t", "completeness", "name", 0.9), quality.Check("t", "range", "v", 0, 10)]
    log = quality.run_suite({"t": df}, checks)
    assert quality.quality_score(log).first()["status"] == "FAIL" and quality.quality_alerts(log).count() == 3
    with pytest.raises(quality.QualityGateError):
        quality.gate(log)
    assert quality.gate(log, stop=False)["failed_checks"] == 3
    empty = quality.run_suite({"t": df.limit(0)}, checks)
    assert {r["check_name"]: r["passed"] for r in empty.collect()} == {"id_uniqueness": True, "name_completeness": False, "v_range": True}


def test_customer_without_orders_and_category_tie(spark):
    users = spark.createDataFrame([(1,), (2,)], "id bigint")
    orders = spark.createDataFrame([(10, 1, "Delivered", 50.0, day(3))], "id bigint, user_id bigint, status string, total_amount double, created_at timestamp_ntz")
    items = spark.createDataFrame([(10, 1, 2), (10, 2, 2)], "order_id bigint, product_id bigint, quantity int")
    products = spark.createDataFrame([(1, "zeta"), (2, "alpha")], "id bigint, category string")
    features = {r["user_id"]: r for r in customers.customer_features(users, orders, items, products, day(10)).collect()}
    assert features[2]["recency_days"] == 999 and features[2]["total_orders"] == 0 and features[1]["category_diversity"] == 2
    typed = joins.enrich_items(items, products, orders)
    assert customers.favourite_category(joins.items_with_user(typed, orders)).first()["category"] == "alpha"
    segment = customers.customer_features(users, orders, items, products, day(10)).select("user_id", customers.customer_segment().alias("s"))
    assert {r["user_id"]: r["s"] for r in segment.collect()} == {1: "regular_customer", 2: "new_customer"}


def test_large_order_is_one_row(spark):
    items = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 7)], "order_id bigint, product_id bigint")
    lists = {r["order_id"]: r["product_ids"] for r in metrics.order_product_lists(items).collect()}
    assert lists == {1: list(range(500)), 2: [7]}


def test_repair_takes_the_largest_quantity(spark):
    orders = spark.createDataFrame([(1, "A", 30.0), (2, "B", 7.77)], "id bigint, order_number string, total_amount double")
    items = spark.createDataFrame([], "order_id bigint")
    products = spark.createDataFrame([(5, "p", "S,M", 10.0), (6, "q", "", 15.0), (7, "r", "L", 30.0)], "id bigint, name string, sizes string, price double")
    got = joins.repair_missing_items(orders, items, products).collect()
    assert [(r["order_id"], r["product_id"], r["quantity"], r["size"]) for r in got] == [(1, 5, 3, "S")]


def test_lake_run_twice_gives_the_same_tables(spark, tmp_path):
    retail = Retail(spark, "/root/testdata/sf0.001")
    root = str(tmp_path / "lake")
    one = medallion.run_medallion(retail, root, dt.datetime(2001, 8, 2), stop_on_fail=False)
    first = spark.read.parquet(f"{root}/curated/sales_daily").orderBy("created_at").collect()
    two = medallion.run_medallion(retail, root, dt.datetime(2001, 8, 2), stop_on_fail=False)
    assert one == two and first == spark.read.parquet(f"{root}/curated/sales_daily").orderBy("created_at").collect()


def test_product_rollup_counts_orders_without_a_table_of_pairs(spark):
    lines = [(1, 1, 2, 1.5), (1, 1, 1, 2.5), (1, 2, 1, 1.0), (1, None, 1, 1.0), (1, None, 1, 1.0), (None, 3, 1, 4.0), (None, 3, 1, 4.0), (2, None, 1, 1.0)]
    items = spark.createDataFrame([(p, o, q, u, q * u, q * u / 4, day(o or 9)) for p, o, q, u in lines], "product_id long, order_id long, quantity int, unit_price double, line_revenue double, line_profit double, created_at timestamp_ntz")
    df = metrics.product_rollup(items.repartition(3))
    assert {r["product_id"]: tuple(r)[1:] for r in df.collect()} == {
        1: (6, 8.5, 2.125, 1.4, 2, day(1), day(9)), None: (2, 8.0, 2.0, 4.0, 1, day(3), day(3)), 2: (1, 1.0, 0.25, 1.0, 0, day(9), day(9)),
    }
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.splitlines() if "Aggregate" in x and "order_id#" in x.split("functions=")[0]]


def test_lake_tables_are_packed(spark, tmp_path):
    assert sinks.write_table(spark.range(5), str(tmp_path / "t")) == 5
    assert [f.name.endswith(".zstd.parquet") for f in (tmp_path / "t").glob("part-*")] == [True] * len([*(tmp_path / "t").glob("part-*")])
