"""Orders without a user or a time in the fraud features."""

import datetime as dt

from commerce_marts.operators import anomaly, ordered

ORDERS = "id bigint, order_number string, user_id bigint, status string, total_amount double, created_at timestamp_ntz"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def orders(spark):
    rows = [(1, "a", None, "Delivered", 10.0, at(0)), (2, "b", None, "Cancelled", 20.0, at(30)), (3, "c", 5, "Delivered", 30.0, at(10)), (4, "d", 5, "Delivered", 30.0, at(400)), (5, "e", None, "Delivered", 40.0, at(200))]
    return spark.createDataFrame(rows, ORDERS)


def test_a_null_user_is_a_user(spark):
    items = spark.createDataFrame([(1, 1), (2, 1)], "order_id bigint, product_id bigint")
    got = {r["id"]: (r["user_history"], r["last_hour"], r["item_count"], round(r["cancel_rate"], 3)) for r in anomaly.fraud_features(orders(spark), items).collect()}
    assert got == {1: (0, 1, 1, 0.333), 2: (1, 2, 1, 0.333), 3: (0, 1, 0, 0.0), 4: (1, 1, 0, 0.0), 5: (2, 1, 0, 0.333)}
    scored = anomaly.fraud_score(anomaly.fraud_features(orders(spark), items), anomaly.amount_stats(orders(spark)))
    assert scored.count() == 5


def test_outliers_see_null_users(spark):
    items = spark.createDataFrame([(1, 1)], "order_id bigint, product_id bigint")
    found = anomaly.multivariate_outliers(orders(spark), items, dt.datetime(2024, 1, 2), share=1.0)
    assert found.count() == 5 and found.filter("user_id IS NULL").count() == 3


def test_rows_without_a_time_come_before_none(spark):
    rows = [(1, 1, None), (2, 1, at(0)), (3, 1, at(5)), (4, None, None), (5, None, at(1)), (6, None, at(90))]
    df = spark.createDataFrame(rows, "id bigint, k bigint, ts timestamp_ntz")
    assert {r["id"]: r["n"] for r in ordered.prior_count(df, "k", "ts", "n").collect()} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1}
