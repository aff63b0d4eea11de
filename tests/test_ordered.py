"""Ordered operators against plain Python on small data with ties and hot keys."""

import datetime as dt
import random
from collections import defaultdict

import pandas as pd
import pytest
from pyspark.sql import functions as F

from commerce_marts.operators import anomaly, ordered


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


def test_running_total_with_ties_and_negatives(spark):
    rng = random.Random(1)
    values = [rng.choice([-5.5, 0.0, 0.0, 0.01, 3.0, 3.0, 1e6, rng.random() * 100]) for _ in range(3000)] + [7.0] * 1500
    df = frame(spark, [(v,) for v in values], "v double")
    for descending in (False, True):
        got = {r["v"]: (r["running"], r["total"]) for r in ordered.running_total(df, "v", F.lit(1), descending).collect()}
        assert len(got) == len(set(values))
        for v in set(values):
            want = sum(1 for x in values if (x >= v if descending else x <= v))
            assert got[v] == (want, len(values))


def test_values_at_ranks(spark):
    values = sorted(random.Random(2).choices(range(50), k=977))
    df = frame(spark, [(float(v),) for v in values], "v double")
    ranks = {"q1": ordered.index_quantile(0.25), "q3": ordered.index_quantile(0.75), "d": ordered.disc_quantile(0.2)}
    row = ordered.values_at_ranks(df, "v", ranks).first()
    n = len(values)
    assert (row["q1"], row["q3"]) == (values[int(n * 0.25)], values[int(n * 0.75)])
    assert row["d"] == values[-(-n * 2 // 10) - 1]


def test_running_share_keeps_zero_rows(spark):
    df = frame(spark, [(1, 80.0), (2, 15.0), (3, 5.0), (4, 0.0), (5, 0.0), (6, 15.0)], "id int, v double")
    got = {r["id"]: r["s"] for r in ordered.running_share(df, "v", "s").collect()}
    assert got[4] == got[5] == 1.0 and got[2] == got[6] == pytest.approx(110 / 115) and got[1] == pytest.approx(80 / 115)
    nothing = ordered.running_share(df.filter("v = 0"), "v", "s").collect()
    assert [r["s"] for r in nothing] == [None, None]


def test_prior_and_trailing_counts_with_hot_key(spark):
    rng = random.Random(3)
    start = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), start + dt.timedelta(seconds=rng.randrange(6000))) for i in range(800)]
    df = frame(spark, rows, "id int, k int, ts timestamp_ntz")
    by_key = defaultdict(list)
    for _, k, ts in rows:
        by_key[k].append(ts)
    prior = {r["id"]: r["n"] for r in ordered.prior_count(df, "k", "ts", "n").collect()}
    trail = {r["id"]: r["n"] for r in ordered.trailing_count(df, "k", "ts", 600, "n").collect()}
    assert len(prior) == len(trail) == len(rows)
    for i, k, ts in rows:
        assert prior[i] == sum(1 for x in by_key[k] if x < ts)
        assert trail[i] == sum(1 for x in by_key[k] if ts - dt.timedelta(seconds=600) <= x <= ts)


def test_densify_fills_gaps_per_series(spark):
    d = dt.date
    rows = [("a", d(2024, 1, 1), 10.0), ("a", d(2024, 1, 5), 30.0), ("b", d(2024, 1, 3), None), ("b", d(2024, 1, 4), 8.0), ("c", d(2024, 1, 9), 1.0)]
    out = ordered.densify_daily(frame(spark, rows, "k string, date date, v double"), "date", ["v"], ["k"])
    got = {(r["k"], r["date"].day): r["v"] for r in out.collect()}
    assert got == {("a", 1): 10.0, ("a", 2): 15.0, ("a", 3): 20.0, ("a", 4): 25.0, ("a", 5): 30.0, ("b", 3): 8.0, ("b", 4): 8.0, ("c", 9): 1.0}


@pytest.mark.parametrize("n", [1, 6, 7, 29, 40])
def test_rolling_and_lags_like_pandas(spark, n):
    rng = random.Random(n)
    pdf = pd.DataFrame({"date": pd.date_range("2024-01-01", periods=n), "revenue": [rng.random() * 100 for _ in range(n)]})
    df = spark.createDataFrame([(x.date(), y) for x, y in zip(pdf["date"], pdf["revenue"])], "date date, revenue double")
    got = ordered.full_rolling_features(df, "revenue", "date", [7, 30]).orderBy("date").toPandas()
    if n >= 30:
        want = pdf["revenue"].rolling(7).mean().bfill().ffill()
        assert got["rolling_avg_7"].tolist() == pytest.approx(want.tolist())
    else:
        assert got["rolling_avg_7"].isna().all()
    lags = ordered.lag_features(df, "revenue", "date", [1, 7]).orderBy("date").toPandas()
    want = pdf["revenue"].shift(7).bfill().ffill().fillna(0) if n >= 7 else pd.Series([0.0] * n)
    assert lags["lag_7"].tolist() == pytest.approx(want.tolist())


def test_remove_outliers_keeps_short_series(spark):
    rows = [(dt.date(2024, 1, i + 1), 10.0 + i) for i in range(12)] + [(dt.date(2024, 2, 1), 900.0)]
    df = spark.createDataFrame(rows, "date date, revenue double")
    assert anomaly.remove_outliers(df).count() == 12
    assert anomaly.remove_outliers(df.filter("revenue > 15")).count() == df.filter("revenue > 15").count()


def test_top_n_and_folds(spark):
    df = frame(spark, [(1, i) for i in range(1000)] + [(2, 5)], "k int, v int")
    assert sorted(r["v"] for r in ordered.last_n(df, ["k"], ["v"], 3).filter("k = 1").collect()) == [997, 998, 999]
    days = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=i),) for i in range(13)], "date date")
    folds = ordered.expanding_folds(days, "date", 5).groupBy("fold", "role").count().collect()
    assert {(r["fold"], r["role"]): r["count"] for r in folds}[(4, "train")] == 10
    assert ordered.expanding_folds(days.limit(9), "date", 5).count() == 0
