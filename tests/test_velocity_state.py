"""Keyed state, held-back rows and exact distinct counts in streams."""

import datetime as dt
import random
from collections import Counter

from commerce_marts.streaming import streams, velocity_state

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"


def at(minute, second=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute, seconds=second)


def put(spark, path, n, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{n}")


def feed(spark, path, schema=SCHEMA):
    return streams.file_stream(spark, f"{path}/*", schema, max_files=1)


def brute(rows, limits, closed):
    """Windows over the minutes of each user, plainly."""
    counts = Counter((u, (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(minutes=1)) for _, ts, u, _ in rows)
    out = set()
    for user, minute in counts:
        for size, limit in limits:
            n = sum(c for (u, m), c in counts.items() if u == user and minute - size < m <= minute)
            end = dt.datetime(1970, 1, 1) + dt.timedelta(minutes=minute + 1)
            if n >= limit and end <= closed:
                out.add((user, size, end, n))
    return out


def test_trailing_counts_equal_sums():
    rng = random.Random(2)
    minutes = sorted(rng.sample(range(3000), 200))
    counts = [rng.randrange(1, 4) for _ in minutes]
    got = set(velocity_state.trailing_counts(minutes, counts, set(minutes[50:]), ((5, 2), (1440, 100))))
    want = {(w, m, n) for w, least in ((5, 2), (1440, 100)) for m in minutes[50:] if (n := sum(c for x, c in zip(minutes, counts, strict=True) if m - w < x <= m)) >= least}
    assert got == want and want


def test_four_windows_late_rows_and_restart(spark, tmp_path):
    rng = random.Random(4)
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "cp"))
    rows = [(i, at(rng.randrange(60 * day, 60 * day + 240), rng.randrange(60)), rng.choice([1, 1, 1, 2, None]), 1.0) for day in (0, 6, 20, 60, 90) for i in range(60)]
    batches = [rows[:60], rows[60:120], rows[120:180], rows[180:]]
    late = [(999, at(3), 1, 1.0)] * 40  # far behind the watermark of the second batch
    for n, batch in enumerate(batches):  # each run goes on from the checkpoint
        put(spark, path, n, batch + (late if n == 3 else []))
        got = streams.run_once(velocity_state.velocity_windows(feed(spark, path), "ts"), out, mark)
    found = [(r["user_id"], r["window_minutes"], r["end"].replace(tzinfo=None), r["n"]) for r in got.collect()]
    closed = max(r[1] for r in rows) - dt.timedelta(hours=1)
    assert len(found) == len(set(found)) and set(found) == brute(rows, velocity_state.LIMITS, closed)
    assert {r[1] for r in found} == {5, 15, 60, 1440}


def test_state_is_cleared_by_timers(spark, tmp_path):
    path, out, mark = (str(tmp_path / x) for x in ("in", "out", "cp"))
    limits = ((5, 1), (60, 2))
    put(spark, path, 0, [(i, at(i), 1, 1.0) for i in range(200)] + [(900 + u, at(10), 100 + u, 1.0) for u in range(20)])
    streams.run_once(velocity_state.velocity_windows(feed(spark, path), "ts", limits), out, mark)
    put(spark, path, 1, [(500 + i, at(500 + i), 1, 1.0) for i in range(100)])
    streams.run_once(velocity_state.velocity_windows(feed(spark, path), "ts", limits), out, mark)
    put(spark, path, 2, [(700, at(900), 1, 1.0)])
    streams.run_once(velocity_state.velocity_windows(feed(spark, path), "ts", limits), out, mark)
    left = spark.read.format("statestore").option("operatorId", "0").option("stateVarName", "recent").load(mark).collect()
    assert {r["key"]["user_id"] for r in left} <= {1} and all(len(r["value"]["minutes"]) <= 60 for r in left)


def test_first_rows_agree_in_stream_and_batch(spark, tmp_path):
    rng = random.Random(7)
    rows = [(i, at(i * 2 + late), i % 5, float(late)) for i in range(120) for late in (0, 7, 25)] + [(7, at(14), 9, -1.0), (500, None, 1, 1.0)]
    rng.shuffle(rows)
    path = str(tmp_path / "in")
    put(spark, path, 0, [r for r in rows if not r[1] or r[1] < at(130)])
    put(spark, path, 1, [r for r in rows if r[1] and r[1] >= at(130)])
    put(spark, path, 2, [(1000, at(2000), 1, 0.0)])
    streamed = streams.run_once(streams.first_rows(feed(spark, path), ["event_id"], "ts", "1 hour"), str(tmp_path / "o"), str(tmp_path / "c"))
    batch = streams.first_rows(spark.createDataFrame(rows, SCHEMA), ["event_id"], "ts", "1 hour")
    assert batch.dtypes == streamed.dtypes and batch.columns == ["event_id", "ts", "user_id", "value"]
    got = sorted(map(tuple, streamed.collect()), key=str)
    assert got == sorted(map(tuple, batch.collect()), key=str)
    assert [(r[0], r[3]) for r in sorted(got)] == [(i, 0.0) for i in range(120)]  # a copy of the same time is decided by its columns
    assert streams.dedup_stream(spark.createDataFrame(rows, SCHEMA), ["event_id"], "ts", "1 hour").count() == 120


def test_exact_customers_of_a_day(spark, tmp_path):
    schema = "created_at timestamp_ntz, user_id bigint, total_amount double, status string"
    rng = random.Random(1)
    rows = [(at(rng.randrange(1440 * 4)), rng.choice([None, *range(300)]), rng.randrange(1, 10_000) / 100, rng.choice(["Delivered", "Cancelled", "x"])) for _ in range(3000)]
    rows.sort(key=lambda r: r[0])
    path = str(tmp_path / "in")
    put(spark, path, 0, rows[:1500], schema)
    put(spark, path, 1, rows[1500:], schema)
    got = streams.run_once(streams.sales_daily(feed(spark, path, schema)), str(tmp_path / "o"), str(tmp_path / "c"))
    found = {r["day"].replace(tzinfo=None): (r["total_orders"], round(r["total_revenue"], 2), r["delivered_orders"], r["cancelled_orders"], r["unique_customers"]) for r in got.collect()}
    want = {}
    for day in (0, 1, 2):
        some = [r for r in rows if at(1440 * day) <= r[0] < at(1440 * day + 1440)]
        of = lambda s: sum(r[3] == s for r in some)  # noqa: B023, E731
        want[at(1440 * day)] = (len(some), round(sum(r[2] for r in some), 2), of("Delivered"), of("Cancelled"), len({r[1] for r in some if r[1] is not None}))
    assert found == want
