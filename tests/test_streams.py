"""Streams in several batches: lateness, replays, session gaps."""

import datetime as dt

from commerce_marts.streaming import streams

SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, value double"


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def put(spark, path, n, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/b{n}")


def feed(spark, path):
    return streams.file_stream(spark, f"{path}/*", SCHEMA, max_files=1)


def test_late_rows_are_dropped_and_duplicates_removed(spark, tmp_path):
    path = str(tmp_path / "in")
    out, mark = str(tmp_path / "out"), str(tmp_path / "cp")
    batches = [[(1, at(0), 1, 1.0), (1, at(1), 1, 1.0), (2, at(300), 1, 1.0)], [(3, at(10), 1, 1.0), (4, at(301), 1, 1.0), (4, at(301), 1, 1.0)], [(4, at(302), 1, 1.0), (5, at(303), 1, 1.0)]]
    for n, rows in enumerate(batches):
        put(spark, path, n, rows)
        deduped = streams.dedup_stream(feed(spark, path), ["event_id"], "ts", "1 hour")
        got = streams.run_once(deduped, out, mark)
    assert sorted(r["event_id"] for r in got.collect()) == [1, 2, 4, 5]


def test_session_gap_of_exactly_thirty_minutes_keeps_the_session(spark):
    rows = [(1, at(0), 1, 1.0), (2, at(29), 1, 1.0), (3, at(59), 1, 1.0), (4, at(90), 1, 1.0), (5, at(60), 2, 1.0)]
    got = streams.sessionize(spark.createDataFrame(rows, SCHEMA), "ts").collect()
    assert sorted((r["user_id"], r["events"]) for r in got) == [(1, 1), (1, 3), (2, 1)]


def test_velocity_batch_equals_stream_on_closed_windows(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = [(i, at(i * 3), i % 2, 10.0) for i in range(200)]
    put(spark, path, 0, rows)
    streamed = streams.run_once(streams.velocity(feed(spark, path), "ts", "1 hour", "30 minutes", 5, amount="value"), str(tmp_path / "o"), str(tmp_path / "c"))
    limit = at(199 * 3) - dt.timedelta(hours=1)
    batch = streams.velocity(spark.createDataFrame(rows, SCHEMA), "ts", "1 hour", "30 minutes", 5, amount="value").filter(f"end <= timestamp'{limit}'")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect())) and batch.count() > 10


def test_refresh_is_replay_safe(spark, tmp_path):
    path = str(tmp_path / "in")
    table = str(tmp_path / "t")
    put(spark, path, 0, [(1, at(0), 1, 2.5), (2, at(1), 2, 1.0)])
    put(spark, path, 1, [(3, at(2), 1, 0.5)])
    for mark in ("cp", "cp", "other"):
        streams.refresh_totals(feed(spark, path), table, "user_id", "value", str(tmp_path / mark)).start().awaitTermination()
    assert sorted((r["user_id"], r["rows"], float(r["amount"])) for r in streams.read_totals(spark, table, "user_id").collect()) == [(1, 2, 3.0), (2, 1, 1.0)]
