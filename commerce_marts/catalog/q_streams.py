"""Streams over the given tables, run to the end of the input and read back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import filters
from ..session import shared_dir
from ..sources import sinks
from ..sources.canonical import RAW_SCHEMAS, Retail
from ..streaming import streams, velocity_state
from .registry import query


class Live(Retail):
    """The retail tables as file streams."""

    def raw(self, table):
        return streams.file_stream(self.spark, self.root, RAW_SCHEMAS[table], glob=f"{table}.parquet")


def live(t):
    return Live(t.spark, t.root)


def result(t, df, name):
    root = shared_dir(t.spark, name)
    return streams.run_once(df, f"{root}/out", f"{root}/checkpoint")


def plain(df, *cols):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


@query("R01_stream_ingest", "SELECT event_type, count(*) AS events, msum(value) AS value FROM events GROUP BY 1")
def _(t):
    landed = result(t, live(t).raw("events"), "ingest")
    from ..functions.money import money_sum

    return landed.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), money_sum("value").alias("value"))


@query("R02_refresh_totals", "SELECT user_id, count(*) AS rows, msum(value) AS amount FROM events GROUP BY 1")
def _(t):
    root = shared_dir(t.spark, "refresh")
    t.raw("events").repartition(3, "event_id").write.parquet(f"{root}/in")
    source = streams.file_stream(t.spark, f"{root}/in", RAW_SCHEMAS["events"], max_files=1)
    streams.refresh_totals(source, f"{root}/totals", "user_id", "value", f"{root}/checkpoint").start().awaitTermination()
    return streams.read_totals(t.spark, f"{root}/totals", "user_id").withColumn("amount", F.col("amount").cast("double"))


def windows_sql(where, limit):
    return f"""SELECT start, start + INTERVAL 24 HOUR AS "end", user_id, count(*) AS n FROM (SELECT user_id, date_trunc('hour', ts) - to_hours(k) AS start FROM events, range(24) r(k) WHERE {where})
        WHERE start + INTERVAL 24 HOUR <= (SELECT max(ts) FROM events WHERE {where}) - INTERVAL 1 HOUR GROUP BY start, user_id HAVING count(*) >= {limit}"""


@query("R03_stream_velocity", windows_sql("true", 7))
def _(t):
    bursts = streams.velocity(live(t).raw("events"), "ts", "24 hours", "1 hour", 7)
    return plain(result(t, bursts, "velocity"), "start", "end")


@query("R04_failed_logins", windows_sql("event_type = 'error'", 3))
def _(t):
    return plain(result(t, streams.failed_logins(live(t).activities, 3), "logins"), "start", "end")


def trailing_sql(where, limits):
    """Windows that end with a minute in which a user has rows, once the watermark has passed it."""
    arms = " UNION ALL ".join(
        f"""SELECT user_id, {size} AS window_minutes, minute + INTERVAL 1 MINUTE AS "end", sum(c) OVER (PARTITION BY user_id ORDER BY minute
        RANGE BETWEEN INTERVAL {size - 1} MINUTE PRECEDING AND CURRENT ROW)::bigint AS n, {limit} AS least FROM m""" for size, limit in limits
    )
    return f"""WITH m AS (SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS c FROM events WHERE {where} GROUP BY 1, 2), w AS ({arms})
        SELECT user_id, window_minutes, "end", n FROM w WHERE n >= least AND "end" <= (SELECT max(ts) FROM events WHERE {where}) - INTERVAL 1 HOUR"""


#: The given events are sparse; the limits are lowered so that each window has rows.
SPARSE_LIMITS = ((5, 2), (15, 2), (60, 3), (1440, 7))
LOGIN_LIMITS = ((5, 2), (15, 2), (60, 2), (1440, 3))


@query("R03_velocity_windows", trailing_sql("true", SPARSE_LIMITS))
def _(t):
    return plain(result(t, velocity_state.velocity_windows(live(t).raw("events"), "ts", SPARSE_LIMITS), "windows"), "end")


@query("R04_login_windows", trailing_sql("event_type = 'error'", LOGIN_LIMITS))
def _(t):
    failed = live(t).activities.filter("activity_type = 'login_failed'")
    return plain(result(t, velocity_state.velocity_windows(failed, "created_at", LOGIN_LIMITS), "login-windows"), "end")


@query("R05_event_landing", "SELECT activity_type, count(*) AS activities FROM r_activities GROUP BY 1")
def _(t):
    root = shared_dir(t.spark, "activities")
    landed = streams.run_once(live(t).activities, f"{root}/out", f"{root}/checkpoint", ["activity_type"])
    return landed.groupBy("activity_type").agg(F.count(F.lit(1)).alias("activities"))


@query("R06_dedup_stream", "SELECT event_id, user_id, event_type FROM events")
def _(t):
    twice = live(t).raw("events").withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return result(t, streams.dedup_stream(twice, ["event_id"], "ts", "1 hour"), "dedup").select("event_id", "user_id", "event_type")


@query("R06_first_rows", "SELECT event_id, user_id, event_type, value, ts FROM events WHERE ts <= (SELECT max(ts) FROM events) - INTERVAL 130 MINUTE")
def _(t):
    # Each event has a changed copy ten minutes later, which is read before it.
    copies = F.explode(F.array(F.struct(F.lit(10).alias("late"), F.lit("copy").alias("kind")), F.struct(F.lit(0).alias("late"), F.lit(None).cast("string").alias("kind"))))
    events = live(t).raw("events").withColumn("c", copies).withColumns({"ts": F.col("ts") + F.make_dt_interval(mins=F.col("c.late")), "event_type": F.coalesce("c.kind", "event_type")}).drop("c")
    found = result(t, streams.first_rows(events, ["event_id"], "ts", "1 hour"), "first")
    limit = t.raw("events").agg(F.max("ts")).first()[0] - dt.timedelta(minutes=130)
    return found.filter(F.col("ts") <= F.lit(limit)).select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"))


SESSIONS = """SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS events FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
    (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""


@query("R07_sessions_batch", SESSIONS)
def _(t):
    return plain(streams.sessionize(t.raw("events"), "ts"), "start", "end")


@query("R07_sessions_stream", f"SELECT * FROM ({SESSIONS}) WHERE \"end\" <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR")
def _(t):
    return plain(result(t, streams.sessionize(live(t).raw("events"), "ts"), "sessions"), "start", "end")


@query("R08_stream_sales_daily", """SELECT * FROM (SELECT created_at::date::timestamp AS day, count(*) AS total_orders, msum(total_amount) AS total_revenue, count(*) FILTER (status = 'Delivered') AS delivered_orders,
    count(*) FILTER (status = 'Cancelled') AS cancelled_orders, count(DISTINCT user_id) AS unique_customers FROM r_orders GROUP BY 1) WHERE day + INTERVAL 1 DAY <= (SELECT max(created_at) FROM r_orders) - INTERVAL 1 HOUR""")
def _(t):
    return plain(result(t, streams.sales_daily(live(t).orders), "sales"), "day")


@query("R09_stream_alerts", "SELECT 'Low_Stock_Alert' AS rule, 'high' AS severity, id::varchar AS key FROM r_products WHERE stock < 10")
def _(t):
    root = shared_dir(t.spark, "alerts")
    rules = filters.rules_for("inventory_analytics")
    streams.stream_alerts(live(t).products, rules, F.col("id"), f"{root}/out", f"{root}/checkpoint").start().awaitTermination()
    return t.spark.read.parquet(f"{root}/out").select("rule", "severity", "key")
