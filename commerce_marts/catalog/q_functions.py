"""Scalar expressions at work on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timeutil
from ..functions.money import growth_pct, pct, ratio
from .registry import query


@query("E01_date_parts", """SELECT id, year(created_at) AS year, month(created_at) AS month, day(created_at) AS day, quarter(created_at) AS quarter, weekofyear(created_at) AS week,
    dayofweek(created_at) + 1 AS weekday, dayofweek(created_at) IN (0, 6) AS is_weekend, isoyear(created_at) AS iso_year FROM r_orders""")
def _(t):
    return t.orders.select("id", *[c.alias(n) for n, c in timeutil.date_parts("created_at").items()], timeutil.iso_year("created_at").alias("iso_year"))


@query("E02_date_offsets", """SELECT id, datediff('day', created_at::date, AS_OF::date) AS age_days, created_at::date + 5 AS due, created_at - INTERVAL 36 HOUR AS before, floor(epoch(AS_OF - created_at) / 86400)::bigint AS whole_days FROM r_orders""")
def _(t):
    return t.orders.select(
        "id", F.datediff(t.as_of.cast("date"), "created_at").alias("age_days"), F.date_add(F.col("created_at").cast("date"), 5).alias("due"),
        (F.col("created_at") - timeutil.interval(hours=36)).alias("before"), timeutil.whole_days("created_at", t.as_of).alias("whole_days"),
    )


@query("E03_formats", """SELECT id, strftime(created_at, '%Y-%m') AS ym, dayname(created_at) AS weekday_name, hour(created_at) AS hour, created_at::date AS parsed FROM r_orders""")
def _(t):
    text = F.element_at(F.array(*[F.date_format("created_at", f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyyMMdd")]), (F.col("id") % 5 + 1).cast("int"))
    from ..sources.readers import parse_upload_date

    return t.orders.select("id", F.date_format("created_at", "yyyy-MM").alias("ym"), F.date_format("created_at", "EEEE").alias("weekday_name"), F.hour("created_at").alias("hour"), parse_upload_date(text).alias("parsed"))


@query("E04_guarded_math", """SELECT id, abs(total_amount - 200000) AS distance, greatest(total_amount, 100000) AS floored, least(total_amount, 300000) AS capped, sqrt(total_amount) AS root, trunc(total_amount)::bigint AS whole,
    total_amount / nullif(id % 3, 0) AS share, id / nullif(id % 4, 0) * 100 AS percent, (total_amount - id) / nullif(id, 0) * 100 AS growth FROM r_orders""")
def _(t):
    a, i = F.col("total_amount"), F.col("id")
    return t.orders.select(
        "id", F.abs(a - 200000).alias("distance"), F.greatest(a, F.lit(100000.0)).alias("floored"), F.least(a, F.lit(300000.0)).alias("capped"), F.sqrt(a).alias("root"), a.cast("bigint").alias("whole"),
        ratio(a, i % 3).alias("share"), pct(i, i % 4).alias("percent"), growth_pct(a, i).alias("growth"),
    )


@query("E05_strings", """SELECT id, upper(trim(name)) AS shout, replace(name, ' ', '_') AS slug, split_part(name, ' ', 1) AS head, starts_with(name, 'red') AS starts, contains(description, 'gizmo') AS has, name ILIKE '%RED%' AS alike,
    regexp_extract(description, '[0-9]+') AS number, substr(name, 2, 3) AS part FROM r_products""")
def _(t):
    n, d = F.col("name"), F.col("description")
    return t.products.select(
        "id", F.upper(F.trim(n)).alias("shout"), F.replace(n, F.lit(" "), F.lit("_")).alias("slug"), F.split_part(n, F.lit(" "), F.lit(1)).alias("head"), n.startswith("red").alias("starts"),
        d.contains("gizmo").alias("has"), n.ilike("%RED%").alias("alike"), F.regexp_extract(d, "[0-9]+", 0).alias("number"), F.substring(n, 2, 3).alias("part"),
    )


@query("E07_arrays", """SELECT id, len(string_split(description, ' ')) AS words, list_contains(string_split(description, ' '), 'red') AS red, array_to_string(string_split(description, ' ')[1:2], '+') AS first_two FROM r_products""")
def _(t):
    words = F.split("description", " ")
    return t.products.select("id", F.size(words).cast("bigint").alias("words"), F.array_contains(words, "red").alias("red"), F.array_join(F.slice(words, 1, 2), "+").alias("first_two"))


@query("E08_maps", "SELECT user_id, count(*) FILTER (status = 'Delivered') AS delivered, count(DISTINCT status) AS statuses FROM r_orders GROUP BY 1")
def _(t):
    counts = t.orders.groupBy("user_id", "status").agg(F.count(F.lit(1)).alias("n"))
    maps = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("status", "n"))).alias("m"))
    return maps.select("user_id", F.coalesce(F.try_element_at("m", F.lit("Delivered")), F.lit(0)).alias("delivered"), F.size("m").cast("bigint").alias("statuses"))


@query("E09_json", """SELECT event_id, json_extract_string(props, '$.k')::bigint AS k, '{"type":"' || event_type || '","user":' || user_id || '}' AS packed FROM events""")
def _(t):
    packed = F.to_json(F.struct(F.col("event_type").alias("type"), F.col("user_id").alias("user")))
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), packed.alias("packed"))


@query("E11_nulls", "SELECT u.id, coalesce(n, 0) AS orders, n IS NULL AS none, coalesce(last, TIMESTAMP '1970-01-01') AS last FROM r_users u LEFT JOIN (SELECT user_id, count(*) AS n, max(created_at) AS last FROM r_orders WHERE status = 'Cancelled' GROUP BY 1) o ON u.id = o.user_id")
def _(t):
    gone = t.orders.filter("status = 'Cancelled'").groupBy(F.col("user_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last"))
    return t.users.select("id").join(gone, "id", "left").select(
        "id", F.coalesce("n", F.lit(0)).alias("orders"), F.col("n").isNull().alias("none"), F.nvl("last", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")).alias("last")
    )


@query("E12_conditionals", "SELECT id, CASE WHEN total_amount > 300000 THEN 'large' WHEN total_amount > 100000 THEN 'medium' ELSE 'small' END AS size, status IN ('Delivered', 'Shipped') AS done FROM r_orders")
def _(t):
    from ..functions.labels import banded

    return t.orders.select("id", banded("total_amount", [(300000, "large"), (100000, "medium")], "small").alias("size"), F.col("status").isin("Delivered", "Shipped").alias("done"))
