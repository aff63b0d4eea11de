"""Readers, writers, snapshots and the lake run. Each query reads back what was written."""

from __future__ import annotations

import datetime as dt
from uuid import uuid4

from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..operators import metrics
from ..plans import medallion, staging
from ..session import shared_dir
from ..sources import history as periods_of, readers, schemas, sinks
from . import shared as s
from .registry import add_cte, query

DAY = "2001-08-02"


def counted(pairs, t, name="rows"):
    return t.spark.createDataFrame([(k, int(v)) for k, v in pairs.items()], f"table_name string, {name} bigint").coalesce(1)


def summed(df, name, value, digits=2):
    """Rows of a table that was read back, and the sum of one of its columns."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(value).cast(f"decimal(18,{digits})")).cast("double").alias("amount")).select(F.lit(name).alias("table_name"), "rows", "amount")


def plus(out, one):
    return one if out is None else out.unionByName(one)


@query("S01_read_source", "SELECT o_orderstatus AS status, count(*) AS rows FROM orders GROUP BY 1")
def _(t):
    df = readers.read_source(t.spark, "parquet", path=f"{t.root}/orders.parquet")
    return df.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("rows"))


@query("S02_ingest_meta", f"SELECT id, email, TIMESTAMP '{DAY} 01:00:00' AS loaded_at, '{DAY}' AS _execution_date, 'store' AS _source FROM r_users")
def _(t):
    df = readers.with_ingest_meta(t.users.select("id", "email"), DAY, "store", f"{DAY} 01:00:00")
    return df.withColumn("loaded_at", F.col("_ingestion_timestamp").cast("timestamp_ntz")).drop("_ingestion_timestamp")


@query("S03_partitioned_write", "SELECT category, count(*) AS products, msum(price) AS price FROM r_products GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "products")
    sinks.write_table(t.products, path, ["category"])
    return t.spark.read.parquet(path).groupBy("category").agg(F.count(F.lit(1)).alias("products"), metrics.money_sum("price").alias("price"))


@query("S04_orders_with_items", "SELECT 'orders' AS table_name, count(*) AS rows, msum(total_amount) AS amount FROM r_orders UNION ALL SELECT 'order_items', count(*), msum(quantity) FROM r_items")
def _(t):
    root = shared_dir(t.spark, "ingest")
    out = None
    for name, df, value in (("orders", t.orders, "total_amount"), ("order_items", t.order_items, "quantity")):
        sinks.write_table(readers.with_ingest_meta(df, DAY, "store", DAY), f"{root}/{name}")
        out = plus(out, summed(t.spark.read.parquet(f"{root}/{name}"), name, value))
    return out


@query("S05_ticket_ingest", "SELECT created_at::date AS created_on, count(*) AS tickets FROM r_tickets GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "tickets")
    df = readers.with_ingest_meta(t.tickets, DAY, "store", DAY).withColumn("created_on", F.col("created_at").cast("date"))
    sinks.write_table(df, path, ["created_on"])
    return t.spark.read.parquet(path).groupBy("created_on").agg(F.count(F.lit(1)).alias("tickets"))


@query("S06_incremental_ingest", """SELECT 'orders' AS table_name, count(*) AS rows, max(created_at) AS mark FROM r_orders UNION ALL SELECT 'users', count(*), max(created_at) FROM r_users""")
def _(t):
    root, out = shared_dir(t.spark, "increments"), None
    for name, df in (("orders", t.orders), ("users", t.users)):
        mark_col = fv.INGEST_TABLES[name][1]
        # Two loads: rows up to 2000, then all rows beyond the stored mark. A third finds nothing new.
        for part in (df.filter(F.col(mark_col) <= F.lit("2000-01-01").cast("timestamp_ntz")), df, df):
            readers.append_increment(part, f"{root}/{name}", f"{root}/_marks", name, mark_col)
        landed = t.spark.read.parquet(f"{root}/{name}")
        mark = readers.stored_mark(t.spark, f"{root}/_marks", name)
        one = landed.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.lit(name).alias("table_name"), F.lit(mark).cast("timestamp_ntz").alias("mark"))
        out = plus(out, one)
    return out


COPIED = {"customer": "c_acctbal", "part": "p_retailprice", "orders": "o_totalprice", "lineitem": "l_extendedprice", "events": "value"}


@query("S07_land_all", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS rows, msum({c}) AS amount FROM {n}" for n, c in COPIED.items()))
def _(t):
    root, out = shared_dir(t.spark, "landing"), None
    sinks.land_all({n: t.raw(n) for n in COPIED}, root, dt.date(2001, 8, 2))
    for name, value in COPIED.items():
        out = plus(out, summed(t.spark.read.parquet(f"{root}/{name}/2001/08/02"), name, value))
    return out


@query("S08_json_landing", "SELECT event_type, count(*) AS events, msum(value) AS value FROM events GROUP BY 1")
def _(t):
    path = sinks.write_json(t.raw("events").select("event_id", "event_type", "value"), shared_dir(t.spark, "metrics"), dt.datetime(2001, 8, 2, 10, 5))
    back = t.spark.read.schema("event_id bigint, event_type string, value double").json(path)
    return back.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), metrics.money_sum("value").alias("value"))


@query("S09_register", "SELECT category, sum(stock)::bigint AS stock FROM r_products GROUP BY 1")
def _(t):
    path = shared_dir(t.spark, "registered")
    sinks.write_table(t.products, path)
    # A database of its own: nothing that a session's catalog holds is touched.
    name = sinks.register(t.spark, f"commerce_raw_{uuid4().hex}", "products", path)
    return t.spark.sql(f"SELECT category, sum(stock) AS stock FROM {name} GROUP BY category")


@query("S10_conform", "SELECT id, status, round(total_amount, 2) AS total_amount, created_at::date AS created_at, total_items FROM s_fact_orders")
def _(t):
    typed = schemas.conform(staging.fact_orders(t.orders, t.order_items), schemas.schema_of("staging", "fact_orders"))
    return typed.select("id", "status", F.col("total_amount").cast("double").alias("total_amount"), "created_at", "total_items")


def sales_file(t):
    """The daily series as a CSV file, with some values spoiled."""
    path = shared_dir(t.spark, "sales-csv")
    d = F.dayofmonth("date")
    series = metrics.sales_series(t.orders, t.as_of, None).select(
        F.when(d == 13, "n/a").otherwise(F.col("date").cast("string")).alias("date"),
        F.when(d == 14, "unknown").otherwise(F.col("revenue").cast("decimal(18,2)").cast("string")).alias("revenue"),
        F.when(d == 15, "").otherwise(F.col("orders").cast("string")).alias("orders"),
    )
    series.write.mode("overwrite").option("header", True).csv(path)
    return path


add_cte("s_file", """SELECT CASE WHEN day(date) <> 13 THEN date END AS date, CASE WHEN day(date) = 14 THEN 0.0 ELSE revenue END AS revenue, CASE WHEN day(date) = 15 THEN 0 ELSE orders END::int AS orders FROM s_series""")


@query("S11_sales_csv", "SELECT * FROM s_file")
def _(t):
    return readers.read_sales_csv(t.spark, sales_file(t))


@query("D17_sales_file_marts", """SELECT date AS order_date, orders AS order_count, revenue AS total_revenue, rnd2(revenue / greatest(CASE WHEN orders = 0 THEN 1 ELSE orders END, 1)) AS average_value, year(date)::int AS order_year,
    coalesce(dayofweek(date) IN (0, 6), false) AS is_weekend, rnd2(revenue * 0.35::double) AS profit_estimate FROM s_file""")
def _(t):
    return readers.sales_file_marts(readers.read_sales_csv(t.spark, sales_file(t)))


@query("D18_trend", "SELECT * FROM s_file WHERE date IS NOT NULL")
def _(t):
    return readers.trend(readers.read_sales_csv(t.spark, sales_file(t)).filter("date IS NOT NULL"))


def upload(t):
    """An upload in mixed formats, made of all orders: the id decides date format and defects."""
    kind = F.pmod("id", F.lit(7))
    d = F.col("created_at")
    text = F.array(*[F.date_format(d, f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy", "yyyyMMdd")])
    date = F.when(kind == 5, "").when(kind == 6, "soon").otherwise(F.get(text, kind.cast("int")))
    cents = F.col("total_amount").cast("decimal(18,2)").cast("string")
    money = F.when(F.pmod("id", F.lit(11)) == 3, F.concat(F.lit("-"), cents)).when(F.pmod("id", F.lit(11)) == 4, "").otherwise(F.concat(F.lit("$"), cents))
    return t.orders.select(F.col("id").alias("row"), date.alias("Day"), money.alias("Sales"), F.when(F.pmod("id", F.lit(2)) == 0, "2").otherwise("x").alias("Num_Orders"))


@query("S12_sales_upload", """SELECT created_at::date AS date, msum(total_amount) AS revenue, sum(CASE WHEN id % 2 = 0 THEN 2 ELSE 1 END)::bigint AS orders FROM r_orders
    WHERE id % 7 < 5 AND id % 11 NOT IN (3, 4) GROUP BY 1""")
def _(t):
    return readers.normalize_sales_upload(upload(t))[0]


@query("S12_sales_upload_rejects", """SELECT id AS row, 'Row ' || id || ': ' || CASE WHEN id % 7 = 5 THEN 'Missing date value' WHEN id % 7 = 6 THEN 'Invalid date format ''soon''' WHEN id % 11 = 4 THEN 'Missing revenue value'
    ELSE 'Revenue cannot be negative' END AS reason FROM r_orders WHERE id % 7 >= 5 OR id % 11 IN (3, 4)""")
def _(t):
    return readers.normalize_sales_upload(upload(t))[1]


@query("S13_row_payloads", "SELECT ts::date AS date, value AS revenue, 1 AS orders FROM events WHERE event_id % 5 <> 0 AND event_id % 3 <> 0")
def _(t):
    good = F.to_json(F.struct(F.col("ts").cast("date").cast("string").alias("date"), F.when(F.col("event_id") % 3 == 0, "none").otherwise(F.col("value").cast("string")).alias("revenue")))
    return readers.rows_to_df(t.spark, t.raw("events").select(F.when(F.col("event_id") % 5 == 0, "{oops").otherwise(good).alias("payload")))


@query("S14_export_csv", "SELECT 'users' AS table_name, count(*) AS rows, msum(id) AS amount FROM r_users UNION ALL SELECT 'products', count(*), msum(price) FROM r_products UNION ALL SELECT 'orders', count(*), msum(total_amount) FROM r_orders")
def _(t):
    root, out = shared_dir(t.spark, "csv"), None
    sinks.export_csv({"users": t.users, "products": t.products, "orders": t.orders}, root)
    for name, value in (("users", "id"), ("products", "price"), ("orders", "total_amount")):
        out = plus(out, summed(t.spark.read.option("header", True).csv(f"{root}/{name}"), name, value))
    return out


def stock_changes(t):
    """Products, and two rounds of changes to them in one batch."""
    base = t.products.select("id", "category", "price", "stock", F.lit(0).alias("seq"))
    moved = base.filter("stock < 30").select("id", "category", "price", (F.col("stock") + 100).alias("stock"), F.lit(1).alias("seq"))
    again = base.filter("stock < 10").select((F.col("id") + 1_000_000_000).alias("id"), "category", "price", "stock", F.lit(2).alias("seq"))
    later = base.filter("stock < 20").select("id", "category", "price", (F.col("stock") + 200).alias("stock"), F.lit(3).alias("seq"))
    return base, moved.unionByName(again).unionByName(later)


def stock_table(t):
    """A product snapshot with two rounds of changes."""
    table = sinks.SnapshotTable(t.spark, shared_dir(t.spark, "stock"))
    base, changes = stock_changes(t)
    table.commit(base, dt.datetime(2001, 8, 1))
    table.upsert(changes, ["id"], "seq", dt.datetime(2001, 8, 5))
    return table


UPSERTED = """SELECT id, category, CASE WHEN stock < 20 THEN stock + 200 WHEN stock < 30 THEN stock + 100 ELSE stock END AS stock FROM r_products UNION ALL
    SELECT id + 1000000000, category, stock FROM r_products WHERE stock < 10"""


@query("S15_upsert", UPSERTED)
def _(t):
    base, changes = stock_changes(t)
    return sinks.upsert(base, changes, ["id"], "seq").select("id", "category", "stock")


@query("S17_compact", UPSERTED)
def _(t):
    table = stock_table(t)
    table.compact(["category", "id"], 500, dt.datetime(2001, 8, 6))
    return table.read().select("id", "category", "stock")


@query("S18_expire", "SELECT 0 AS version, 'expired' AS state UNION ALL SELECT 1, 'live'")
def _(t):
    table = stock_table(t)
    table.expire(168, dt.datetime(2001, 8, 12))
    expired = table.registry().filter("state = 'expired'").select("version", "state")
    return table.live().select("version", F.lit("live").alias("state")).unionByName(expired)


@query("S19_time_travel", f"SELECT 'first' AS snapshot, count(*) AS rows, sum(stock)::bigint AS stock FROM r_products UNION ALL SELECT 'newest', count(*), sum(stock)::bigint FROM ({UPSERTED})")
def _(t):
    table = stock_table(t)
    out = None
    for name, df in (("first", table.read(as_of=dt.datetime(2001, 8, 3))), ("newest", table.read())):
        one = df.agg(F.count(F.lit(1)).alias("rows"), F.sum("stock").alias("stock")).withColumn("snapshot", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query("S20_evolve", "SELECT id, name, NULL::varchar AS loyalty_level FROM r_users")
def _(t):
    from pyspark.sql import types as T

    return schemas.evolve(t.users.select("id", "name"), T.StructType.fromDDL("id bigint, name string, loyalty_level string"))


@query("S16_append_log", "SELECT table_name, count(*) * 2 AS checks FROM s_log WHERE check_type = 'completeness' GROUP BY 1")
def _(t):
    from ..operators import quality
    from .q_quality import tables

    path = shared_dir(t.spark, "log")
    checks = [c for c in quality.SUITE if c.kind == "completeness"]
    for day in ("2001-08-01 00:00:00", "2001-08-02 00:00:00"):
        sinks.append_log(quality.stamped(quality.run_suite(tables(t), checks), day), path)
    return t.spark.read.parquet(path).groupBy("table_name").agg(F.count(F.lit(1)).alias("checks"))


def columns_sql(*tables):
    """Column names and types of canonical tables as the SQL engine sees them, in Spark's names."""
    kind = "CASE typeof({0}) WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(typeof({0})) END"
    parts = []
    for name, cte, cols in tables:
        types = " || ', ' || ".join(f"'{c}:' || max({kind.format(c)})" for c in cols)
        parts.append(f"SELECT '{name}' AS table_name, {len(cols)} AS columns, {types} AS types, count(*) AS rows FROM {cte}")
    return " UNION ALL ".join(parts)


@query("S21_catalog_profile", columns_sql(
    ("users", "r_users", ["id", "name", "email", "phone", "is_admin", "created_at"]),
    ("products", "r_products", ["id", "sku", "name", "category", "description", "price", "stock", "sizes", "created_at"]),
    ("order_items", "r_items", ["id", "order_id", "product_id", "product_name", "size", "quantity", "unit_price"])))
def _(t):
    return readers.catalog_profile({"users": t.users, "products": t.products, "order_items": t.order_items})


@query("S22_page", "SELECT id, name, email, (SELECT count(*) FROM r_users) AS total FROM r_users ORDER BY id LIMIT 25 OFFSET 50")
def _(t):
    return readers.page(t.users.select("id", "name", "email"), ["id"], 25, 50)


@query("S23_layer_sample", "SELECT 'users' AS table_name, least(count(*), 100) AS rows, count(*) > 100 AS truncated FROM r_users UNION ALL SELECT 'tickets', least(count(*), 100), count(*) > 100 FROM r_tickets")
def _(t):
    out = None
    for name, (df, more) in readers.layer_sample({"users": t.users, "tickets": t.tickets}, 100).items():
        one = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows", F.lit(more).alias("truncated"))
        out = one if out is None else out.unionByName(one)
    return out


@query("X19_replace_chunks", """SELECT doc_id AS document_id, (length(text) * CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 1 END + 799) // 800 AS chunks FROM documents WHERE length(text) > 0""")
def _(t):
    from ..operators import chunking, joins, search

    # Every second document gets a new text, the old one twice; all its old chunks go, not only those with equal ids.
    old = chunking.chunk_fixed(t.documents, "document_id")
    renewed = t.documents.filter("document_id % 2 = 0").withColumn("text", F.concat("text", "text"))
    fresh = chunking.chunk_fixed(renewed, "document_id")
    merged = joins.new_rows(old, fresh.select("document_id").distinct(), ["document_id"]).unionByName(fresh)
    return search.chunk_inventory(merged, "document_id").withColumnRenamed("total_chunks", "chunks")


def history(t):
    """Customer tiers by the orders before 1996, without every tenth customer so that new keys occur; then merged with the tiers of all orders."""
    early = staging.dim_customers(t.users, t.orders.filter("created_at < timestamp_ntz'1996-01-01 00:00:00'"), "1996-01-01").filter("id % 10 <> 0")
    cols = ["id", "email", "customer_segment", "effective_date", "expiration_date", "is_current"]
    now = s.dim_customers(t).select("id", "email", "customer_segment")
    return sinks.scd2_merge(early.select(*cols), now, "id", ["email", "customer_segment"], dt.date(2001, 8, 2)), now


TIER = "CASE WHEN coalesce(m, 0) > 10000 THEN 'VIP' WHEN coalesce(m, 0) > 5000 THEN 'Gold' WHEN coalesce(m, 0) > 1000 THEN 'Silver' ELSE 'Bronze' END"


@query("D02_scd2_merge", f"""WITH e AS (SELECT u.id, email, {TIER} AS seg FROM r_users u LEFT JOIN (SELECT user_id, msum(total_amount) AS m FROM r_orders WHERE created_at < TIMESTAMP '1996-01-01' GROUP BY 1) ON u.id = user_id WHERE u.id % 10 <> 0),
    n AS (SELECT id, email, customer_segment AS seg FROM s_dim_customers), j AS (SELECT n.id, n.email, e.seg AS old, n.seg AS new FROM n LEFT JOIN e ON n.id = e.id)
    SELECT id, email, old AS customer_segment, DATE '1996-01-01' AS effective_date, CASE WHEN old = new THEN DATE '9999-12-31' ELSE DATE '2001-08-02' END AS expiration_date, old = new AS is_current FROM j WHERE old IS NOT NULL
    UNION ALL SELECT id, email, new, DATE '2001-08-02', DATE '9999-12-31', true FROM j WHERE old IS NULL OR old <> new""")
def _(t):
    return history(t)[0]


@query("D02_late_history", """WITH p AS (SELECT user_id, created_at::date AS d, max(status) AS status FROM r_orders WHERE created_at IS NOT NULL GROUP BY 1, 2),
    m AS (SELECT *, lag(status) OVER w AS before, row_number() OVER w AS n FROM p WINDOW w AS (PARTITION BY user_id ORDER BY d))
    SELECT user_id, status, d AS effective_date, coalesce(lead(d) OVER w, DATE '9999-12-31') AS expiration_date, lead(d) OVER w IS NULL AS is_current
    FROM (SELECT * FROM m WHERE n = 1 OR status IS DISTINCT FROM before) WINDOW w AS (PARTITION BY user_id ORDER BY d)""")
def _(t):
    """The newest order status of each customer by day; delivered, shipped and all other orders come as three batches, so most changes are late."""
    batch = F.when(F.col("status") == "Delivered", 0).when(F.col("status") == "Shipped", 1).otherwise(2)
    parts = [t.orders.filter(batch == i).select("user_id", "status", "created_at") for i in range(3)]
    now = periods_of.late_changes(None, parts[0], "user_id", ["status"], "created_at")
    for part in parts[1:]:
        now = periods_of.merge_late(now, part, "user_id", ["status"], "created_at")
    return periods_of.periods(now, "user_id")


@query("S31_medallion_run", """SELECT 'raw' AS layer, 'orders' AS table_name, count(*) AS rows FROM r_orders UNION ALL SELECT 'raw', 'users', count(*) FROM r_users UNION ALL SELECT 'staging', 'fact_order_items', count(*) FROM r_items
    UNION ALL SELECT 'curated', 'sales_daily', count(DISTINCT o_orderdate) FROM orders UNION ALL SELECT 'curated', 'customer_360', count(*) FROM r_users UNION ALL SELECT 'curated', 'inventory_analytics', count(*) FROM r_products""")
def _(t):
    as_of = dt.datetime(2001, 8, 2)
    layers = medallion.run_medallion(t, shared_dir(t.spark, "lake"), as_of, stop_on_fail=False)["layers"]
    shown = {"raw": ["orders", "users"], "staging": ["fact_order_items"], "curated": ["sales_daily", "customer_360", "inventory_analytics"]}
    rows = [(layer, table, int(layers[layer][table])) for layer, names in shown.items() for table in names]
    return t.spark.createDataFrame(rows, "layer string, table_name string, rows bigint").coalesce(1)
