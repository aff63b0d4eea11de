"""The retail model over the star-schema tables.

Each property is a projection of one input table (users and reviews join two), so Catalyst prunes
columns and pushes filters through to the Parquet scan. Schemas are declared, so opening a table
starts no inference job.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


class Retail:
    """Lazy retail tables read from ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def raw(self, table: str) -> DataFrame:
        return self.spark.read.schema(RAW_SCHEMAS[table]).parquet(f"{self.root}/{table}.parquet")

    @cached_property
    def as_of(self) -> Column:
        """Midnight after the newest order, as a scalar subquery."""
        newest = self.raw("orders").agg(F.expr("max(o_orderdate) + interval 1 day").alias("as_of"))
        return newest.scalar()

    @cached_property
    def noon(self) -> Column:
        """Noon of the day of the newest order, so that "today" has orders."""
        return self.raw("orders").agg(F.expr("max(o_orderdate) + interval 12 hours").alias("noon")).scalar()

    @cached_property
    def events_as_of(self) -> Column:
        newest = self.raw("events").agg(F.expr("cast(date_add(cast(max(ts) as date), 1) as timestamp_ntz)").alias("as_of"))
        return newest.scalar()

    @cached_property
    def users(self) -> DataFrame:
        return self.raw("customer").selectExpr(
            "c_custkey AS id",
            "c_name AS name",
            "lower(c_name) || '@example.com' AS email",
            "'9' || lpad(cast(c_custkey AS string), 9, '0') AS phone",
            "c_custkey % 500 = 0 AS is_admin",
            "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast((c_custkey * 37) % 2400 AS int)) AS created_at",
        )

    @cached_property
    def products(self) -> DataFrame:
        return self.raw("part").selectExpr(
            "p_partkey AS id",
            "'SKU-' || p_partkey AS sku",
            "p_name AS name",
            "p_type AS category",
            "p_brand || ' ' || p_name AS description",
            "p_retailprice AS price",
            "cast((p_partkey * 7) % 61 AS int) AS stock",
            "CASE p_size % 3 WHEN 0 THEN 'S,M,L' WHEN 1 THEN 'M,L' ELSE '' END AS sizes",
            "timestamp_ntz'1995-01-01 00:00:00' + make_dt_interval(cast((p_partkey * 13) % 2400 AS int)) AS created_at",
        )

    @cached_property
    def orders(self) -> DataFrame:
        status = """CASE o_orderstatus
            WHEN 'F' THEN CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 10 = 0 THEN 'Returned' ELSE 'Delivered' END
            WHEN 'O' THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Shipped' WHEN '2' THEN 'Shipped'
                WHEN '3' THEN 'Processing' WHEN '4' THEN 'Confirmed'
                ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Packed' ELSE 'Out for Delivery' END END
            ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'Cancelled'
                WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 20 = 0 THEN 'Fraud' ELSE 'Pending' END END"""
        return self.raw("orders").selectExpr(
            "o_orderkey AS id",
            "'ORD' || o_orderkey AS order_number",
            "o_custkey AS user_id",
            "'Customer#' || lpad(cast(o_custkey AS string), 9, '0') AS customer_name",
            "'9' || lpad(cast(o_custkey AS string), 9, '0') AS phone",
            "'Street ' || (o_custkey % 100) AS address",
            "element_at(array('Delhi', 'Mumbai', 'Pune', 'Jaipur', 'Kochi', 'Panaji', 'Patna', 'Guwahati'), "
            "cast(o_custkey % 8 + 1 AS int)) AS city",
            "element_at(array('Delhi NCR', 'Greater Mumbai', 'Pune', 'Jaipur', 'Kerala', 'Goa', 'Bihar', 'Assam'), "
            "cast(o_custkey % 8 + 1 AS int)) AS state",
            "cast(100000 + o_custkey % 900000 AS string) AS pincode",
            f"{status} AS status",
            "'TRK' || o_orderkey AS tracking_id",
            "o_totalprice AS total_amount",
            "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'COD' WHEN '2' THEN 'UPI' WHEN '3' THEN 'Card' "
            "WHEN '4' THEN 'NetBanking' ELSE 'Wallet' END AS payment_method",
            "CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority < '4' THEN 'Paid' ELSE 'Completed' END "
            "WHEN 'O' THEN 'Pending' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'Failed' ELSE 'Pending' END END "
            "AS payment_status",
            "CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' AND o_orderkey % 10 = 0 THEN 'Approved' "
            "ELSE 'Not Requested' END AS return_status",
            "o_orderdate + make_dt_interval(0, 0, 0, cast((o_orderkey * 7919) % 86400 AS int)) AS created_at",
            "CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN o_orderdate + make_dt_interval(0, 0, 0, "
            "cast((o_orderkey * 7919) % 86400 + (o_orderkey * 13) % 900 AS int)) END AS cancelled_at",
        )

    @cached_property
    def order_items(self) -> DataFrame:
        return self.raw("lineitem").selectExpr(
            "l_orderkey * 10 + l_linenumber AS id",
            "l_orderkey AS order_id",
            "l_partkey AS product_id",
            "'Item ' || l_partkey AS product_name",
            "CASE l_linenumber % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END AS size",
            "cast(l_quantity AS int) AS quantity",
            "l_extendedprice / l_quantity AS unit_price",
        )

    @cached_property
    def tickets(self) -> DataFrame:
        from ..functions.lexicon import review_sentiment

        said = self.raw("conversations").filter("turn = 0 AND role = 'user'").selectExpr(
            "conv_id",
            "text || CASE conv_id % 3 WHEN 0 THEN '\nGreat and fast, order ORD' || conv_id || ' arrived.' "
            "WHEN 1 THEN '\nBad and slow: where is the refund for #TRK' || conv_id || ', see TKT' || conv_id "
            "ELSE '\nWhat size is this product' END AS issue",
        )
        return said.selectExpr(
            "conv_id AS id",
            "'TKT' || conv_id AS ticket_number",
            "'customer#' || lpad(cast(conv_id % 150 AS string), 9, '0') || '@example.com' AS customer_email",
            "substr(issue, 1, 80) AS subject",
            "issue",
            "'ORD' || conv_id AS order_number",
            "CASE conv_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Resolved' ELSE 'Closed' END AS status",
            "CASE (conv_id * 7) % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS priority",
            "CASE conv_id % 2 WHEN 0 THEN 'chat' ELSE 'web' END AS source",
            "timestamp_ntz'2001-05-01 00:00:00' + make_dt_interval(cast((conv_id * 17) % 93 AS int), cast(conv_id % 24 AS int)) "
            "AS created_at",
            "CASE WHEN conv_id % 4 >= 2 THEN timestamp_ntz'2001-05-01 00:00:00' + make_dt_interval(cast((conv_id * 17) % 93 + 1 "
            "+ conv_id % 6 AS int), cast(conv_id % 24 AS int)) END AS resolved_at",
        ).withColumn("sentiment", review_sentiment("issue"))

    @cached_property
    def activities(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS id",
            "user_id",
            "CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login' "
            "WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'feedback' ELSE 'view' END ELSE event_type END AS activity_type",
            "CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'sentiment: positive' "
            "WHEN 1 THEN 'Sentiment=Negative' ELSE 'sentiment: mixed' END ELSE props END AS activity_details",
            "ts AS created_at",
        )

    def _event_products(self, kind: str) -> DataFrame:
        return self.raw("events").filter(F.col("event_type") == kind).selectExpr(
            "event_id AS id",
            "user_id",
            "cast(get_json_object(props, '$.k') AS bigint) AS product_id",
            "cast(1 + event_id % 3 AS int) AS quantity",
            "ts AS created_at",
        )

    @cached_property
    def cart_items(self) -> DataFrame:
        return self._event_products("click")

    @cached_property
    def wishlist_items(self) -> DataFrame:
        return self._event_products("view").drop("quantity")

    @cached_property
    def sessions(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'signup'").selectExpr(
            "event_id AS id", "user_id", "event_id % 3 <> 0 AS is_active", "ts AS last_activity",
            "CASE event_id % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS device_type",
        )

    @cached_property
    def audit_logs(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS id", "user_id", "event_type AS action",
            "CASE event_id % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'product' ELSE 'user' END AS entity_type",
            "cast(event_id AS string) AS entity_id",
            "CASE event_id % 7 WHEN 0 THEN '{bad' WHEN 1 THEN '  ' ELSE props END AS old_values",
            "props AS new_values", "ts AS created_at",
        )

    @cached_property
    def alerts(self) -> DataFrame:
        return self.raw("events").selectExpr(
            "event_id AS id", "user_id",
            "CASE event_type WHEN 'view' THEN 'stock' WHEN 'click' THEN 'price_drop' ELSE 'general' END AS alert_type",
            "'Alert ' || event_id AS title",
            "cast(get_json_object(props, '$.k') AS bigint) AS product_id",
            "event_id % 2 = 0 AS is_read",
            "CASE event_id % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS priority",
            "ts AS created_at",
            "CASE WHEN event_id % 4 <> 0 THEN ts + interval 7 days END AS expires_at",
        )

    @cached_property
    def roles(self) -> DataFrame:
        return self.raw("region").selectExpr(
            "cast(r_regionkey AS bigint) AS id", "lower(r_name) AS name",
            "CASE r_regionkey % 3 WHEN 0 THEN '[\"view_orders\",\"edit_orders\"]' WHEN 1 THEN '[\"view_products\",\"view_orders\"]' "
            "ELSE '[\"view_analytics\"]' END AS permissions",
        )

    @cached_property
    def user_roles(self) -> DataFrame:
        one = self.raw("customer").filter("c_mktsegment IN ('BUILDING', 'MACHINERY')")
        two = self.raw("customer").filter("c_mktsegment = 'MACHINERY'")
        return one.selectExpr("c_custkey AS user_id", "cast(c_nationkey % 5 AS bigint) AS role_id").unionByName(
            two.selectExpr("c_custkey AS user_id", "cast((c_nationkey + 1) % 5 AS bigint) AS role_id")
        )

    @cached_property
    def documents(self) -> DataFrame:
        return self.raw("documents").selectExpr(
            "doc_id AS document_id", "'doc_' || doc_id || '.txt' AS filename", "source AS document_type", "lang", "text",
            "CASE doc_id % 4 WHEN 0 THEN 'processed' WHEN 1 THEN 'indexed' WHEN 2 THEN 'uploaded' ELSE 'failed' END AS status",
            "timestamp_ntz'2001-01-01 00:00:00' + make_dt_interval(cast(doc_id % 200 AS int)) AS created_at",
        )

    @cached_property
    def reviews(self) -> DataFrame:
        from ..functions.lexicon import review_sentiment

        docs = self.raw("documents").join(self.raw("labels"), "doc_id")
        return docs.selectExpr(
            "doc_id AS id", "doc_id % 150 AS user_id", "doc_id * 7 AS order_id", "doc_id % 100 AS product_id",
            "cast(1 + 2 * quality + (1 - toxic) + doc_id % 2 AS int) AS rating",
            "text || CASE doc_id % 3 WHEN 0 THEN ' Great quality, love it.' WHEN 1 THEN ' Broken and cheap.' ELSE '' END AS review_text",
            "timestamp_ntz'2001-06-15 00:00:00' + make_dt_interval(cast(doc_id % 47 AS int), cast(doc_id % 24 AS int)) AS created_at",
        ).withColumn("sentiment", review_sentiment("review_text"))

    @cached_property
    def vectors(self) -> DataFrame:
        return self.raw("embeddings")

    @cached_property
    def run_log(self) -> DataFrame:
        """A job history: one run per event, named after the event type."""
        return self.raw("events").selectExpr(
            "event_id AS run_id", "event_type AS pipeline_id",
            "CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'running' ELSE 'success' END AS status",
            "ts AS start_time", "cast(event_id % 1000 AS bigint) AS records_processed",
        )
