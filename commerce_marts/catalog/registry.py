"""Registry of named queries, each with the SQL text that states the same result.

A query is a function of :class:`Retail`. Its SQL may use the canonical tables ``r_users``,
``r_orders`` ... (added as CTEs when named) and a few shorthands that are expanded to plain SQL:
``msum(x)`` and ``mavg(x)`` for fixed-point money sums and averages, ``psum(x)`` with four decimals,
``rnd0(x)``, ``rnd1(x)`` and ``rnd2(x)`` for rounding half up on the decimal digits of a double,
``AS_OF`` and ``EV_AS_OF`` for the midnight after the newest order or event, ``NOON`` for noon of the
last order day.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from ..functions import fixed_values as fv
from ..sources.canonical import Retail

QUERIES: dict[str, Callable[[Retail], object]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def _like_sum(col: str, words: list[str]) -> str:
    return " + ".join(f"cast(contains(lower({col}), '{w}') AS int)" for w in words)


def sentiment_sql(col: str, positive: list[str], negative: list[str]) -> str:
    score = f"(({_like_sum(col, positive)}) - ({_like_sum(col, negative)}))"
    return f"CASE WHEN {score} > 0 THEN 'positive' WHEN {score} < 0 THEN 'negative' ELSE 'neutral' END"


CTES = {
    "r_users": """SELECT c_custkey AS id, c_name AS name, lower(c_name) || '@example.com' AS email,
        '9' || lpad(c_custkey::varchar, 9, '0') AS phone, c_custkey % 500 = 0 AS is_admin,
        TIMESTAMP '1995-01-01' + to_days(cast((c_custkey * 37) % 2400 AS int)) AS created_at FROM customer""",
    "r_products": """SELECT p_partkey AS id, 'SKU-' || p_partkey AS sku, p_name AS name, p_type AS category,
        p_brand || ' ' || p_name AS description, p_retailprice AS price, cast((p_partkey * 7) % 61 AS int) AS stock,
        CASE p_size % 3 WHEN 0 THEN 'S,M,L' WHEN 1 THEN 'M,L' ELSE '' END AS sizes,
        TIMESTAMP '1995-01-01' + to_days(cast((p_partkey * 13) % 2400 AS int)) AS created_at FROM part""",
    "r_orders": """SELECT o_orderkey AS id, 'ORD' || o_orderkey AS order_number, o_custkey AS user_id,
        'Customer#' || lpad(o_custkey::varchar, 9, '0') AS customer_name, '9' || lpad(o_custkey::varchar, 9, '0') AS phone,
        'Street ' || (o_custkey % 100) AS address,
        (['Delhi','Mumbai','Pune','Jaipur','Kochi','Panaji','Patna','Guwahati'])[o_custkey % 8 + 1] AS city,
        (['Delhi NCR','Greater Mumbai','Pune','Jaipur','Kerala','Goa','Bihar','Assam'])[o_custkey % 8 + 1] AS state,
        cast(100000 + o_custkey % 900000 AS varchar) AS pincode,
        CASE o_orderstatus
            WHEN 'F' THEN CASE WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 10 = 0 THEN 'Returned' ELSE 'Delivered' END
            WHEN 'O' THEN CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Shipped' WHEN '2' THEN 'Shipped'
                WHEN '3' THEN 'Processing' WHEN '4' THEN 'Confirmed'
                ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'Packed' ELSE 'Out for Delivery' END END
            ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'Cancelled'
                WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 20 = 0 THEN 'Fraud' ELSE 'Pending' END END AS status,
        'TRK' || o_orderkey AS tracking_id, o_totalprice AS total_amount,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'COD' WHEN '2' THEN 'UPI' WHEN '3' THEN 'Card'
            WHEN '4' THEN 'NetBanking' ELSE 'Wallet' END AS payment_method,
        CASE o_orderstatus WHEN 'F' THEN CASE WHEN o_orderpriority < '4' THEN 'Paid' ELSE 'Completed' END
            WHEN 'O' THEN 'Pending' ELSE CASE WHEN o_orderpriority = '5-LOW' THEN 'Failed' ELSE 'Pending' END END AS payment_status,
        CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '3-MEDIUM' AND o_orderkey % 10 = 0 THEN 'Approved'
            ELSE 'Not Requested' END AS return_status,
        o_orderdate + to_seconds((o_orderkey * 7919) % 86400) AS created_at,
        CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN
            o_orderdate + to_seconds((o_orderkey * 7919) % 86400 + (o_orderkey * 13) % 900) END AS cancelled_at FROM orders""",
    "r_items": """SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS order_id, l_partkey AS product_id,
        'Item ' || l_partkey AS product_name,
        CASE l_linenumber % 3 WHEN 0 THEN 'S' WHEN 1 THEN 'M' ELSE 'L' END AS size,
        cast(l_quantity AS int) AS quantity, l_extendedprice / l_quantity AS unit_price FROM lineitem""",
    "r_said": """SELECT conv_id, text || CASE conv_id % 3 WHEN 0 THEN chr(10) || 'Great and fast, order ORD' || conv_id || ' arrived.'
        WHEN 1 THEN chr(10) || 'Bad and slow: where is the refund for #TRK' || conv_id || ', see TKT' || conv_id
        ELSE chr(10) || 'What size is this product' END AS issue FROM conversations WHERE turn = 0 AND role = 'user'""",
    "r_tickets": f"""SELECT conv_id AS id, 'TKT' || conv_id AS ticket_number,
        'customer#' || lpad((conv_id % 150)::varchar, 9, '0') || '@example.com' AS customer_email,
        substr(issue, 1, 80) AS subject, issue, 'ORD' || conv_id AS order_number,
        CASE conv_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Resolved' ELSE 'Closed' END AS status,
        CASE (conv_id * 7) % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' ELSE 'Low' END AS priority,
        CASE conv_id % 2 WHEN 0 THEN 'chat' ELSE 'web' END AS source,
        TIMESTAMP '2001-05-01' + to_days(cast((conv_id * 17) % 93 AS int)) + to_hours(conv_id % 24) AS created_at,
        CASE WHEN conv_id % 4 >= 2 THEN TIMESTAMP '2001-05-01' + to_days(cast((conv_id * 17) % 93 + 1 + conv_id % 6 AS int))
            + to_hours(conv_id % 24) END AS resolved_at,
        {sentiment_sql('issue', fv.REVIEW_POSITIVE, fv.REVIEW_NEGATIVE)} AS sentiment FROM r_said""",
    "r_activities": """SELECT event_id AS id, user_id,
        CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login'
            WHEN 'view' THEN CASE WHEN event_id % 5 = 0 THEN 'feedback' ELSE 'view' END ELSE event_type END AS activity_type,
        CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN CASE event_id % 3 WHEN 0 THEN 'sentiment: positive'
            WHEN 1 THEN 'Sentiment=Negative' ELSE 'sentiment: mixed' END ELSE props END AS activity_details,
        ts AS created_at FROM events""",
    "r_cart": """SELECT event_id AS id, user_id, cast(json_extract_string(props, '$.k') AS bigint) AS product_id,
        cast(1 + event_id % 3 AS int) AS quantity, ts AS created_at FROM events WHERE event_type = 'click'""",
    "r_wishlist": """SELECT event_id AS id, user_id, cast(json_extract_string(props, '$.k') AS bigint) AS product_id,
        ts AS created_at FROM events WHERE event_type = 'view'""",
    "r_sessions": """SELECT event_id AS id, user_id, event_id % 3 <> 0 AS is_active, ts AS last_activity,
        CASE event_id % 2 WHEN 0 THEN 'mobile' ELSE 'desktop' END AS device_type FROM events WHERE event_type = 'signup'""",
    "r_audit": """SELECT event_id AS id, user_id, event_type AS action,
        CASE event_id % 3 WHEN 0 THEN 'order' WHEN 1 THEN 'product' ELSE 'user' END AS entity_type,
        CASE event_id % 7 WHEN 0 THEN '{bad' WHEN 1 THEN '  ' ELSE props END AS old_values, props AS new_values,
        ts AS created_at FROM events""",
    "r_alerts": """SELECT event_id AS id, user_id,
        CASE event_type WHEN 'view' THEN 'stock' WHEN 'click' THEN 'price_drop' ELSE 'general' END AS alert_type,
        'Alert ' || event_id AS title, cast(json_extract_string(props, '$.k') AS bigint) AS product_id,
        event_id % 2 = 0 AS is_read, CASE event_id % 3 WHEN 0 THEN 'high' ELSE 'medium' END AS priority, ts AS created_at,
        CASE WHEN event_id % 4 <> 0 THEN ts + INTERVAL 7 DAY END AS expires_at FROM events""",
    "r_roles": """SELECT cast(r_regionkey AS bigint) AS id, lower(r_name) AS name,
        CASE r_regionkey % 3 WHEN 0 THEN '["view_orders","edit_orders"]' WHEN 1 THEN '["view_products","view_orders"]'
            ELSE '["view_analytics"]' END AS permissions FROM region""",
    "r_user_roles": """SELECT c_custkey AS user_id, cast(c_nationkey % 5 AS bigint) AS role_id FROM customer
        WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') UNION ALL
        SELECT c_custkey, cast((c_nationkey + 1) % 5 AS bigint) FROM customer WHERE c_mktsegment = 'MACHINERY'""",
    "r_documents": """SELECT doc_id AS document_id, 'doc_' || doc_id || '.txt' AS filename, source AS document_type, lang, text,
        CASE doc_id % 4 WHEN 0 THEN 'processed' WHEN 1 THEN 'indexed' WHEN 2 THEN 'uploaded' ELSE 'failed' END AS status,
        TIMESTAMP '2001-01-01' + to_days(cast(doc_id % 200 AS int)) AS created_at FROM documents""",
    "r_review_text": """SELECT doc_id, quality, toxic, text || CASE doc_id % 3 WHEN 0 THEN ' Great quality, love it.'
        WHEN 1 THEN ' Broken and cheap.' ELSE '' END AS review_text FROM documents JOIN labels USING (doc_id)""",
    "r_reviews": f"""SELECT doc_id AS id, doc_id % 150 AS user_id, doc_id * 7 AS order_id, doc_id % 100 AS product_id,
        cast(1 + 2 * quality + (1 - toxic) + doc_id % 2 AS int) AS rating, review_text,
        TIMESTAMP '2001-06-15' + to_days(cast(doc_id % 47 AS int)) + to_hours(doc_id % 24) AS created_at,
        {sentiment_sql('review_text', fv.REVIEW_POSITIVE, fv.REVIEW_NEGATIVE)} AS sentiment FROM r_review_text""",
    "r_runs": """SELECT event_id AS run_id, event_type AS pipeline_id,
        CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 13 = 0 THEN 'running' ELSE 'success' END AS status,
        ts AS start_time, cast(event_id % 1000 AS bigint) AS records_processed FROM events""",
}

_CALLS = {
    "msum": "cast(sum(cast({} AS decimal(18,2))) AS double)",
    "psum": "cast(sum(cast({} AS decimal(18,4))) AS double)",
    "rnd2": "cast(round(cast(cast({} AS varchar) AS decimal(38,18)), 2) AS double)",
    "rnd0": "cast(round(cast(cast({} AS varchar) AS decimal(38,18)), 0) AS bigint)",
    "rnd1": "cast(round(cast(cast({} AS varchar) AS decimal(38,18)), 1) AS double)",
    "mavg": "(cast(sum(cast({0} AS decimal(18,2))) AS double) / count({0}))",
}


def _expand_calls(text: str) -> str:
    for name, template in _CALLS.items():
        pos = text.find(name + "(")
        while pos >= 0:
            depth, end = 0, pos + len(name)
            while True:
                depth += {"(": 1, ")": -1}.get(text[end], 0)
                if depth == 0:
                    break
                end += 1
            text = text[:pos] + template.format(text[pos + len(name) + 1 : end]) + text[end + 1 :]
            pos = text.find(name + "(", pos)
    return text


def add_cte(name: str, body: str) -> None:
    """Share a SQL building block between queries."""
    CTES[name] = body


def oracle_text(body: str) -> str:
    """Plain SQL of a query: needed CTEs in front, shorthands expanded."""
    needed: list[str] = []

    def visit(text: str):
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    body = body.strip()
    ctes = [f"{n} AS ({CTES[n]})" for n in needed]
    head = ""
    own = re.match(r"(?is)with\s+(recursive\s+)?", body)
    if own:
        body = body[own.end():]
        head = "WITH " + ("RECURSIVE " if own.group(1) else "") + ", ".join(ctes + [""] if ctes else [])
    elif ctes:
        head = "WITH " + ", ".join(ctes) + " "
    text = head + body
    text = re.sub(r"\bEV_AS_OF\b", "(SELECT date_trunc('day', max(ts)) + INTERVAL 1 DAY FROM events)", text)
    text = re.sub(r"\bAS_OF\b", "(SELECT max(o_orderdate) + INTERVAL 1 DAY FROM orders)", text)
    text = re.sub(r"\bNOON\b", "(SELECT max(o_orderdate) + INTERVAL 12 HOUR FROM orders)", text)
    return _expand_calls(text)


def all_queries() -> dict:
    from . import load

    load()
    return {name: (lambda spark, root, fn=fn: fn(Retail(spark, root))) for name, fn in QUERIES.items()}


def all_sql() -> dict[str, str]:
    from . import load

    load()
    return {name: oracle_text(text) for name, text in SQL.items()}
