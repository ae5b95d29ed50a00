"""The entity views restated in SQL for the result check."""

from __future__ import annotations

import re

VIEWS = {
    "sellers": "SELECT s_suppkey AS seller_id, s_name AS name, s_suppkey % 3 = 0 AS ads_contracted FROM supplier",
    "buyers": "SELECT c_custkey AS buyer_id, c_name AS name, c_custkey % 4 = 0 AS is_prime FROM customer",
    "items": """SELECT p_partkey AS item_id, p_name AS title, p_type || ' > ' || p_brand AS category,
        CAST(p_retailprice AS DECIMAL(18,2)) AS price, p_size AS stock, p_partkey % 10 <> 0 AS active,
        p_partkey % (SELECT count(*) FROM supplier) AS seller_id FROM part""",
    "sales": """SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS item_id, l_suppkey AS seller_id,
        CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount,
        CAST(l_shipdate AS DATE) AS sold_on, l_returnflag = 'R' AS returned FROM lineitem""",
    "returns": "SELECT * FROM sales WHERE returned",
    "orders_placed": """SELECT o_orderkey AS order_id, o_custkey AS buyer_id,
        CAST(o_totalprice AS DECIMAL(18,2)) AS total, CAST(o_orderdate AS DATE) AS delivered_on,
        o_orderstatus AS status FROM orders""",
    "reviews": """SELECT l_suppkey AS seller_id, l_partkey AS item_id, 1 + l_linenumber % 5 AS stars,
        l_returnflag = 'R' AS returned, l_linestatus = 'F' AND l_quantity > 45 AS complaint FROM lineitem""",
    "activity": """SELECT event_id, ts, user_id, event_type, CAST(value AS DECIMAL(18,2)) AS value,
        CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events""",
    "checkouts": """SELECT event_id, ts, user_id AS buyer_id, value AS amount,
        CASE WHEN event_id % 5 = 0 THEN 'wallet' ELSE 'partner_card' END AS method,
        CASE WHEN event_id % 7 = 0 THEN 'partner_c' WHEN event_id % 2 = 0 THEN 'partner_a' ELSE 'partner_b' END AS gateway,
        k AS risk_score, CAST(60 AS DECIMAL(18,2)) AS balance FROM activity WHERE event_type = 'purchase'""",
    "navigation": """SELECT event_id, ts, user_id AS buyer_id, event_type, k AS item_id FROM activity
        WHERE event_type IN ('view', 'click')""",
    "ledger": """SELECT user_id AS buyer_id, ts, event_id,
        CASE WHEN event_type = 'signup' THEN value ELSE -value END AS amount FROM activity
        WHERE event_type IN ('signup', 'purchase')""",
    "traces": """SELECT event_id, ts, event_type AS phase, user_id AS cycle, value AS latency,
        k >= 12 AS ok, k % 3 AS model, k FROM activity""",
    "results": r"""SELECT 'q' || (page_id % 12) AS query, page_id % 12 AS query_pos, least(2, page_id % 10 % 3 + page_id // 10 % 2) AS source_rank, page_id AS rank,
        regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
        CASE WHEN page_id % 11 = 0 THEN '' ELSE 'http://site' || (page_id % 40) || '.example/' END AS url,
        regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS snippet FROM pages""",
    "decided": """SELECT *, CASE
            WHEN method = 'wallet' THEN CASE WHEN balance >= amount THEN 'approved' ELSE 'rejected' END
            WHEN gateway NOT IN ('partner_a', 'partner_b') THEN 'rejected'
            WHEN risk_score >= 80 THEN 'blocked' ELSE 'approved' END AS decision FROM checkouts""",
    "splits": """SELECT s.*, CASE WHEN ads_contracted THEN 0.08 ELSE 0.10 END AS rate,
            CAST(round_even(amount * CASE WHEN ads_contracted THEN 0.08 ELSE 0.10 END, 2) AS DECIMAL(18,2)) AS commission,
            ads_contracted
        FROM sales s JOIN sellers USING (seller_id)""",
}


def with_views(sql: str) -> str:
    """Prefix the views a query mentions, directly or through another view."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name, body in VIEWS.items():
            if name not in needed and re.search(rf"(?i)\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(body)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS ({VIEWS[name]})" for name in _ordered(needed))
    body = sql.strip()
    for lead in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(lead):
            return f"{lead}{views},\n{body[len(lead):]}"
    return f"WITH {views}\n{body}"


def _ordered(names: set[str]) -> list[str]:
    done: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other in names and other != name and re.search(rf"(?i)\b(FROM|JOIN)\s+{other}\b", VIEWS[name]):
                add(other)
        if name not in done:
            done.append(name)

    for name in VIEWS:
        if name in names:
            add(name)
    return done
