"""Commerce queries: listings, accounts, sales, checkout, wallet, shipping, dashboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from commercelake.functions.money import as_money, money
from commercelake.operators import accounts, checkout, dashboard, listings, research, sales, wallet
from commercelake.plans.registry import query
from commercelake.session import shared_path


def _text(flag):
    return F.when(flag, "true").otherwise("false")


# --- projections and predicates -------------------------------------------------


@query(
    "p01_money",
    """SELECT l_returnflag, l_linenumber,
        CAST(sum(round_even(CAST(l_extendedprice * 0.125 AS DECIMAL(18,3)), 2)) AS DECIMAL(18,2)) AS rounded
    FROM lineitem GROUP BY 1, 2""",
)
def _(e):
    eighth = (F.col("l_extendedprice") * F.lit(0.125)).cast("decimal(18,3)")
    return (
        e.lineitem.select("l_returnflag", "l_linenumber", money(eighth).alias("m"))
        .groupBy("l_returnflag", "l_linenumber")
        .agg(F.sum("m").cast("decimal(18,2)").alias("rounded"))
    )


# Raw categories of depth 0 to 4, so both refusals occur.
RAW_CATEGORY_SQL = """CASE WHEN item_id % 13 = 0 THEN ' > ' WHEN item_id % 11 = 0 THEN category || '> a >b > c '
    WHEN item_id % 3 = 0 THEN '  ' || category || ' > ' || title ELSE category END"""


def _raw_items(e):
    i = F.col("item_id")
    raw = (
        F.when(i % 13 == 0, " > ")
        .when(i % 11 == 0, F.concat("category", F.lit("> a >b > c ")))
        .when(i % 3 == 0, F.concat(F.lit("  "), "category", F.lit(" > "), "title"))
        .otherwise(F.col("category"))
    )
    return e.items.withColumn("category", raw)


@query(
    "p02_normalize_category",
    f"""WITH raw AS (SELECT item_id, {RAW_CATEGORY_SQL} AS c FROM items),
    parts AS (SELECT item_id, list_filter(list_transform(string_split(c, '>'), lambda x: trim(x)), lambda x: x <> '') AS p FROM raw)
    SELECT item_id, array_to_string(p, '|') AS path, CAST(len(p) AS BIGINT) AS depth,
        CASE WHEN len(p) = 0 THEN 'Category is required' WHEN len(p) > 3 THEN 'Category depth exceeds 3 levels' ELSE 'ok' END AS result
    FROM parts""",
)
def _(e):
    out = listings.normalize_category(_raw_items(e))
    return out.select(
        "item_id",
        F.array_join("path", "|").alias("path"),
        F.size("path").cast("bigint").alias("depth"),
        F.coalesce("category_error", F.lit("ok")).alias("result"),
    )


def _listings(e):
    i = F.col("item_id")
    return _raw_items(e).select(
        "item_id",
        F.when(i % 17 == 0, "  ").otherwise(F.col("title")).alias("title"),
        F.when(i % 19 == 0, F.lit(None).cast("string")).otherwise(F.col("category")).alias("description"),
        "category",
        F.array_repeat(F.lit("photo"), (i % 13).cast("int")).alias("photos"),
        F.when(i % 23 == 0, 0).otherwise(F.col("price_cents")).alias("price_cents"),
        (F.col("stock") - 3).alias("stock"),
        F.when(i % 29 == 0, "").otherwise(F.concat(F.lit("sku-"), i.cast("string"))).alias("sku"),
        F.when(i % 2 == 0, F.array(F.lit("price"), F.lit("stock"))).otherwise(F.array(F.lit("title"), F.lit("photos"))).alias("present"),
    )


_LISTING_RULES = f"""WITH raw AS (SELECT item_id, CASE WHEN item_id % 17 = 0 THEN '  ' ELSE title END AS title,
        CASE WHEN item_id % 19 = 0 THEN NULL ELSE {RAW_CATEGORY_SQL} END AS description, {RAW_CATEGORY_SQL} AS category,
        item_id % 13 AS photos, CASE WHEN item_id % 23 = 0 THEN 0 ELSE price END AS price, stock - 3 AS stock,
        CASE WHEN item_id % 29 = 0 THEN '' ELSE 'sku' END AS sku FROM items),
    d AS (SELECT *, len(list_filter(string_split(category, '>'), lambda x: trim(x) <> '')) AS depth FROM raw),
    v AS (SELECT item_id,
        CASE WHEN trim(title) = '' THEN 'Title is required' END AS a,
        CASE WHEN trim(coalesce(description, '')) = '' THEN 'Description is required' END AS b,
        CASE WHEN depth = 0 THEN 'Category is required' WHEN depth > 3 THEN 'Category depth exceeds 3 levels' END AS c,
        CASE WHEN photos NOT BETWEEN 1 AND 10 THEN 'Photos must contain between 1 and 10 images' END AS p,
        CASE WHEN price <= 0 THEN 'Price must be greater than zero' END AS m,
        CASE WHEN stock < 0 THEN 'Stock must be non-negative' END AS s,
        CASE WHEN trim(sku) = '' THEN 'SKU is required' END AS k FROM d)"""


@query(
    "p03_validate_listing",
    _LISTING_RULES
    + """ SELECT item_id, concat_ws('; ', a, b, c, p, m, s, k) AS violations,
        CASE WHEN item_id % 2 = 0 THEN concat_ws('; ', m, s) ELSE concat_ws('; ', a, p) END AS partial_violations FROM v""",
)
def _(e):
    rows = _listings(e)
    full = listings.validate_listing(rows).withColumnRenamed("violations", "full")
    both = listings.validate_listing(full, present="present")
    return both.select(
        "item_id",
        F.array_join("full", "; ").alias("violations"),
        F.array_join("violations", "; ").alias("partial_violations"),
    )


@query(
    "p04_patch",
    """SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'new ' || title ELSE title END AS title,
        CASE WHEN item_id % 3 = 0 THEN price - 1 ELSE price END AS price,
        CASE WHEN item_id % 5 = 0 THEN 5 ELSE CAST(stock AS BIGINT) END AS stock, 'kept' AS reason
    FROM items
    UNION ALL SELECT item_id, ' ', 0.01, -1, 'Title is required' FROM items WHERE item_id % 7 = 0
    UNION ALL SELECT item_id + 1000000000, 'old ' || title, 1.00, -1, 'Item not found' FROM items WHERE item_id % 11 = 0""",
)
def _(e):
    """Up to three updates of an item in turn, some overwritten, some refused."""
    i = F.col("item_id")
    absent = {c: F.lit(None).cast("string") for c in ("description", "category", "sku")}
    absent["photos"] = F.lit(None).cast("array<string>")

    def asked(seq, keys, title, price, stock=None):
        return e.items.select(
            "item_id", F.lit(seq).alias("seq"), F.array_compact(F.array(*keys)).alias("keys"), title.alias("title"),
            price.cast("bigint").alias("price_cents"), F.lit(stock).cast("int").alias("stock"),
        ).withColumns(absent)

    old, blank, new = F.concat(F.lit("old "), "title"), F.lit(" "), F.concat(F.lit("new "), "title")
    first = asked(1, [F.when(i % 2 == 0, "title"), F.when(i % 3 == 0, "price")], old, F.lit(100))
    second = asked(
        2, [F.when(i % 2 == 0, "title"), F.when(i % 3 == 0, "price"), F.when(i % 5 == 0, "stock")], new, F.col("price_cents") - 100, 5
    )
    invalid = asked(3, [F.lit("title"), F.lit("price")], blank, F.lit(1)).where(i % 7 == 0)
    unknown = asked(4, [F.lit("title")], old, F.lit(100)).where(i % 11 == 0).withColumn("item_id", i + 1000000000)
    updates = listings.validate_listing(research.union_all(first, second, invalid, unknown), present="keys")
    fields = {"title": "title", "price": "price_cents", "stock": "stock"}
    changed, refused = listings.patch(e.items, updates, "item_id", fields, "seq", F.get("violations", F.lit(0)))
    out = changed.withColumn("reason", F.lit("kept")).select("item_id", "title", "price_cents", "stock", "reason")
    out = out.unionByName(refused.select("item_id", "title", "price_cents", "stock", "reason"))
    return out.select(
        "item_id",
        "title",
        as_money(F.col("price_cents")).alias("price"),
        F.coalesce("stock", F.lit(-1)).cast("bigint").alias("stock"),
        "reason",
    )


@query(
    "p05_deactivate",
    """SELECT item_id, CASE WHEN active AND stock >= 10 THEN 'active' ELSE 'inactive' END AS state FROM items
    UNION ALL SELECT item_id + 1000000000, 'unknown' FROM items WHERE stock = 1""",
)
def _(e):
    asked = e.items.where("stock < 10").select("item_id")
    unknown = e.items.where("stock = 1").select((F.col("item_id") + 1000000000).alias("item_id"))
    changed, missing = listings.deactivate(e.items, asked.unionByName(unknown))
    return changed.select("item_id", F.when(F.col("active"), "active").otherwise("inactive").alias("state")).unionByName(
        missing.select("item_id", F.lit("unknown").alias("state"))
    )


@query(
    "p06_assign_ids",
    """SELECT item_id, 'Item' || CASE WHEN n = 1 THEN '123' ELSE CAST(n AS VARCHAR) END AS id
    FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM items)""",
)
def _(e):
    return accounts.assign_ids(e.items.select("item_id"), "Item", "item_id")


@query("p07_tracking_code", "SELECT order_id, printf('TRK-%06d', order_id) AS tracking_code FROM orders_placed")
def _(e):
    return e.orders_placed.select("order_id", accounts.tracking_code(F.col("order_id")).alias("tracking_code"))


_MAIL_SQL = "CASE WHEN c_custkey % 9 = 0 THEN '  ' ELSE ' User' || (c_custkey % 500) || '@Example.COM ' END"
_ROLE_SQL = "CASE c_custkey % 5 WHEN 0 THEN ' Seller' WHEN 1 THEN 'ADMIN ' WHEN 2 THEN 'guest' WHEN 3 THEN NULL ELSE 'buyer' END"


def _registrations(e):
    k = F.col("c_custkey")
    return e.customer.select(
        k.alias("seq"),
        F.when(k % 9 == 0, "  ")
        .otherwise(F.concat(F.lit(" User"), (k % 500).cast("string"), F.lit("@Example.COM ")))
        .alias("email"),
        F.when(k % 5 == 0, " Seller").when(k % 5 == 1, "ADMIN ").when(k % 5 == 2, "guest").when(k % 5 == 4, "buyer").alias("role"),
        F.col("c_name").alias("password"),
    )


@query(
    "p08_normalize_email",
    f"""SELECT c_custkey AS seq, lower(trim({_MAIL_SQL})) AS email, lower(trim(coalesce({_ROLE_SQL}, 'buyer'))) AS role,
        CASE WHEN c_custkey % 9 = 0 THEN 'Email and password are required' WHEN c_custkey % 5 = 2 THEN 'Invalid role' ELSE 'ok' END AS result
    FROM customer""",
)
def _(e):
    out = accounts.check_registration(_registrations(e))
    return out.select("seq", "email", "role", F.coalesce("error", F.lit("ok")).alias("result"))


@query("p09_digest", "SELECT c_custkey, sha256(c_name) AS password_hash FROM customer")
def _(e):
    return e.customer.select("c_custkey", accounts.digest(F.col("c_name")).alias("password_hash"))


@query("p10_classify_checkout", "SELECT event_id, buyer_id, amount, method, gateway, decision FROM decided")
def _(e):
    return checkout.classify(e.checkouts).select(
        "event_id", "buyer_id", as_money(F.col("amount_cents")).alias("amount"), "method", "gateway", "decision"
    )


@query(
    "p11_eligible",
    """SELECT event_type, count(*) FILTER (k % 3 = 0 AND k % 2 = 0) AS usable,
        count(*) FILTER (NOT (k % 3 = 0 AND k % 2 = 0)) AS unusable FROM activity GROUP BY 1""",
)
def _(e):
    k = F.col("k")
    flag = checkout.eligible(F.when(k % 3 != 1, k % 3 == 0), F.when(k % 2 == 0, True))
    return (
        e.activity.withColumn("f", flag)
        .groupBy("event_type")
        .agg(F.count_if("f").alias("usable"), F.count_if(~F.col("f")).alias("unusable"))
    )


@query(
    "p12_loyalty_benefits",
    """SELECT order_id, CASE WHEN is_prime AND total > 21 THEN 'true' ELSE 'false' END AS shipping_free,
        CAST(CASE WHEN is_prime THEN round_even(total * 0.01, 2) ELSE 0 END AS DECIMAL(18,2)) AS cashback
    FROM orders_placed JOIN buyers USING (buyer_id)""",
)
def _(e):
    return checkout.loyalty(e.orders_placed, e.buyers).select(
        "order_id", _text(F.col("shipping_free")).alias("shipping_free"), as_money(F.col("cashback_cents")).alias("cashback")
    )


@query(
    "p13_requires_mfa",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 IN (0, 1) THEN 'true' ELSE 'false' END AS strict,
        CASE WHEN c_custkey % 3 = 0 THEN 'true' ELSE 'false' END AS lenient, 'false' AS off FROM customer""",
)
def _(e):
    k = F.col("c_custkey")
    role = F.when(k % 3 == 0, "admin").when(k % 3 == 1, "seller").otherwise("buyer")
    return e.customer.select(
        "c_custkey",
        _text(accounts.requires_mfa(role)).alias("strict"),
        _text(accounts.requires_mfa(role, mfa_for_sellers=False)).alias("lenient"),
        _text(accounts.requires_mfa(role, mfa_required=False)).alias("off"),
    )


@query("p14_feed_filter", "SELECT item_id, category FROM items WHERE category = 'ECONOMY > Brand#11'")
def _(e):
    return listings.feed(e.items, "ECONOMY > Brand#11").select("item_id", "category")


@query(
    "p15_active_paused_split",
    "SELECT CASE WHEN active THEN 'active' ELSE 'paused' END AS state, count(*) AS items FROM items GROUP BY 1",
)
def _(e):
    return listings.by_state(e.items)


@query(
    "p16_apply_defaults",
    """SELECT 'Seller' || s_suppkey AS id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 'Seller' END AS name,
        CASE WHEN s_suppkey % 3 = 0 THEN s_name || '@shop.example' ELSE 'seller' || s_suppkey || '@example.com' END AS email,
        CASE WHEN s_suppkey % 5 = 0 THEN 'true' ELSE 'false' END AS ads_contracted FROM supplier""",
)
def _(e):
    k = F.col("s_suppkey")
    raw = e.supplier.select(
        F.concat(F.lit("Seller"), k.cast("string")).alias("id"),
        F.when(k % 2 == 0, F.col("s_name")).alias("name"),
        F.when(k % 3 == 0, F.concat("s_name", F.lit("@shop.example"))).alias("email"),
        F.when(k % 5 == 0, True).alias("ads_contracted"),
    )
    return accounts.apply_defaults(raw, "Seller", "ads_contracted").withColumn("ads_contracted", _text(F.col("ads_contracted")))


@query(
    "p18_shipping_price",
    """SELECT order_id, CAST(round_even(8.55 * CASE WHEN CAST(total * 100 AS BIGINT) // 1000 > 10000 THEN 1.10 ELSE 1.00 END, 2) AS DECIMAL(18,2)) AS price
    FROM orders_placed""",
)
def _(e):
    price = checkout.shipping_price(F.call_function("div", F.col("total_cents"), F.lit(1000)), F.lit(855).cast("bigint"))
    # totals are scaled by 1000 so that both sides of the 100.00 threshold occur
    return e.orders_placed.select("order_id", as_money(price).alias("price"))


# --- joins ----------------------------------------------------------------------


@query(
    "j01_sale_enrichment",
    """SELECT s.order_id, s.line, i.title, i.price, x.name, s.amount FROM sales s JOIN items i USING (item_id)
    JOIN sellers x ON x.seller_id = s.seller_id""",
)
def _(e):
    return sales.enrich(e.sales, e.items, e.sellers).select(
        "order_id", "line", "title", as_money(F.col("price_cents")).alias("price"), "name", as_money(F.col("amount_cents")).alias("amount")
    )


@query(
    "j02_default_parent",
    """SELECT order_id, CASE WHEN buyer_id % 4 = 0 THEN buyer_id
        ELSE (SELECT min(buyer_id) FROM buyers WHERE is_prime) END AS resolved_id
    FROM orders_placed""",
)
def _(e):
    return accounts.default_parent(e.orders_placed, e.buyers.where("is_prime"), "buyer_id").select("order_id", "resolved_id")


def _cart_lines(e):
    return e.sales.select(
        F.col("order_id").alias("cart_id"),
        "item_id",
        F.when(F.col("line") != 1, F.col("quantity")).alias("quantity"),
        F.when(F.col("order_id") % 10 == 0, F.col("order_id") * 100).alias("total_cents"),
    )


@query(
    "j03_cart_total",
    """WITH x AS (SELECT order_id AS cart_id, bool_or(i.item_id IS NULL) AS missing,
        sum(i.price * CASE WHEN line = 1 THEN 1 ELSE quantity END) AS t
        FROM sales s LEFT JOIN (SELECT * FROM items WHERE stock > 1) i USING (item_id) GROUP BY 1)
    SELECT cart_id, CASE WHEN cart_id % 10 = 0 THEN CAST(cart_id AS DECIMAL(18,2)) WHEN missing THEN CAST(0 AS DECIMAL(18,2))
        ELSE CAST(t AS DECIMAL(18,2)) END AS total, CASE WHEN cart_id % 10 <> 0 AND missing THEN 'Item not found' ELSE 'ok' END AS result
    FROM x""",
)
def _(e):
    out = sales.cart_outcomes(_cart_lines(e), e.items.where("stock > 1"))
    total = as_money(F.coalesce("total_cents", F.lit(0)))
    return out.select("cart_id", total.alias("total"), F.coalesce("reason", F.lit("ok")).alias("result"))


@query(
    "j04_seller_returns",
    """SELECT seller_id, count(*) AS returns FROM returns r WHERE EXISTS
        (SELECT 1 FROM sales s WHERE s.order_id = r.order_id AND s.seller_id = r.seller_id AND NOT s.returned) GROUP BY 1""",
)
def _(e):
    own = sales.seller_returns(e.returns, e.sales.where("NOT returned"))
    return own.groupBy("seller_id").agg(F.count("*").alias("returns"))


@query(
    "j05_refund_amount",
    """SELECT order_id, line, CAST(CASE WHEN i.item_id IS NOT NULL AND x.seller_id IS NOT NULL
            THEN i.price - round_even(i.price * CASE WHEN x.ads_contracted THEN 0.08 ELSE 0.10 END, 2)
            ELSE round_even(r.amount * 0.90, 2) END AS DECIMAL(18,2)) AS refund_amount
    FROM returns r LEFT JOIN (SELECT * FROM items WHERE active) i ON i.item_id = r.item_id
    LEFT JOIN sellers x ON x.seller_id = r.seller_id""",
)
def _(e):
    out = sales.refund_amount(e.returns, e.items.where("active"), e.sellers)
    return out.select("order_id", "line", as_money(F.col("refund_cents")).alias("refund_amount"))


@query(
    "j06_shipping_quotes",
    """SELECT order_id, carrier, eta_days,
        CAST(round_even(base * CASE WHEN total > 100 THEN 1.10 ELSE 1.00 END, 2) AS DECIMAL(18,2)) AS price
    FROM orders_placed, (VALUES ('carrier_a', 8.50, 3), ('carrier_b', 7.25, 5)) c(carrier, base, eta_days)""",
)
def _(e):
    return checkout.quotes(e.orders_placed).select("order_id", "carrier", "eta_days", as_money(F.col("price_cents")).alias("price"))


@query(
    "j07_dispatch",
    """SELECT shipment_id, CASE WHEN known = 0 THEN 'Order not found' WHEN shipment_id % 3 = 2 THEN 'Unsupported carrier'
        ELSE printf('TRK-%06d', shipment_id) END AS outcome FROM (
        SELECT order_id + 1 AS shipment_id, CASE WHEN status = 'P' THEN 0 ELSE 1 END AS known FROM orders_placed)""",
)
def _(e):
    o = F.col("order_id")
    requests = e.orders_placed.select(
        (o + 1).alias("shipment_id"),
        o,
        F.when((o + 1) % 3 == 0, "carrier_a").when((o + 1) % 3 == 1, "carrier_b").otherwise("carrier_x").alias("carrier"),
    )
    out = checkout.dispatch(requests, e.orders_placed.where("status <> 'P'"))
    return out.select("shipment_id", F.coalesce("tracking_code", "reason").alias("outcome"))


@query(
    "j09_unique_email_rejects",
    """WITH m AS (SELECT c_custkey AS seq, 'user' || (c_custkey % 700) AS email FROM customer WHERE c_mktsegment <> 'BUILDING'),
    known AS (SELECT DISTINCT 'user' || (c_custkey % 700) AS email FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT seq, email, CASE WHEN email NOT IN (SELECT email FROM known)
        AND row_number() OVER (PARTITION BY email ORDER BY seq) = 1 THEN 'accepted' ELSE 'Email already registered' END AS result FROM m""",
)
def _(e):
    mails = e.customer.select(
        F.col("c_custkey").alias("seq"),
        F.concat(F.lit(" User"), (F.col("c_custkey") % 700).cast("string")).alias("email"),
        (F.col("c_mktsegment") == "BUILDING").alias("registered"),
    )
    out = accounts.new_registrations(mails.where("NOT registered"), mails.where("registered"))
    return out.select("seq", "email", F.coalesce("reason", F.lit("accepted")).alias("result"))


@query(
    "j17_process_returns",
    """WITH r AS (SELECT order_id * 10 + line AS return_id, line, item_id, CAST(CASE WHEN i.item_id IS NOT NULL AND x.seller_id IS NOT NULL
            THEN i.price - round_even(i.price * CASE WHEN x.ads_contracted THEN 0.08 ELSE 0.10 END, 2)
            ELSE round_even(r.amount * 0.90, 2) END AS DECIMAL(18,2)) AS refund_amount
        FROM returns r LEFT JOIN (SELECT * FROM items WHERE active) i USING (item_id) LEFT JOIN sellers x ON x.seller_id = r.seller_id)
    SELECT return_id, CASE WHEN line > 2 THEN 'processed' ELSE 'requested' END AS outcome, refund_amount FROM r
    UNION ALL SELECT DISTINCT -return_id, 'Return not found', CAST(0 AS DECIMAL(18,2)) FROM r WHERE line = 1""",
)
def _(e):
    refunds = sales.refund_amount(e.returns, e.items.where("active"), e.sellers)
    held = refunds.select((F.col("order_id") * 10 + F.col("line")).alias("return_id"), "line", "refund_cents")
    unknown = held.where("line = 1").select((-F.col("return_id")).alias("return_id"))
    out = sales.process_returns(held, held.where("line > 2").select("return_id").unionByName(unknown))
    refund = as_money(F.coalesce("refund_cents", F.lit(0)))
    return out.select("return_id", F.coalesce("status", "reason").alias("outcome"), refund.alias("refund_amount"))


@query(
    "j11_fk_rejects",
    """SELECT 'Item not found' AS reason, item_id, seller_id, count(*) AS n FROM sales WHERE item_id % 10 = 0 GROUP BY ALL
    UNION ALL SELECT 'Seller not found', item_id, seller_id, count(*) FROM sales JOIN sellers USING (seller_id)
        WHERE NOT ads_contracted GROUP BY ALL""",
)
def _(e):
    found = sales.orphans(
        e.sales.select("item_id", "seller_id"),
        {
            "Item not found": (e.items.where("active"), "item_id"),
            "Seller not found": (e.sellers.where("ads_contracted"), "seller_id"),
        },
    )
    return found.groupBy("reason", "item_id", "seller_id").agg(F.count("*").alias("n"))


@query(
    "j13_rate_in_force",
    """WITH c AS (SELECT DISTINCT seller_id, make_date(year(sold_on), 1 + seller_id % 12, 15) AS starts_on,
            5 + (seller_id + year(sold_on)) % 4 AS rate_pct FROM sales WHERE year(sold_on) % 2 = 0)
    SELECT s.seller_id, coalesce(rate_pct, 10) AS rate_pct, coalesce(strftime(c.starts_on, '%Y-%m-%d'), 'none') AS campaign_start,
        count(*) AS sales, CAST(sum(amount) AS DECIMAL(18,2)) AS gross
    FROM sales s ASOF LEFT JOIN c ON s.seller_id = c.seller_id AND s.sold_on >= c.starts_on GROUP BY 1, 2, 3""",
)
def _(e):
    campaigns = (
        e.sales.where(F.year("sold_on") % 2 == 0)
        .select("seller_id", F.year("sold_on").alias("y"))
        .distinct()
        .select(
            "seller_id",
            F.make_date("y", (F.lit(1) + F.col("seller_id") % 12).cast("int"), F.lit(15)).alias("starts_on"),
            (F.lit(5) + (F.col("seller_id") + F.col("y")) % 4).alias("rate_pct"),
        )
    )
    rated = sales.with_rate_in_force(e.sales, campaigns)
    return rated.groupBy(
        "seller_id", "rate_pct", F.coalesce(F.date_format("campaign_start", "yyyy-MM-dd"), F.lit("none")).alias("campaign_start")
    ).agg(F.count("*").alias("sales"), as_money(F.sum("amount_cents")).alias("gross"))


@query(
    "j14_return_within_window",
    """SELECT order_id, line, amount, date_diff('day', delivered_on, sold_on) AS age FROM returns JOIN orders_placed USING (order_id)
    WHERE sold_on BETWEEN delivered_on AND delivered_on + 7""",
)
def _(e):
    late = e.returns.withColumnRenamed("sold_on", "returned_on")
    kept = sales.returned_in_window(late, e.orders_placed)
    return kept.select(
        "order_id",
        "line",
        as_money(F.col("amount_cents")).alias("amount"),
        F.datediff("returned_on", "delivered_on").cast("bigint").alias("age"),
    )


@query(
    "j15_daily_reconciliation",
    """WITH p AS (SELECT strftime(ts, '%Y-%m-%d') AS day, buyer_id, amount, count(*) AS paid FROM decided
            WHERE decision = 'approved' AND amount >= 10 GROUP BY 1, 2, 3),
    l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, buyer_id, amount, count(*) AS logged FROM decided
            WHERE decision = 'approved' AND amount < 100 GROUP BY 1, 2, 3)
    SELECT day, buyer_id, amount, coalesce(paid, 0) AS paid, coalesce(logged, 0) AS logged,
        CASE WHEN coalesce(paid, 0) = coalesce(logged, 0) THEN 'matched' WHEN coalesce(paid, 0) > coalesce(logged, 0) THEN 'missing_event'
        ELSE 'missing_payment' END AS status FROM p FULL JOIN l USING (day, buyer_id, amount)""",
)
def _(e):
    done = checkout.classify(e.checkouts).where("decision = 'approved'").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    return checkout.reconcile(done.where("amount_cents >= 1000"), done.where("amount_cents < 10000"))


# --- aggregates -----------------------------------------------------------------


@query("g01_commission_split", "SELECT order_id, line, seller_id, amount, commission, CAST(amount - commission AS DECIMAL(18,2)) AS net_amount FROM splits")
def _(e):
    return sales.commission_split(e.sales, e.sellers).select(
        "order_id",
        "line",
        "seller_id",
        as_money(F.col("amount_cents")).alias("amount"),
        as_money(F.col("commission_cents")).alias("commission"),
        as_money(F.col("net_cents")).alias("net_amount"),
    )


@query(
    "g02_seller_balance",
    """SELECT x.seller_id, CAST(coalesce(sum(amount - commission), 0) AS DECIMAL(18,2)) AS seller_net
    FROM sellers x LEFT JOIN splits s ON s.seller_id = x.seller_id GROUP BY 1""",
)
def _(e):
    return sales.seller_balance(e.sales, e.sellers)


_REPUTATION = """reputation AS (SELECT seller_id, CAST(round_even(CAST(sum(stars) / count(*)::DOUBLE AS DECIMAL(28,12)), 2) AS DECIMAL(18,2)) AS average_rating,
        CAST(round_even(CAST(count(*) FILTER (NOT returned) / count(*)::DOUBLE AS DECIMAL(28,12)), 2) AS DECIMAL(18,2)) AS no_return_pct,
        CAST(round_even(CAST(count(*) FILTER (NOT complaint) / count(*)::DOUBLE AS DECIMAL(28,12)), 2) AS DECIMAL(18,2)) AS no_complaint_pct,
        CAST(round_even(CAST((sum(stars) / count(*)::DOUBLE) * 20.0::DOUBLE * (count(*) FILTER (NOT returned) / count(*)::DOUBLE)
            * (count(*) FILTER (NOT complaint) / count(*)::DOUBLE) AS DECIMAL(28,12)), 2) AS DECIMAL(18,2)) AS reputation_score
    FROM reviews GROUP BY 1)"""


@query(
    "g03_seller_central",
    f"""WITH {_REPUTATION}, i AS (SELECT seller_id, count(*) FILTER (active) AS a, count(*) AS n FROM items GROUP BY 1),
    s AS (SELECT seller_id, count(*) AS n, sum(amount) AS gross, sum(commission) AS commission FROM splits GROUP BY 1),
    r AS (SELECT seller_id, count(*) AS n FROM returns GROUP BY 1)
    SELECT x.seller_id, coalesce(i.a, 0) AS active_items, coalesce(i.n, 0) - coalesce(i.a, 0) AS paused_items,
        coalesce(i.a, 0) * 10 + coalesce(s.n, 0) * 5 AS impressions, coalesce(i.a, 0) * 3 + coalesce(s.n, 0) * 2 AS clicks,
        coalesce(s.n, 0) AS sales_count, CAST(coalesce(gross, 0) AS DECIMAL(18,2)) AS gross_revenue,
        CAST(coalesce(commission, 0) AS DECIMAL(18,2)) AS commission_retained, coalesce(r.n, 0) AS returns_count,
        CAST(coalesce(reputation_score, 0) AS DECIMAL(18,2)) AS reputation_score,
        CASE WHEN s.n > 0 THEN 'starter-seller' ELSE '' END AS badges, greatest(1, 100 - 3 * coalesce(s.n, 0)) AS sales_ranking
    FROM sellers x LEFT JOIN i USING (seller_id) LEFT JOIN s USING (seller_id) LEFT JOIN r USING (seller_id) LEFT JOIN reputation USING (seller_id)""",
)
def seller_central_query(e):
    out = dashboard.seller_central(e.sellers, e.items, e.sales, e.returns, e.reviews)
    return out.withColumn("badges", F.array_join("badges", ","))


@query(
    "g04_seller_reputation",
    f"""WITH {_REPUTATION} SELECT x.seller_id, coalesce(average_rating, 0.00::DECIMAL(18,2)) AS average_rating,
        coalesce(no_return_pct, 0.00::DECIMAL(18,2)) AS no_return_pct, coalesce(no_complaint_pct, 0.00::DECIMAL(18,2)) AS no_complaint_pct,
        coalesce(reputation_score, 0.00::DECIMAL(18,2)) AS reputation_score FROM sellers x LEFT JOIN reputation USING (seller_id)""",
)
def _(e):
    return dashboard.reputation(e.reviews, e.sellers)


_METRICS = """SELECT count(*) AS total, count(*) FILTER (decision = 'approved') AS approved, count(*) FILTER (decision = 'blocked') AS blocked,
    CAST(round_even(CAST(count(*) FILTER (decision = 'approved') / count(*)::DOUBLE AS DECIMAL(28,12)), 4) AS DECIMAL(18,4)) AS approval_rate
    FROM decided WHERE decision <> 'rejected'"""


@query("g05_checkout_metrics", _METRICS)
def _(e):
    return checkout.metrics(checkout.classify(e.checkouts).where("decision <> 'rejected'"))


@query(
    "g06_admin_summary",
    """SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS users, (SELECT count(*) FROM supplier) AS sellers,
    (SELECT count(*) FROM customer) AS buyers, (SELECT count(*) FROM orders) AS orders""",
)
def _(e):
    users = e.customer.select("c_name").unionAll(e.supplier.select("s_name"))
    return accounts.summary(users=users, sellers=e.supplier, buyers=e.customer, orders=e.orders)


@query(
    "g07_wallet_balance",
    """SELECT buyer_id, CAST(sum(amount) AS DECIMAL(18,2)) AS balance FROM (
        SELECT buyer_id, amount FROM ledger WHERE amount > 0
        UNION ALL SELECT buyer_id, -amount FROM decided WHERE decision = 'approved' AND method = 'wallet'
        UNION ALL SELECT buyer_id, round_even(total * 0.01, 2) FROM orders_placed JOIN buyers USING (buyer_id) WHERE is_prime
        UNION ALL SELECT o.buyer_id, round_even(r.amount * 0.90, 2) FROM returns r JOIN orders_placed o USING (order_id)) GROUP BY 1""",
)
def _(e):
    credits = e.ledger.where("amount_cents > 0")
    debits = checkout.classify(e.checkouts).where("decision = 'approved' AND method = 'wallet'").select(
        "buyer_id", (-F.col("amount_cents")).alias("amount_cents")
    )
    cashback = checkout.loyalty(e.orders_placed, e.buyers).where("is_prime").select(
        "buyer_id", F.col("cashback_cents").alias("amount_cents")
    )
    share = sales.percent_of(F.col("amount_cents"), sales.NO_ITEM_REFUND_PCT)
    refunds = e.returns.join(e.orders_placed, "order_id").select("buyer_id", share.alias("amount_cents"))
    return wallet.signed_balance(credits, debits, cashback, refunds)


@query(
    "g17_cart_summary",
    """SELECT order_id AS cart_id, count(*) AS items, CAST(sum(price) AS DECIMAL(18,2)) AS total
    FROM sales JOIN items USING (item_id) GROUP BY 1""",
)
def _(e):
    return sales.cart_summary(_cart_lines(e), e.items)


# --- wallet and ranks -----------------------------------------------------------

_FOLD = """WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY buyer_id ORDER BY ts, event_id) AS n FROM ledger),
    f AS (SELECT buyer_id, n, event_id, amount, amount >= 0 AS accepted,
            CASE WHEN amount >= 0 THEN amount ELSE CAST(0 AS DECIMAL(18,2)) END AS balance FROM l WHERE n = 1
        UNION ALL SELECT l.buyer_id, l.n, l.event_id, l.amount, f.balance + l.amount >= 0,
            CAST(CASE WHEN f.balance + l.amount >= 0 THEN f.balance + l.amount ELSE f.balance END AS DECIMAL(18,2))
        FROM f JOIN l ON l.buyer_id = f.buyer_id AND l.n = f.n + 1)"""


@query(
    "w01_wallet_fold",
    _FOLD
    + """ SELECT buyer_id, CAST(arg_max(balance, n) AS DECIMAL(18,2)) AS balance, count(*) FILTER (accepted) AS accepted,
        count(*) FILTER (NOT accepted) AS refused,
        CAST(coalesce(sum(-amount) FILTER (NOT accepted), 0) AS DECIMAL(18,2)) AS refused_amount FROM f GROUP BY 1""",
)
def _(e):
    return wallet.wallet_fold(e.ledger)


@query(
    "w01_wallet_periods",
    _FOLD
    + """ SELECT buyer_id, CAST(arg_max(balance, n) AS DECIMAL(18,2)) AS balance, count(*) FILTER (accepted) AS accepted,
        count(*) FILTER (NOT accepted) AS refused,
        CAST(coalesce(sum(-amount) FILTER (NOT accepted), 0) AS DECIMAL(18,2)) AS refused_amount FROM f GROUP BY 1""",
)
def _(e):
    """Closed twice: what is there at first, then the period that was added."""
    path, closings = shared_path(e.spark, "ledger"), shared_path(e.spark, "closings")
    period = F.floor(F.col("at") / (10 * 86_400 * 10**6)).cast("bigint")
    last = e.ledger.agg(F.max(period)).scalar()
    for rows in (e.ledger.where(period < last), e.ledger.where(period == last)):
        wallet.write_ledger(rows, path, days=10)
        wallet.close_periods(e.spark, path, closings)
    return wallet.closing_balances(e.spark, closings)


@query(
    "w01_wallet_statement",
    _FOLD
    + """ SELECT buyer_id, event_id, CAST(amount AS DECIMAL(18,2)) AS amount, CASE WHEN accepted THEN 'accepted' ELSE 'refused' END AS outcome, balance FROM f""",
)
def _(e):
    return wallet.wallet_statement(e.ledger).select(
        "buyer_id",
        "event_id",
        as_money(F.col("amount_cents")).alias("amount"),
        F.when(F.col("accepted"), "accepted").otherwise("refused").alias("outcome"),
        as_money(F.col("balance_cents")).alias("balance"),
    )


@query(
    "w02_running_balance",
    """SELECT buyer_id, event_id, CAST(sum(amount) OVER (PARTITION BY buyer_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS balance FROM ledger""",
)
def _(e):
    return wallet.running_balance(e.ledger).select("buyer_id", "event_id", as_money(F.col("balance_cents")).alias("balance"))


@query(
    "w05_seller_rank",
    """WITH c AS (SELECT seller_id, count(*) AS sales_count FROM sales GROUP BY 1)
    SELECT seller_id, sales_count, dense_rank() OVER (ORDER BY sales_count DESC) AS sales_rank FROM c""",
)
def _(e):
    return dashboard.seller_rank(e.sales)


@query("k05_newest_first", "SELECT item_id, title FROM items ORDER BY item_id DESC LIMIT 20")
def _(e):
    return listings.newest_first(e.items, 20).select("item_id", "title")


@query(
    "u03_checkout_logs",
    """SELECT event_id, decision, 'checkout' AS log FROM decided WHERE decision <> 'rejected'
    UNION ALL SELECT event_id, decision, 'antifraud' FROM decided WHERE decision = 'blocked'""",
)
def _(e):
    return checkout.logged(checkout.classify(e.checkouts)).select("event_id", "decision", "log")


# --- input checks ---------------------------------------------------------------


@query(
    "c09_membership",
    """WITH s AS (SELECT user_id AS buyer_id, arg_max(CASE WHEN k % 2 = 0 THEN 'Prime-like' ELSE 'none' END, event_id) AS program
        FROM activity WHERE event_type = 'signup' GROUP BY 1)
    SELECT buyer_id, CASE WHEN coalesce(program = 'Prime-like', is_prime) THEN 'true' ELSE 'false' END AS is_prime FROM buyers LEFT JOIN s USING (buyer_id)""",
)
def _(e):
    log = e.activity.where("event_type = 'signup'").select(
        F.col("user_id").alias("buyer_id"),
        F.col("event_id").alias("seq"),
        F.when(F.col("k") % 2 == 0, accounts.MEMBER_PROGRAM).otherwise("none").alias("program"),
    )
    return accounts.apply_subscriptions(e.buyers, log).select("buyer_id", _text(F.col("is_prime")).alias("is_prime"))


@query(
    "g04_review_rejects",
    """SELECT CASE WHEN seller_id % 3 <> 0 THEN 'Seller not found' WHEN line - 1 NOT BETWEEN 1 AND 5 THEN 'Stars must be between 1 and 5' ELSE 'accepted' END AS result,
        seller_id, count(*) AS reviews FROM sales GROUP BY 1, 2""",
)
def _(e):
    reviews = e.sales.select("seller_id", (F.col("line") - 1).alias("stars"))
    good, bad = dashboard.check_reviews(reviews, e.sellers.where("ads_contracted"))
    both = good.select("seller_id", F.lit("accepted").alias("result")).unionByName(bad.select("seller_id", F.col("reason").alias("result")))
    return both.groupBy("result", "seller_id").agg(F.count("*").alias("reviews"))


@query(
    "w01_credit_rejects",
    """SELECT buyer_id, count(*) FILTER (amount > 0) AS accepted, count(*) FILTER (amount <= 0) AS rejected FROM ledger GROUP BY 1""",
)
def _(e):
    good, bad = wallet.check_credits(e.ledger)
    both = good.select("buyer_id", F.lit(True).alias("ok")).unionByName(bad.select("buyer_id", F.lit(False).alias("ok")))
    return both.groupBy("buyer_id").agg(F.count_if("ok").alias("accepted"), F.count_if(~F.col("ok")).alias("rejected"))
