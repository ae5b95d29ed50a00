"""Golden numbers and invariants of the commerce operators."""

from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from commercelake.functions.money import as_money, cents, money, percent_of, ratio
from commercelake.operators import accounts, checkout, dashboard, listings, sales


def one(df):
    return df.first().asDict()


def sale(spark, amount, ads=False):
    s = spark.createDataFrame([(1, 1, 1, 7, 1, amount)], "order_id int, line int, item_id bigint, seller_id bigint, quantity bigint, amount_cents bigint")
    return s, spark.createDataFrame([(7, "s", ads), (8, "t", ads)], "seller_id bigint, name string, ads_contracted boolean")


@pytest.mark.parametrize("ads,commission,net", [(False, 1000, 9000), (True, 800, 9200)])
def test_commission(spark, ads, commission, net):
    out = one(sales.commission_split(*sale(spark, 10000, ads)))
    assert (out["commission_cents"], out["net_cents"]) == (commission, net)


def test_balance_includes_sellers_without_sales(spark):
    rows = {r["seller_id"]: str(r["seller_net"]) for r in sales.seller_balance(*sale(spark, 10000)).collect()}
    assert rows == {7: "90.00", 8: "0.00"}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 10**9), st.booleans()), min_size=1, max_size=20))
def test_commission_is_half_even_and_conserves_money(spark, data):
    rows = [(i, 1, 1, int(ads), 1, a) for i, (a, ads) in enumerate(data)]
    s = spark.createDataFrame(rows, "order_id int, line int, item_id bigint, seller_id bigint, quantity bigint, amount_cents bigint")
    sellers = spark.createDataFrame([(0, False), (1, True)], "seller_id bigint, ads_contracted boolean")
    for r in sales.commission_split(s, sellers).collect():
        want = (Decimal(r["amount_cents"]) * (8 if r["ads_contracted"] else 10) / 100).quantize(Decimal(1))
        assert r["commission_cents"] == want and r["commission_cents"] + r["net_cents"] == r["amount_cents"]
    split = sales.commission_split(s, sellers).groupBy("seller_id").agg(F.sum("commission_cents").alias("c"))
    totals = sales.with_commission(sales.seller_totals(s), sellers)
    assert {r["seller_id"]: r["c"] for r in split.collect()} == {r["seller_id"]: r["commission"] for r in totals.collect()}


def test_money_rounding(spark):
    df = spark.sql("SELECT 0.125D AS a, 0.135D AS b, 19.99D AS c")
    out = one(df.select(money(F.col("a")).alias("a"), money(F.col("b")).alias("b"), cents(F.col("c")).alias("c"), as_money(F.lit(5)).alias("d")))
    assert (str(out["a"]), str(out["b"]), out["c"], str(out["d"])) == ("0.12", "0.14", 1999, "0.05")
    assert spark.range(1).select(percent_of(F.lit(50).cast("bigint"), 9)).first()[0] == 4
    assert str(spark.range(1).select(ratio(F.lit(1), F.lit(0))).first()[0]) == "0.0000"


def test_loyalty(spark):
    orders = spark.createDataFrame([(1, 1, 2500), (2, 1, 2100), (3, 2, 2500)], "order_id int, buyer_id bigint, total_cents bigint")
    buyers = spark.createDataFrame([(1, True), (2, False)], "buyer_id bigint, is_prime boolean")
    out = {r["order_id"]: (r["shipping_free"], r["cashback_cents"]) for r in checkout.loyalty(orders, buyers).collect()}
    assert out == {1: (True, 25), 2: (False, 21), 3: (False, 0)}


def test_refund(spark):
    returns = spark.createDataFrame([(1, 1, 7, 10000), (2, 9, 7, 10000), (3, 9, 9, None)], "id int, item_id bigint, seller_id bigint, amount_cents bigint")
    items = spark.createDataFrame([(1, 12000)], "item_id bigint, price_cents bigint")
    sellers = spark.createDataFrame([(7, False)], "seller_id bigint, ads_contracted boolean")
    current = {r["id"]: r["refund_cents"] for r in sales.refund_amount(returns, items, sellers).collect()}
    paid = {r["id"]: r["refund_cents"] for r in sales.refund_amount(returns, items, sellers, "sale_amount").collect()}
    assert current == {1: 10800, 2: 9000, 3: 0} and paid[1] == 9000


def test_listing_violations(spark):
    df = spark.createDataFrame(
        [("t", "d", "a > b > c > d", [], 100, 1, "s"), ("", None, "", ["p"] * 11, 0, -1, " ")],
        "title string, description string, category string, photos array<string>, price_cents bigint, stock int, sku string",
    )
    deep, broken = [r["violations"] for r in listings.validate_listing(df).collect()]
    assert deep == ["Category depth exceeds 3 levels", "Photos must contain between 1 and 10 images"]
    assert len(broken) == 7 and broken[0] == "Title is required"


def test_patch_tells_null_from_absent(spark):
    base = spark.createDataFrame([(1, "a", 1500, 2), (2, "b", 5, 5)], "id int, title string, price bigint, stock int")
    new = spark.createDataFrame([(1, ["price", "stock"], "ignored", 1300, None)], "id int, keys array<string>, title string, price bigint, stock int")
    fields = {c: c for c in ("title", "price", "stock")}
    changed, refused = listings.patch(base, new.withColumn("seq", F.lit(1)), "id", fields, "seq")
    assert sorted(map(tuple, changed.collect()), key=str) == [(1, "a", 1300, None), (2, "b", 5, 5)]
    assert refused.isEmpty()


def test_patch_takes_the_last_update_and_refuses_whole_ones(spark):
    base = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "id int, title string, price bigint")
    asked = [
        (1, 1, ["title", "price"], "x", 11), (1, 2, ["title"], "y", 99), (1, 3, ["title", "price"], "", 12), (9, 1, ["title"], "", 1),
    ]
    new = spark.createDataFrame(asked, "id int, seq int, keys array<string>, title string, price bigint")
    fields = {"title": "title", "price": "price"}
    changed, refused = listings.patch(base, new, "id", fields, "seq", F.when(F.col("title") == "", "Title is required"))
    assert sorted(map(tuple, changed.collect())) == [(1, "y", 11), (2, "b", 20)]
    assert sorted((r["id"], r["seq"], r["reason"]) for r in refused.collect()) == [(1, 3, "Title is required"), (9, 1, "Item not found")]


def test_category_as_a_list(spark):
    rows = [(["a ", " ", "b"],), ([],), (None,), (list("abcd"),)]
    out = listings.normalize_category(spark.createDataFrame(rows, "category array<string>")).collect()
    assert [r["path"] for r in out] == [["a", "b"], [], [], list("abcd")]
    assert [r["category_error"] for r in out] == [None, listings.NO_CATEGORY, listings.NO_CATEGORY, listings.DEEP_CATEGORY]


def test_checkout_rules(spark):
    df = spark.createDataFrame(
        [
            (1, "wallet", None, 90, 5000, 3000),
            (2, "wallet", None, 1, 10, 3000),
            (3, "partner_card", "partner_a", 90, 0, 1),
            (4, "partner_card", "partner_a", 10, 0, 1),
            (5, "partner_card", "invalid", 90, 0, 1),
            (6, "partner_card", "partner_b", None, 0, 1),
            (7, "cash", "partner_a", 1, 0, 1),
        ],
        "id int, method string, gateway string, risk_score int, balance_cents bigint, amount_cents bigint",
    )
    decided = checkout.classify(df)
    out = {r["id"]: r["decision"] for r in decided.collect()}
    assert out == {1: "approved", 2: "rejected", 3: "blocked", 4: "approved", 5: "rejected", 6: "approved", 7: "rejected"}
    shown = one(checkout.metrics(decided.where("id IN (3, 4)")))
    assert (shown["total"], shown["blocked"], str(shown["approval_rate"])) == (2, 1, "0.5000")
    empty = one(checkout.metrics(decided.where("false")))
    assert (empty["total"], str(empty["approval_rate"])) == (0, "0.0000")
    assert checkout.logged(decided).where("log = 'antifraud'").count() == 1


def test_quotes_and_dispatch(spark):
    orders = spark.createDataFrame([(1, 12000), (2, 10000)], "order_id bigint, total_cents bigint")
    prices = {(r["order_id"], r["carrier"]): r["price_cents"] for r in checkout.quotes(orders).collect()}
    # 7.25 x 1.10 = 7.975 rounds half-even to 7.98, 8.50 x 1.10 to 9.35
    assert prices == {(1, "carrier_a"): 935, (1, "carrier_b"): 798, (2, "carrier_a"): 850, (2, "carrier_b"): 725}
    down = [("carrier_a", True, False, 850, 3), ("carrier_b", True, True, 725, 5)]
    assert checkout.quotes(orders, down).count() == 2
    requests = spark.createDataFrame([(1, 1, "carrier_a"), (2, 9, "carrier_a"), (3, 2, "x")], "shipment_id bigint, order_id bigint, carrier string")
    out = {r["shipment_id"]: (r["tracking_code"], r["status"], r["reason"]) for r in checkout.dispatch(requests, orders).collect()}
    assert out == {1: ("TRK-000001", "scheduled", None), 2: (None, None, "Order not found"), 3: (None, None, "Unsupported carrier")}


def test_returns_are_processed_once(spark):
    held = spark.createDataFrame([(1, 500), (2, 700)], "return_id bigint, refund_cents bigint")
    asked = spark.createDataFrame([(1,), (1,), (9,)], "return_id bigint")
    out = sorted(map(tuple, sales.process_returns(held, asked).collect()))
    assert out == [(1, "processed", 500, None), (2, "requested", 700, None), (9, None, None, "Return not found")]


def test_dashboard(spark):
    s, sellers = sale(spark, 20000)
    items = spark.createDataFrame([(1, 7, True)], "item_id bigint, seller_id bigint, active boolean")
    reviews = spark.createDataFrame([(7, 5, False, False)], "seller_id bigint, stars bigint, returned boolean, complaint boolean")
    none = s.where("false")
    out = {r["seller_id"]: r.asDict() for r in dashboard.seller_central(sellers, items, s, none, reviews).collect()}
    busy, idle = out[7], out[8]
    assert (busy["active_items"], busy["sales_count"], str(busy["commission_retained"])) == (1, 1, "20.00")
    assert (busy["impressions"], busy["clicks"], busy["sales_ranking"], busy["badges"]) == (15, 5, 97, ["starter-seller"])
    assert str(busy["reputation_score"]) == "100.00" and str(idle["reputation_score"]) == "0.00"
    assert (idle["sales_count"], idle["badges"], idle["sales_ranking"]) == (0, [], 100)
    assert str(one(dashboard.reputation(reviews, sellers.where("seller_id = 7")))["average_rating"]) == "5.00"


def test_ids_and_registration(spark):
    ids = accounts.assign_ids(spark.range(3), "Seller", "id").orderBy("id").collect()
    assert {r["id"] for r in ids} == {"Seller123", "Seller2", "Seller3"}
    df = spark.createDataFrame([("a@x", "p", None), ("", "p", "buyer"), ("b@x", "p", "root")], "email string, password string, role string")
    assert [r["error"] for r in accounts.check_registration(df).collect()] == [None, "Email and password are required", "Invalid role"]


def test_default_parent(spark):
    children = spark.createDataFrame([(5,), (9,)], "buyer_id bigint")
    parents = spark.createDataFrame([(5,), (3,)], "buyer_id bigint")
    out = {r["buyer_id"]: r["resolved_id"] for r in accounts.default_parent(children, parents, "buyer_id").collect()}
    assert out == {5: 5, 9: 3}


def test_rate_in_force_takes_the_latest_campaign(spark):
    sold = spark.createDataFrame([(1, "2020-01-01"), (1, "2020-06-01"), (1, "2023-03-05"), (2, "2020-06-01")], "seller_id int, day string")
    sold = sold.select("seller_id", F.to_date("day").alias("sold_on"))
    campaigns = spark.createDataFrame([(1, "2020-06-01", 8), (1, "2021-02-01", 5)], "seller_id int, day string, rate_pct int")
    campaigns = campaigns.select("seller_id", F.to_date("day").alias("starts_on"), "rate_pct")
    out = {(r["seller_id"], str(r["sold_on"])): r["rate_pct"] for r in sales.with_rate_in_force(sold, campaigns).collect()}
    assert out == {(1, "2020-01-01"): 10, (1, "2020-06-01"): 8, (1, "2023-03-05"): 5, (2, "2020-06-01"): 10}


def test_membership_follows_the_last_program(spark):
    buyers = spark.createDataFrame([(1, False), (2, True), (3, True)], "buyer_id bigint, is_prime boolean")
    log = spark.createDataFrame([(1, 1, "none"), (1, 2, "Prime-like"), (2, 3, None)], "buyer_id bigint, seq int, program string")
    out = {r["buyer_id"]: r["is_prime"] for r in accounts.apply_subscriptions(buyers, log).collect()}
    assert out == {1: True, 2: False, 3: True}


def test_review_checks(spark):
    reviews = spark.createDataFrame([(7, 5), (7, 0), (7, None), (9, 3)], "seller_id bigint, stars int")
    good, bad = dashboard.check_reviews(reviews, spark.createDataFrame([(7,)], "seller_id bigint"))
    assert [tuple(r) for r in good.collect()] == [(7, 5)]
    assert sorted(r["reason"] for r in bad.collect()) == ["Seller not found", *["Stars must be between 1 and 5"] * 2]
