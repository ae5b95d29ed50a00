"""Sales: enrichment, commission, balances, refunds, reject reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercelake.functions.money import as_money, half_even_div, percent_of

ADS_PCT = 8
STANDARD_PCT = 10
NO_ITEM_REFUND_PCT = 90


def commission_pct(ads: Column) -> Column:
    return F.when(F.coalesce(ads, F.lit(False)), ADS_PCT).otherwise(STANDARD_PCT)


def enrich(sales: DataFrame, items: DataFrame, sellers: DataFrame) -> DataFrame:
    """Sales with item and seller; sizes decide whether a side is broadcast."""
    return sales.join(items.select("item_id", "title", "price_cents", "active"), "item_id").join(
        sellers.select("seller_id", "name", "ads_contracted"), "seller_id"
    )


def commission_split(sales: DataFrame, sellers: DataFrame) -> DataFrame:
    """Add rate_pct, commission_cents and net_cents to each sale."""
    joined = sales.join(sellers.select("seller_id", "ads_contracted"), "seller_id")
    pct = commission_pct(F.col("ads_contracted"))
    commission = percent_of(F.col("amount_cents"), pct)
    return joined.select(
        "*",
        pct.alias("rate_pct"),
        commission.alias("commission_cents"),
        (F.col("amount_cents") - commission).alias("net_cents"),
    )


def seller_totals(sales: DataFrame, *more_keys: str) -> DataFrame:
    """Sales per seller, with the commission at either rate.

    Both commissions are summed so that sales are reduced to a row per seller before they
    meet the sellers: the facts are never joined, and a seller with very many sales is
    combined where the rows are read.
    """
    amount = F.col("amount_cents")
    return sales.groupBy("seller_id", *more_keys).agg(
        F.count("*").alias("sales"),
        F.sum(amount).alias("gross"),
        F.sum(percent_of(amount, ADS_PCT)).alias("at_ads"),
        F.sum(percent_of(amount, STANDARD_PCT)).alias("at_standard"),
        F.sum(half_even_div(amount, 100)).alias("cashback"),
    )


def with_commission(totals: DataFrame, sellers: DataFrame, how: str = "inner") -> DataFrame:
    """Pick each seller's commission; with how="right" sellers without sales stay, at 0."""
    joined = totals.join(sellers.select("seller_id", "ads_contracted"), "seller_id", how)
    picked = F.when(F.coalesce("ads_contracted", F.lit(False)), F.col("at_ads")).otherwise(F.col("at_standard"))
    out = joined.withColumn("commission", picked).drop("ads_contracted", "at_ads", "at_standard")
    return out.fillna(0, [c for c in out.columns if c != "seller_id"])


def seller_balance(sales: DataFrame, sellers: DataFrame) -> DataFrame:
    """Net earned per seller; sellers without sales have 0.00."""
    totals = with_commission(seller_totals(sales), sellers, "right")
    return totals.select("seller_id", as_money(F.col("gross") - F.col("commission")).alias("seller_net"))


NO_ITEM = "Item not found"
NO_RETURN = "Return not found"


def cart_outcomes(lines: DataFrame, items: DataFrame) -> DataFrame:
    """(cart_id, total_cents, reason): a cart with a missing item is refused, with a reason and
    no total.

    lines: cart_id, item_id, quantity, total_cents (a stated total wins, NULL if absent).
    """
    price = items.select("item_id", "price_cents", F.lit(True).alias("_found"))
    summed = (
        lines.join(price, "item_id", "left")
        .groupBy("cart_id")
        .agg(
            F.max("total_cents").alias("stated"),
            F.sum(F.col("price_cents") * F.coalesce("quantity", F.lit(1))).alias("computed"),
            F.bool_or(F.col("_found").isNull()).alias("missing"),
        )
    )
    refused = F.col("stated").isNull() & F.col("missing")
    total = F.when(~refused, F.coalesce("stated", "computed"))
    return summed.select("cart_id", total.alias("total_cents"), F.when(refused, NO_ITEM).alias("reason"))


def process_returns(returns: DataFrame, requests: DataFrame) -> DataFrame:
    """Returns after a batch of requests to process them: (return_id, status, refund_cents, reason).

    A return that is asked for becomes processed, however often it is asked for; others stay
    requested. A request for an unknown return is a row without status and with a reason.
    """
    asked = requests.select("return_id").distinct().withColumn("_asked", F.lit(True))
    known = returns.select("return_id", "refund_cents", F.lit(True).alias("_known"))
    both = known.join(asked, "return_id", "full_outer")
    status = F.when(F.col("_known"), F.when(F.col("_asked"), "processed").otherwise("requested"))
    return both.select("return_id", status.alias("status"), "refund_cents", F.when(F.col("_known").isNull(), NO_RETURN).alias("reason"))


def cart_summary(lines: DataFrame, items: DataFrame) -> DataFrame:
    """Item count and price total per cart."""
    return (
        lines.join(items.select("item_id", "price_cents"), "item_id")
        .groupBy("cart_id")
        .agg(F.count("*").alias("items"), as_money(F.sum("price_cents")).alias("total"))
    )


def seller_returns(returns: DataFrame, seller_orders: DataFrame) -> DataFrame:
    """Returns whose order holds a sale of the same seller."""
    return returns.join(seller_orders.select("order_id", "seller_id"), ["order_id", "seller_id"], "left_semi")


def refund_amount(returns: DataFrame, items: DataFrame, sellers: DataFrame, basis: str = "current_price") -> DataFrame:
    """Add refund_cents: price less commission when item and seller are known, else 90 % of
    the order total, else nothing. basis "sale_amount" refunds what was paid instead."""
    price = F.col("price_cents") if basis == "current_price" else F.col("amount_cents")
    joined = returns.join(items.select("item_id", "price_cents"), "item_id", "left").join(
        sellers.select("seller_id", "ads_contracted", F.lit(True).alias("_seller")), "seller_id", "left"
    )
    whole = F.col("price_cents").isNotNull() & F.col("_seller")
    part = percent_of(F.col("amount_cents"), NO_ITEM_REFUND_PCT)
    return joined.withColumn(
        "refund_cents",
        F.when(whole, price - percent_of(price, commission_pct(F.col("ads_contracted"))))
        .when(F.col("amount_cents").isNotNull(), part)
        .otherwise(0),
    ).drop("_seller", "ads_contracted", "price_cents")


def orphans(child: DataFrame, checks: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose reference does not resolve, one copy per reason; child is read once.

    checks: reason -> (parent table, shared key), where a parent holds each key once, as its
    identifier. A NULL reference does not resolve.
    """
    joined, missing = child, []
    for i, (reason, (parent, key)) in enumerate(checks.items()):
        known = parent.select(F.col(key).alias(f"_key{i}"))
        joined = joined.join(known, F.col(key) == F.col(f"_key{i}"), "left")
        missing.append(F.when(F.col(f"_key{i}").isNull(), reason))
    return joined.select(*child.columns, F.explode(F.array_compact(F.array(*missing))).alias("reason"))


def with_rate_in_force(sales: DataFrame, campaigns: DataFrame, default_pct: int = STANDARD_PCT) -> DataFrame:
    """Add the commission percentage in force on the day of the sale.

    campaigns: seller_id, starts_on, rate_pct and, if they can end by themselves, ends_on (its day
    no longer counts, NULL is open); a campaign also ends where the seller's next one starts. Campaigns
    are spread over the years they touch up to the year in which the last of all starts, after which
    nothing changes but by an end, and later sales look there. So sales are read once and meet
    campaigns by an equi join on (seller, year), which adaptive execution splits where a seller is
    hot; at most one of the candidates holds the day.
    """
    following = Window.partitionBy("seller_id").orderBy("starts_on")
    own_end = F.col("ends_on") if "ends_on" in campaigns.columns else F.lit(None).cast("date")
    spans = campaigns.withColumn("ends_on", F.least(own_end, F.lead("starts_on").over(following)))
    last = campaigns.agg(F.max(F.year("starts_on"))).scalar()
    ends_in = F.least(F.year(F.date_sub("ends_on", 1)), last)
    binned = spans.select(
        F.col("seller_id").alias("_seller"),
        F.col("starts_on").alias("campaign_start"),
        F.col("ends_on").alias("_ends"),
        F.col("rate_pct").alias("_rate"),
        F.explode(F.sequence(F.year("starts_on"), F.greatest(F.year("starts_on"), ends_in))).alias("_bin"),
    )
    hit = (F.col("seller_id") == F.col("_seller")) & (F.col("_year") == F.col("_bin")) & (F.col("sold_on") >= F.col("campaign_start"))
    hit &= F.col("_ends").isNull() | (F.col("sold_on") < F.col("_ends"))
    left = sales.withColumn("_year", F.least(F.year("sold_on"), last))
    return left.join(binned, hit, "left").select(*sales.columns, "campaign_start", F.coalesce("_rate", F.lit(default_pct)).alias("rate_pct"))


def returned_in_window(returns: DataFrame, orders: DataFrame, days: int = 7) -> DataFrame:
    """Returns asked for at most `days` after delivery."""
    age = F.datediff("returned_on", "delivered_on")
    return returns.join(orders.select("order_id", "delivered_on"), "order_id").where(age.between(0, days))


def _postings(commission: Column, net: Column, cashback: Column) -> Column:
    """Day 0 commission and hold, day 8 release to seller and buyer."""
    rows = [(0, "commission", commission), (0, "escrow_hold", net), (8, "seller_release", net), (8, "buyer_cashback", cashback)]
    return F.inline(
        F.array(*[F.struct(F.lit(d).alias("day"), F.lit(p).alias("posting"), c.alias("cents")) for d, p, c in rows])
    )


def money_timeline(splits: DataFrame) -> DataFrame:
    """The four postings of each sale."""
    cashback = half_even_div(F.col("amount_cents"), 100)
    return splits.select(
        "seller_id", "amount_cents", _postings(F.col("commission_cents"), F.col("net_cents"), cashback)
    )


def money_timeline_totals(sales: DataFrame, sellers: DataFrame) -> DataFrame:
    """The postings of all sales summed per seller, from the sellers' totals."""
    totals = with_commission(seller_totals(sales), sellers)
    net = F.col("gross") - F.col("commission")
    return totals.select("seller_id", _postings(F.col("commission"), net, F.col("cashback")))
