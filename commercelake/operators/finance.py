"""Documented commerce analytics: demand, funnel, escrow, tiers, subscriptions, feeds.

Numbers the documents leave open (tier limits, yield rate, goals) are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercelake.functions.money import as_money, ratio
from commercelake.operators.checkout import loyalty
from commercelake.operators.ordered import numbered, running
from commercelake.operators.sales import seller_totals, with_commission
from commercelake.operators.skew import salted_join

HOLD_DAYS = 8
CASHBACK_DAYS = 7
SUBSCRIPTION_CENTS = 500
ORGANIC_PER_AD = 4

# (level, least monthly revenue in cents, least reputation)
TIERS = [(5, 500_000_000, 3.0), (4, 300_000_000, 2.5), (3, 150_000_000, 2.0), (2, 50_000_000, 1.0), (1, 0, 0.0)]


def demand_score(items: DataFrame, navigation: DataFrame, sales: DataFrame, reviews: DataFrame) -> DataFrame:
    """4 x searches of the last 24 hours + 3 x sales + 3 x positive reviews, per item."""
    newest = navigation.agg(F.max("ts")).scalar()
    searched = (
        navigation.where(F.col("ts") > newest - F.expr("INTERVAL 24 HOURS")).groupBy("item_id").agg(F.count("*").alias("searches"))
    )
    sold = sales.groupBy("item_id").agg(F.count("*").alias("sold"))
    liked = reviews.where("stars >= 4").groupBy("item_id").agg(F.count("*").alias("liked"))
    out = items.select("item_id")
    for fact in (searched, sold, liked):
        out = out.join(fact, "item_id", "left")
    out = out.fillna(0, ["searches", "sold", "liked"])
    return out.withColumn("score", F.col("searches") * 4 + F.col("sold") * 3 + F.col("liked") * 3)


def feed_by_demand(scored: DataFrame, n: int) -> DataFrame:
    return scored.orderBy(F.desc("score"), "item_id").limit(n)


def funnel(events: DataFrame, stages: list[str]) -> DataFrame:
    """Counts per stage in one row, with the rate of each step from the one before."""
    counts = events.agg(*[F.count_if(F.col("event_type") == s).alias(f"{s}s") for s in stages])
    steps = [ratio(F.col(f"{b}s"), F.col(f"{a}s")).alias(f"{b}_rate") for a, b in zip(stages, stages[1:])]
    return counts.select("*", *steps)


def seller_finance(sales: DataFrame, sellers: DataFrame) -> DataFrame:
    """Gross, net, order count and average ticket per seller."""
    per_order = seller_totals(sales, "order_id").groupBy("seller_id").agg(
        *[F.sum(c).alias(c) for c in ("gross", "at_ads", "at_standard")], F.count("*").alias("orders")
    )
    out = with_commission(per_order, sellers).withColumn("net", F.col("gross") - F.col("commission"))
    return out.select(
        "seller_id",
        as_money(F.col("gross")).alias("gross"),
        as_money(F.col("net")).alias("net"),
        "orders",
        ratio(F.col("gross"), F.col("orders") * 100, 2).alias("average_ticket"),
    )


def escrow_status(splits: DataFrame, orders: DataFrame, open_returns: DataFrame, as_of: Column) -> DataFrame:
    """Add escrow: frozen with an open return, held less than 8 days after delivery, else available."""
    joined = salted_join(splits, _order_states(orders, open_returns), ["order_id"])
    return joined.withColumn("escrow", _escrow(as_of)).drop("_frozen")


def _order_states(orders: DataFrame, open_returns: DataFrame) -> DataFrame:
    frozen = open_returns.select("order_id", F.lit(True).alias("_frozen")).distinct()
    return orders.select("order_id", "delivered_on").join(frozen, "order_id", "left")


def _escrow(as_of: Column) -> Column:
    late = F.when(F.datediff(as_of, "delivered_on") < HOLD_DAYS, "held").otherwise("available")
    return F.when(F.col("_frozen"), "frozen").otherwise(late)


def escrow_totals(sales: DataFrame, sellers: DataFrame, orders: DataFrame, open_returns: DataFrame, as_of: Column) -> DataFrame:
    """(seller_id, escrow, sales, net_cents): sales are reduced per seller and order before they
    meet the orders, so no order brings more rows than it has sellers, and again before they
    meet the sellers."""
    per_order = seller_totals(sales, "order_id").drop("cashback")
    states = per_order.join(_order_states(orders, open_returns), "order_id").withColumn("escrow", _escrow(as_of))
    totals = states.groupBy("seller_id", "escrow").agg(*[F.sum(c).alias(c) for c in ("sales", "gross", "at_ads", "at_standard")])
    return with_commission(totals, sellers).select(
        "seller_id", "escrow", "sales", (F.col("gross") - F.col("commission")).alias("net_cents")
    )


def monthly_tier(sales: DataFrame, reputation: DataFrame, tiers=TIERS) -> DataFrame:
    """Level 1-5 per seller and month: the highest whose revenue and reputation are reached."""
    monthly = sales.groupBy("seller_id", F.date_format("sold_on", "yyyy-MM").alias("month")).agg(F.sum("amount_cents").alias("revenue"))
    joined = monthly.join(reputation.select("seller_id", "score"), "seller_id", "left")
    level = F.lit(1)
    for tier, revenue, score in sorted(tiers):
        reached = (F.col("revenue") >= revenue) & (F.coalesce("score", F.lit(0)) >= score)
        level = F.when(reached, tier).otherwise(level)
    return joined.select("seller_id", "month", as_money(F.col("revenue")).alias("revenue"), level.alias("tier"))


def sponsored_feed(organic: DataFrame, ads: DataFrame, order: str) -> DataFrame:
    """(slot, item_id, sponsored): one ad after every four organic items.

    Both streams are numbered, then each number gives its slot; ads left over are dropped
    when the organic items end.
    """
    o = numbered(organic.select("item_id", order), [order], name="_n")
    slot = F.col("_n") + F.call_function("div", F.col("_n") - 1, F.lit(ORGANIC_PER_AD))
    natural = o.select(slot.alias("slot"), "item_id", F.lit(False).alias("sponsored"))
    room = organic.agg(F.call_function("div", F.count("*"), F.lit(ORGANIC_PER_AD))).scalar()
    a = numbered(ads.select("item_id", order), [order], name="_n")
    paid = a.where(F.col("_n") <= room).select(
        (F.col("_n") * (ORGANIC_PER_AD + 1)).alias("slot"), "item_id", F.lit(True).alias("sponsored")
    )
    return natural.unionByName(paid)


def cashback_release(orders: DataFrame, buyers: DataFrame, as_of: Column) -> DataFrame:
    """Cashback of members with the day it is released, 7 days after delivery."""
    earned = loyalty(orders, buyers).where("is_prime")
    due = F.date_add("delivered_on", CASHBACK_DAYS)
    return earned.select(
        "order_id", "buyer_id", as_money(F.col("cashback_cents")).alias("cashback"), due.alias("release_on"), (due <= as_of).alias("released")
    )


def subscription_charges(members: DataFrame) -> DataFrame:
    """One 5.00 charge per month of membership. members: buyer_id, starts_on, ends_on."""
    months = F.explode(F.sequence(F.trunc("starts_on", "MM"), F.trunc("ends_on", "MM"), F.expr("INTERVAL 1 MONTH")))
    return members.select("buyer_id", months.alias("month")).withColumn("charge", as_money(F.lit(SUBSCRIPTION_CENTS)))


def float_yield(orders: DataFrame, rate_per_million: int) -> DataFrame:
    """Held balance and its yield per day, in exact millionths of a cent.

    Orders are summed by day first, and only the day totals are spread over their 8 days.
    """
    daily = orders.groupBy("delivered_on").agg(F.sum("total_cents").alias("cents"))
    days = F.explode(F.sequence("delivered_on", F.date_add("delivered_on", HOLD_DAYS - 1), F.expr("INTERVAL 1 DAY")))
    held = daily.select(days.alias("day"), "cents").groupBy("day").agg(F.sum("cents").alias("held"))
    earned = (F.col("held").cast("decimal(28,0)") * rate_per_million / F.lit(10**6).cast("decimal(8,0)") / 100).cast("decimal(18,4)")
    return held.select("day", as_money(F.col("held")).alias("held"), earned.alias("yield"))


def recommendations(navigation: DataFrame, items: DataFrame, n: int = 5) -> DataFrame:
    """Per buyer the first n items of the categories browsed, most browsed category first.

    At most n items of a category can be needed, so each category is cut to its first n
    before it meets the buyers; no buyer is paired with a whole category.
    """
    category_of = items.select("item_id", "category")
    browsed = (
        navigation.groupBy("buyer_id", "item_id")
        .agg(F.count("*").alias("_v"))
        .join(category_of, "item_id")
        .groupBy("buyer_id", "category")
        .agg(F.sum("_v").alias("views"))
    )
    per_category = Window.partitionBy("category").orderBy("item_id")
    offered = items.where("active").select("category", "item_id", F.row_number().over(per_category).alias("_i")).where(F.col("_i") <= n)
    per_buyer = Window.partitionBy("buyer_id").orderBy(F.desc("views"), "category", "item_id")
    ranked = salted_join(browsed, offered.drop("_i"), ["category"]).withColumn("position", F.row_number().over(per_buyer))
    return ranked.where(F.col("position") <= n).select("buyer_id", "position", "item_id", "category")


def visited_recommendations(navigation: DataFrame, buyers: DataFrame) -> DataFrame:
    """Which list a buyer gets: all items after any session, else the starter item."""
    seen = navigation.select("buyer_id").distinct().withColumn("_seen", F.lit(True))
    return buyers.join(seen, "buyer_id", "left").select(
        "buyer_id", F.when(F.col("_seen"), "all_items").otherwise("starter").alias("product_list")
    )


def goal_progress(sales: DataFrame, goal_cents: int, unit: str) -> DataFrame:
    """Revenue per seller and week or month, and the reached share of a goal (at most 1)."""
    start = F.date_format(F.date_trunc(unit, "sold_on"), "yyyy-MM-dd").alias("period")
    out = sales.groupBy("seller_id", start).agg(F.sum("amount_cents").alias("revenue"))
    share = F.least(ratio(F.col("revenue"), F.lit(goal_cents)), F.lit(1).cast("decimal(18,4)"))
    return out.select("seller_id", "period", as_money(F.col("revenue")).alias("revenue"), share.alias("progress"))


def attributed_purchases(events: DataFrame, within_seconds: int = 3600) -> DataFrame:
    """Purchases with the buyer's last view at most an hour before, as rows and not pairs.

    The last view is a running maximum of the view times, taken in ranges of time so that
    one very busy buyer does not end up in one task.
    """
    at = events.select("event_id", F.col("user_id").alias("buyer_id"), "event_type", "value_cents", F.unix_micros("ts").alias("at"))
    seen = running(at, ["buyer_id"], ["at", "event_id"], {"last_view": ("max", F.when(F.col("event_type") == "view", F.col("at")))})
    age = F.col("at") - F.col("last_view")
    return seen.where("event_type = 'purchase'").where(age.between(0, within_seconds * 10**6)).select(
        "event_id", "buyer_id", as_money(F.col("value_cents")).alias("amount"), F.call_function("div", age, F.lit(10**6)).alias("age_seconds")
    )
