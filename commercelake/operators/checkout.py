"""Checkout: gateway and antifraud decisions, loyalty, metrics, reconciliation."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commercelake.functions.money import as_money, half_even_div, ratio

# The configured providers.
GATEWAYS = [("partner_a", True, True), ("partner_b", True, True)]
CARRIERS = [("carrier_a", True, True, 850, 3), ("carrier_b", True, True, 725, 5)]

BLOCK_AT = 80
DEFAULT_RISK = 10
FREE_SHIPPING_OVER = 2100
SURCHARGE_OVER = 10000
SURCHARGE_PCT = 110


def eligible(enabled: Column, healthy: Column) -> Column:
    """Enabled and healthy; an unset flag counts as false."""
    return F.coalesce(enabled, F.lit(False)) & F.coalesce(healthy, F.lit(False))


def usable(name: Column, providers) -> Column:
    """Whether a provider name is configured, enabled and healthy.

    Providers are configuration: a handful of constants, so no table is joined.
    """
    on = [p[0] for p in providers if p[1] and p[2]]
    return F.coalesce(name.isin(*on) if on else F.lit(False), F.lit(False))


def classify(checkouts: DataFrame, gateways=GATEWAYS) -> DataFrame:
    """Add decision: approved, rejected or blocked."""
    risk = F.coalesce("risk_score", F.lit(DEFAULT_RISK))
    wallet = F.col("method") == "wallet"
    card = F.col("method") == "partner_card"
    decision = (
        F.when(wallet & (F.col("balance_cents") >= F.col("amount_cents")), "approved")
        .when(wallet, "rejected")
        .when(card & ~usable(F.col("gateway"), gateways), "rejected")
        .when(card & (risk >= BLOCK_AT), "blocked")
        .when(card, "approved")
        .otherwise("rejected")
    )
    return checkouts.withColumn("decision", decision)


def logged(decided: DataFrame) -> DataFrame:
    """Event log rows: rejections are never logged, blocks go to both logs."""
    logs = F.when(F.col("decision") == "blocked", F.array(F.lit("checkout"), F.lit("antifraud"))).otherwise(
        F.array(F.lit("checkout"))
    )
    return decided.where("decision <> 'rejected'").withColumn("log", F.explode(logs))


def metrics(events: DataFrame) -> DataFrame:
    """Totals and approval rate of logged checkout events."""
    return events.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("decision") == "approved").alias("approved"),
        F.count_if(F.col("decision") == "blocked").alias("blocked"),
    ).withColumn("approval_rate", ratio(F.col("approved"), F.col("total")))


def loyalty(orders: DataFrame, buyers: DataFrame) -> DataFrame:
    """Add shipping_free and cashback_cents by membership."""
    joined = orders.join(buyers.select("buyer_id", "is_prime"), "buyer_id")
    prime = F.coalesce("is_prime", F.lit(False))
    return joined.withColumn("shipping_free", prime & (F.col("total_cents") > FREE_SHIPPING_OVER)).withColumn(
        "cashback_cents", F.when(prime, half_even_div(F.col("total_cents"), 100)).otherwise(0)
    )


def shipping_price(total_cents: Column, base_cents: Column) -> Column:
    """Base rate, 10 % more for totals over 100.00, in cents."""
    pct = F.when(total_cents > SURCHARGE_OVER, SURCHARGE_PCT).otherwise(100)
    return half_even_div(base_cents * pct, 100)


def quotes(orders: DataFrame, carriers=CARRIERS) -> DataFrame:
    """One row per order and eligible carrier, fanned out in place: no join, no shuffle."""
    offers = F.array(
        *[
            F.struct(
                F.lit(name).alias("carrier"), F.lit(rate).cast("bigint").alias("base_cents"), F.lit(eta).alias("eta_days")
            )
            for name, enabled, healthy, rate, eta in carriers
            if enabled and healthy
        ]
    )
    fanned = orders.select("*", F.inline(offers))
    return fanned.withColumn("price_cents", shipping_price(F.col("total_cents"), F.col("base_cents"))).drop("base_cents")


def dispatch(requests: DataFrame, orders: DataFrame, carriers=CARRIERS) -> DataFrame:
    """Shipments with tracking code and status, or the reason a request is refused.

    requests: shipment_id, order_id, carrier.
    """
    known = orders.select("order_id", F.lit(True).alias("_known"))
    checked = requests.join(known, "order_id", "left").withColumn(
        "reason",
        F.when(F.col("_known").isNull(), "Order not found").when(
            ~usable(F.col("carrier"), carriers), "Unsupported carrier"
        ),
    )
    good = F.col("reason").isNull()
    return checked.select(
        "shipment_id",
        "order_id",
        "carrier",
        F.when(good, F.format_string("TRK-%06d", "shipment_id")).alias("tracking_code"),
        F.when(good, "scheduled").alias("status"),
        "reason",
    )


def reconcile(payments: DataFrame, log: DataFrame) -> DataFrame:
    """Payments against the checkout log per day, buyer and amount.

    Both sides are counted first, so a key repeated very often meets as one row a side.
    """
    keys = ["day", "buyer_id", "amount_cents"]
    left = payments.groupBy(*keys).agg(F.count("*").alias("paid"))
    right = log.groupBy(*keys).agg(F.count("*").alias("logged"))
    both = left.join(right, keys, "full_outer")
    paid, seen = F.coalesce("paid", F.lit(0)), F.coalesce("logged", F.lit(0))
    return both.select(
        "day",
        "buyer_id",
        as_money(F.col("amount_cents")).alias("amount"),
        paid.alias("paid"),
        seen.alias("logged"),
        F.when(paid == seen, "matched").when(paid > seen, "missing_event").otherwise("missing_payment").alias("status"),
    )


def savings(orders: DataFrame, buyers: DataFrame, carriers=CARRIERS) -> DataFrame:
    """Shipping waived per member, at the cheapest eligible carrier."""
    cheapest = min(rate for _, enabled, healthy, rate, _ in carriers if enabled and healthy)
    price = shipping_price(F.col("total_cents"), F.lit(cheapest).cast("bigint"))
    large_enough = orders.where(F.col("total_cents") > FREE_SHIPPING_OVER)
    waived = large_enough.groupBy("buyer_id").agg(F.count("*").alias("free_shipments"), as_money(F.sum(price)).alias("saved"))
    return waived.join(buyers.where("is_prime").select("buyer_id"), "buyer_id", "left_semi")
