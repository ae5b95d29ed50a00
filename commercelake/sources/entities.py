"""Commerce entities as deterministic views over the base tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commercelake.functions.money import cents
from commercelake.sources.tables import SCHEMAS, load


class Entities:
    """Lazy entity views; nothing is read until a view is used."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in SCHEMAS:
            return load(self.spark, self.folder, name)
        raise AttributeError(name)

    @cached_property
    def sellers(self) -> DataFrame:
        return self.supplier.select(
            F.col("s_suppkey").alias("seller_id"),
            F.col("s_name").alias("name"),
            (F.col("s_suppkey") % 3 == 0).alias("ads_contracted"),
        )

    @cached_property
    def buyers(self) -> DataFrame:
        return self.customer.select(
            F.col("c_custkey").alias("buyer_id"),
            F.col("c_name").alias("name"),
            (F.col("c_custkey") % 4 == 0).alias("is_prime"),
        )

    @cached_property
    def items(self) -> DataFrame:
        sellers = self.supplier.agg(F.count("*")).scalar()
        price = cents(F.col("p_retailprice"))
        return self.part.select(
            F.col("p_partkey").alias("item_id"),
            F.col("p_name").alias("title"),
            F.concat_ws(" > ", "p_type", "p_brand").alias("category"),
            price.alias("price_cents"),
            F.col("p_size").alias("stock"),
            (F.col("p_partkey") % 10 != 0).alias("active"),
            (F.col("p_partkey") % sellers).alias("seller_id"),
        )

    @cached_property
    def sales(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line"),
            F.col("l_partkey").alias("item_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_quantity").cast("bigint").alias("quantity"),
            cents(F.col("l_extendedprice")).alias("amount_cents"),
            F.col("l_shipdate").cast("date").alias("sold_on"),
            (F.col("l_returnflag") == "R").alias("returned"),
        )

    @cached_property
    def returns(self) -> DataFrame:
        return self.sales.where("returned").drop("returned")

    @cached_property
    def orders_placed(self) -> DataFrame:
        return self.orders.select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_custkey").alias("buyer_id"),
            cents(F.col("o_totalprice")).alias("total_cents"),
            F.col("o_orderdate").cast("date").alias("delivered_on"),
            F.col("o_orderstatus").alias("status"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return self.lineitem.select(
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_partkey").alias("item_id"),
            (F.lit(1) + F.col("l_linenumber") % 5).cast("bigint").alias("stars"),
            (F.col("l_returnflag") == "R").alias("returned"),
            ((F.col("l_linestatus") == "F") & (F.col("l_quantity") > 45)).alias("complaint"),
        )

    @cached_property
    def activity(self) -> DataFrame:
        """Events with typed fields; timestamps are taken as UTC."""
        return self.events.select(
            "event_id",
            F.col("ts").cast("timestamp").alias("ts"),
            "user_id",
            "event_type",
            cents(F.col("value")).alias("value_cents"),
            F.get_json_object("props", "$.k").cast("int").alias("k"),
        )

    @cached_property
    def checkouts(self) -> DataFrame:
        """Purchase attempts. Gateway c is not configured, so its attempts are turned away."""
        return self.activity.where("event_type = 'purchase'").select(
            "event_id",
            "ts",
            F.col("user_id").alias("buyer_id"),
            F.col("value_cents").alias("amount_cents"),
            F.when(F.col("event_id") % 5 == 0, "wallet").otherwise("partner_card").alias("method"),
            F.when(F.col("event_id") % 7 == 0, "partner_c")
            .when(F.col("event_id") % 2 == 0, "partner_a")
            .otherwise("partner_b")
            .alias("gateway"),
            F.col("k").alias("risk_score"),
            F.lit(6000).cast("bigint").alias("balance_cents"),
        )

    @cached_property
    def navigation(self) -> DataFrame:
        return self.activity.where("event_type IN ('view', 'click')").select(
            "event_id", "ts", F.col("user_id").alias("buyer_id"), "event_type", F.col("k").cast("bigint").alias("item_id")
        )

    @cached_property
    def ledger(self) -> DataFrame:
        """Wallet movements: signups credit the wallet, purchases debit it."""
        return self.activity.where("event_type IN ('signup', 'purchase')").select(
            F.col("user_id").alias("buyer_id"),
            F.unix_micros("ts").alias("at"),
            "event_id",
            F.when(F.col("event_type") == "signup", F.col("value_cents"))
            .otherwise(-F.col("value_cents"))
            .alias("amount_cents"),
        )

    @cached_property
    def traces(self) -> DataFrame:
        """Model calls: phase, latency, outcome, cycle and model."""
        return self.activity.select(
            "event_id",
            "ts",
            F.col("event_type").alias("phase"),
            F.col("user_id").alias("cycle"),
            F.col("value_cents").alias("latency_cents"),
            (F.col("k") >= 12).alias("ok"),
            (F.col("k") % 3).cast("bigint").alias("model"),
            F.col("k").cast("bigint").alias("k"),
        )

    @cached_property
    def results(self) -> DataFrame:
        """Search results: twelve queries, three sources, some rows without a URL."""
        return self.pages.select(
            F.concat(F.lit("q"), (F.col("page_id") % 12).cast("string")).alias("query"),
            (F.col("page_id") % 12).alias("query_pos"),
            F.least(F.lit(2), F.col("page_id") % 10 % 3 + F.floor(F.col("page_id") / 10) % 2).cast("int").alias("source_rank"),
            F.col("page_id").alias("rank"),
            F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"),
            F.when(F.col("page_id") % 11 == 0, "")
            .otherwise(F.concat(F.lit("http://site"), (F.col("page_id") % 40).cast("string"), F.lit(".example/")))
            .alias("url"),
            F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1).alias("snippet"),
        )
