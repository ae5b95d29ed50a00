"""Seller dashboard and reputation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercelake.functions.money import as_money, ratio
from commercelake.operators.ordered import dense_rank_by
from commercelake.operators.sales import seller_totals, with_commission

# Why a review is refused.
NO_SELLER = "Seller not found"
BAD_STARS = "Stars must be between 1 and 5"


def check_reviews(reviews: DataFrame, sellers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with a reason): the seller must exist, stars go from 1 to 5."""
    known = sellers.select("seller_id", F.lit(True).alias("_known"))
    checked = reviews.join(known, "seller_id", "left").withColumn(
        "reason",
        F.when(F.col("_known").isNull(), NO_SELLER).when(~F.coalesce("stars", F.lit(0)).between(1, 5), BAD_STARS),
    )
    return checked.where("reason IS NULL").drop("_known", "reason"), checked.where("reason IS NOT NULL").drop("_known")


def reputation(reviews: DataFrame, sellers: DataFrame) -> DataFrame:
    """Average stars x 20, times the shares without return and without complaint."""
    counted = reviews.groupBy("seller_id").agg(
        F.count("*").alias("n"),
        F.sum("stars").alias("stars"),
        F.count_if(~F.coalesce("returned", F.lit(False))).alias("kept"),
        F.count_if(~F.coalesce("complaint", F.lit(False))).alias("calm"),
    )
    n = F.col("n").cast("double")
    score = F.col("stars") / n * 20.0 * (F.col("kept") / n) * (F.col("calm") / n)
    zero = F.lit(0).cast("decimal(18,2)")
    return (
        sellers.select("seller_id")
        .join(counted, "seller_id", "left")
        .select(
            "seller_id",
            F.coalesce(ratio(F.col("stars"), F.col("n"), 2), zero).alias("average_rating"),
            F.coalesce(ratio(F.col("kept"), F.col("n"), 2), zero).alias("no_return_pct"),
            F.coalesce(ratio(F.col("calm"), F.col("n"), 2), zero).alias("no_complaint_pct"),
            F.coalesce(F.bround(score.cast("decimal(28,12)"), 2).cast("decimal(18,2)"), zero).alias("reputation_score"),
        )
    )


def reputation_stars(reviews: DataFrame) -> DataFrame:
    """The documented 0-5 score: stars weigh 4, the clean share (scaled to 5) weighs 6."""
    clean = ~F.col("returned") & ~F.col("complaint")
    counted = reviews.groupBy("seller_id").agg(
        F.count("*").alias("n"), F.sum("stars").alias("stars"), F.count_if(clean).alias("clean")
    )
    score = ratio(F.col("stars") * 4 + F.col("clean") * 30, F.col("n") * 10, 4)
    return counted.select("seller_id", score.alias("score"), (score < 3.5).alias("penalised"))


def seller_central(sellers: DataFrame, items: DataFrame, sales: DataFrame, returns: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row per seller. Each fact is reduced to one row per seller before any join."""
    listed = items.groupBy("seller_id").agg(
        F.count_if(F.coalesce("active", F.lit(False))).alias("active"), F.count("*").alias("listed")
    )
    sold = with_commission(seller_totals(sales), sellers, "right")
    returned = returns.groupBy("seller_id").agg(F.count("*").alias("returns"))
    score = reputation(reviews, sellers).select("seller_id", "reputation_score")
    joined = sellers.select("seller_id")
    for fact in (listed, sold, returned, score):
        joined = joined.join(fact, "seller_id", "left")
    filled = joined.fillna(0, ["active", "listed", "sales", "gross", "commission", "returns"])
    active, sold_count = F.col("active"), F.col("sales")
    return filled.select(
        "seller_id",
        active.alias("active_items"),
        (F.col("listed") - active).alias("paused_items"),
        (active * 10 + sold_count * 5).alias("impressions"),
        (active * 3 + sold_count * 2).alias("clicks"),
        sold_count.alias("sales_count"),
        as_money(F.col("gross")).alias("gross_revenue"),
        as_money(F.col("commission")).alias("commission_retained"),
        F.col("returns").alias("returns_count"),
        "reputation_score",
        F.when(sold_count > 0, F.array(F.lit("starter-seller"))).otherwise(F.array().cast("array<string>")).alias("badges"),
        F.greatest(F.lit(1).cast("bigint"), F.lit(100) - sold_count * 3).alias("sales_ranking"),
    )


def seller_rank(sales: DataFrame) -> DataFrame:
    """True sales ranking: most sales first, ties share a rank."""
    counts = sales.groupBy("seller_id").agg(F.count("*").alias("sales_count"))
    return dense_rank_by(counts, "sales_count", "sales_rank")
