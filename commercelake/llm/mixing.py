"""Mixing sources to target weights: Efraimidis-Spirakis sampling.

A source's target is its share by weight, at most `cap` times its size; what exceeds a cap is
shared again. Complete epochs come first: each document counts floor(target / size of the
source) times. The rest of the budget goes to documents in ascending order of -ln(u) / w, u
from a hash of the identifier and w a quality weight, up to the prefix sum nearest to it.

Prefix sums are taken in two steps: keys fall into buckets, a monotone function of the key,
and windows span one bucket or the bucket totals of one source, so a hot source is spread. A key
is exponential with its document's weight as rate, so the function is the distribution of keys
under the weights that occur, each rounded down to a power of two: no bucket expects more than
twice its share, however the weights are spread.

Null texts have size 0 and are never taken. A null source is a source, last in order. Rows
that share an identifier share a key and may be taken apart. Empty tables give an empty
result; other columns are ignored, except for the weight column if one is named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercelake.session import cut_lineage

WEIGHTS = (5, 2, 1)
BUCKET_ROWS = 20_000


def n_words(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def quality_weight(text: Column, size: Column) -> Column:
    """Between 0 and 1, best where words have about six characters with their blank."""
    mean = F.length(text) / F.greatest(size, F.lit(1))
    return 1 / (1 + F.abs(F.log(F.greatest(mean, F.lit(0.01)) / 6)))


def targets(sizes: DataFrame, weights=WEIGHTS, total_share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target from one row per source (source, source_size).

    Sources by code point, null last, take the weights in turn. With sources in the order of
    cap * size / weight, the first ones are capped and the others share the rest by weight: a
    source is capped if its ratio is at most the level that holds if it and all later ones
    share what the earlier ones leave.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    cap_size = F.lit(float(cap)) * F.col("source_size")
    rows = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    rows = rows.withColumn("_cap", cap_size).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    whole = Window.partitionBy()
    order = Window.orderBy("_ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum(F.col("source_size") * F.lit(total_share)).over(whole)
    level = (budget - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    rows = rows.select("*", level.alias("_level"))
    open_level = F.max(F.when(F.col("_ratio") > F.col("_level"), F.col("_level"))).over(whole)
    return rows.withColumn("_open", open_level).select(
        "source",
        "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_open") * F.col("_w"), F.col("_cap"))).alias("target"),
    )


def bucket_of(key: Column, octaves: dict[int, int], buckets: int) -> Column:
    """0 to buckets - 1, ascending in the key; octaves: rows by floor(log2(weight)), one or two thousand at most."""
    rows = max(1, sum(octaves.values()))
    below = sum((F.lit(n / rows) * -F.expm1(F.lit(-(2.0**o)) * key) for o, n in sorted(octaves.items())), F.lit(0.0))
    return F.least(F.lit(buckets - 1), F.floor(F.lit(buckets) * below)).cast("bigint")


def mix_counts(
    docs: DataFrame, weights=WEIGHTS, total_share: float = 1.5, cap: float = 2.0, weight: str | None = None, seed: int = 17, carry: tuple = ()
) -> DataFrame:
    """doc_id, source, size, source_size, target, epochs (times the document is taken), taken, and columns to carry."""
    size = n_words(F.col("text"))
    sized = docs.select("doc_id", "source", size.alias("size"), F.length("text").alias("_len"), *carry, *([F.col(weight).alias("_q")] if weight else []))
    mean = F.coalesce(F.col("_len"), F.lit(0)) / F.greatest(F.col("size"), F.lit(1))
    quality = F.col("_q").cast("double") if weight else 1 / (1 + F.abs(F.log(F.greatest(mean, F.lit(0.01)) / 6)))
    quality = F.greatest(F.least(F.nanvl(F.coalesce(quality, F.lit(0.0)), F.lit(0.0)), F.lit(1e300)), F.lit(1e-6))
    sized = cut_lineage(sized.select("doc_id", "source", "size", quality.alias("_w"), *carry))
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id")), 11).cast("double") + 0.5) / F.lit(float(1 << 53))
    keyed = sized.select("doc_id", "source", "size", *carry, (-F.log(u) / F.col("_w")).alias("_key"), F.floor(F.log2("_w")).cast("int").alias("_octave"))
    octaves = {r["_octave"]: r["n"] for r in keyed.groupBy("_octave").agg(F.count("*").alias("n")).collect()}
    buckets = max(16, -(-sum(octaves.values()) // BUCKET_ROWS))
    keyed = keyed.select("doc_id", "source", "size", *carry, "_key", bucket_of(F.col("_key"), octaves, buckets).alias("_bucket"))
    per_bucket = keyed.groupBy("source", "_bucket").agg(F.sum("size").alias("_in_bucket"))
    per_source = per_bucket.groupBy("source").agg(F.sum("_in_bucket").cast("bigint").alias("source_size"))
    goal = targets(per_source, weights, total_share, cap).select(
        "source",
        "source_size",
        "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint").alias("_epochs"),
    )
    goal = goal.withColumn("_rest", F.col("target") - F.col("_epochs") * F.col("source_size"))
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_bucket.select("source", "_bucket", F.coalesce(F.sum("_in_bucket").over(earlier), F.lit(0)).alias("_ahead"))
    ahead = ahead.join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    ahead = ahead.withColumnRenamed("source", "_s").withColumnRenamed("_bucket", "_b")
    within = Window.partitionBy("source", "_bucket").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    summed = keyed.select("*", F.coalesce(F.sum("size").over(within), F.lit(0)).alias("_before"))
    joined = summed.join(ahead, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    passed = F.col("_ahead") + F.col("_before")
    # The document in which the budget ends is taken if that comes nearer to it.
    chosen = (passed < F.col("_rest")) & (2 * (F.col("_rest") - passed) >= F.col("size")) & (F.col("_epochs") < F.lit(cap)) & (F.col("size") > 0)
    epochs = F.when(F.col("size") > 0, F.col("_epochs") + chosen.cast("bigint")).otherwise(F.lit(0)).cast("bigint")
    return joined.select(
        "doc_id", "source", "size", "source_size", "target", epochs.alias("epochs"), (epochs * F.col("size")).alias("taken"), *carry
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Rows are told apart by identifier, source and text, whose hash both sides are joined by; of rows
    equal in all three each gets one of their numbers of times. Null identifiers are as good as others.
    """
    row = F.xxhash64("doc_id", "source", "text")
    same = Window.partitionBy("_row")
    times = mix_counts(docs.withColumn("_row", row), **how, carry=("_row",)).select("_row", "epochs")
    times = times.withColumn("_copy", F.row_number().over(same.orderBy("epochs"))).withColumnRenamed("_row", "_of")
    own = F.struct(*docs.columns).alias("_doc")
    held = docs.select(own, row.alias("_row")).withColumn("_copy", F.row_number().over(same.orderBy("_row"))).withColumnRenamed("_copy", "_held")
    joined = held.join(times, (F.col("_row") == F.col("_of")) & (F.col("_held") == F.col("_copy")))
    repeated = joined.select(F.explode(F.array_repeat("_doc", F.col("epochs").cast("int"))).alias("row"))
    return repeated.select("row.*")
