"""Running totals and numbering that survive one hot key.

A plain window puts every row of a key into one task. Here the rows of large keys are
first cut into ranges of the order columns with about equal row counts. Ranges are summed
up separately, the small table of range totals is carried forward, and the totals are
added to windows that never span more than one range. Building the plan runs no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercelake.operators.skew import PARTS, hot_table, key_hash, salted_join

#: Rows looked at per range when cut points are chosen.
SAMPLE = 50


def with_range(
    df: DataFrame, order: list[str], ranges: int, name: str = "_range", where: str | None = None, draw: list[str] | None = None
) -> DataFrame:
    """Add the number of the range a row falls in, ascending in the order columns (any
    orderable types). With `where`, a BOOLEAN column, only such rows are cut; others get 0.

    Cut points are a scalar subquery over the rows with the least hashes, SAMPLE per range:
    a sample that depends on the values alone, so a task that is run again after an
    executor is lost puts its rows into the same ranges. It only sets where ranges end;
    every row falls in one of them. `draw` names the columns that are hashed; with all those of an
    aggregate, its shuffle serves the sample too.
    """
    if ranges <= 1:
        return df.withColumn(name, F.lit(0))
    # One column alone is compared as it is, which takes half the time; its NULLs stay in the first range.
    row = F.struct(*order) if len(order) > 1 else F.col(order[0])
    chosen = (df.where(where) if where else df).select(row.alias("c"), F.xxhash64(*(draw or order)).alias("h"))
    sample = chosen.orderBy("h", "c").limit(SAMPLE * ranges).agg(F.array_sort(F.collect_list("c")).alias("a"))
    every = F.greatest(F.lit(1), F.ceil(F.size("a") / ranges))
    cuts = sample.select(F.array_distinct(F.filter("a", lambda c, i: (i + 1) % every == 0)).alias("cuts"))
    found = df.withColumn("_cuts", _stepped(cuts).select(F.struct("step", "cuts", "coarse")).scalar())
    index = _place(row)
    return found.withColumn(name, F.when(F.col(where), index).otherwise(0) if where else index).drop("_cuts")


def _stepped(cuts: DataFrame) -> DataFrame:
    """cuts, an array in order, with step and coarse: every step-th of it, so that two short looks find a place."""
    cuts = cuts.withColumn("step", F.greatest(F.lit(1), F.sqrt(F.size("cuts")).cast("int")))
    return cuts.withColumn("coarse", F.filter("cuts", lambda c, i: (i + 1) % F.col("step") == 0))


def _place(row: Column) -> Column:
    """The number of cuts in _cuts below a row: about twice the square root of their number of comparisons."""

    def below(some: Column) -> Column:
        return F.size(F.filter(some, lambda c: c < row))

    passed = below(F.col("_cuts.coarse")) * F.col("_cuts.step")
    return passed + below(F.slice(F.col("_cuts.cuts"), passed + 1, F.col("_cuts.step")))


def _hot_cuts(df: DataFrame, keys: list[str], order: list[str], parts: int, ranges: int) -> DataFrame:
    """(_h, _cuts) of each hot key: where its rows are cut, into as many of `ranges` as its share of the rows.

    All cuts together are fewer than ranges + parts, a bound that lets every task have them. Rows
    are drawn by hash, SAMPLE a range, so the cuts depend on the values alone. Without a hot key
    adaptive execution leaves this out, and the pass over df with it.
    """
    hot = hot_table(df, keys, parts).select("_h", "_n", F.ceil(F.col("_share") * ranges).cast("int").alias("_ranges"))
    row = F.struct(*order)
    drawn = df.select(key_hash(df, keys).alias("_key_hash"), row.alias("_c"), F.pmod(F.xxhash64(*order), F.lit(1 << 40)).alias("_draw"))
    drawn = drawn.join(F.broadcast(hot), F.col("_key_hash") == F.col("_h"))
    drawn = drawn.where(F.col("_draw") < F.lit(float(SAMPLE << 40)) * F.col("_ranges") / F.col("_n"))
    sample = drawn.groupBy("_h", "_ranges").agg(F.sort_array(F.collect_list("_c")).alias("_s"))
    every = F.greatest(F.lit(1), F.ceil(F.size("_s") / F.col("_ranges")))
    cuts = sample.select("_h", F.array_distinct(F.filter("_s", lambda c, i: (i + 1) % every == 0)).alias("cuts"))
    return _stepped(cuts).select("_h", F.struct("step", "cuts", "coarse").alias("_cuts"))


_WHOLE = {"sum": F.sum, "max": F.max, "count": F.count}
_MERGE = {"sum": F.sum, "max": F.max, "count": F.sum}


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, tuple[str, Column]],
    ranges: int | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add running aggregates over (keys, order), the current row included.

    totals maps a new column to ("sum" | "max" | "count", value). The order must be total,
    so that ties cannot change a result. There are about twice as many ranges as shuffle partitions.
    Only the rows of keys with more than 1/parts of all rows are cut, parts being as many as ranges
    and PARTS at most; without keys all rows are. `ranges` cuts all rows into that many. Where no key is
    hot, what is left of the plan at run time is one pass that counts the keys, and a plain window.
    """
    few = ranges is None or not keys
    tasks = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if ranges is None and keys:
        cuts = F.broadcast(_hot_cuts(df, keys, order, parts or min(tasks, PARTS), tasks))
        hashed = df.withColumn("_key_hash", key_hash(df, keys))
        index = _place(F.struct(*order))
        cut = hashed.join(cuts, F.col("_key_hash") == F.col("_h"), "left")
        cut = cut.withColumn("_range", F.when(F.col("_cuts").isNull(), 0).otherwise(index)).select(*df.columns, "_range")
        hot_rows = hashed.join(cuts, F.col("_key_hash") == F.col("_h")).withColumn("_range", index)
    else:
        cut = hot_rows = with_range(df, order, ranges or tasks)

    within = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = cut.select("*", *[_WHOLE[fn](v).over(within).alias(f"_in_{n}") for n, (fn, v) in totals.items()])

    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = (
        hot_rows.groupBy(*keys, "_range").agg(*[_WHOLE[fn](v).alias(n) for n, (fn, v) in totals.items()])
    )
    carried = per_range.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_range").alias("_k_range"),
        *[_MERGE[fn](n).over(before).alias(f"_before_{n}") for n, (fn, _) in totals.items()],
    )
    same = F.col("_range") == F.col("_k_range")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))

    def combined(name: str, fn: str) -> Column:
        inside, ahead = F.col(f"_in_{name}"), F.col(f"_before_{name}")
        if fn == "max":
            return F.greatest(inside, ahead).alias(name)
        return F.when(ahead.isNull(), inside).when(inside.isNull(), ahead).otherwise(inside + ahead).alias(name)

    # A row for each range: of hot keys fewer than tasks + parts, without keys as many as ranges.
    return rows.join(F.broadcast(carried) if few else carried, same, "left").select(
        *df.columns, *[combined(n, fn) for n, (fn, _) in totals.items()]
    )


def numbered(
    df: DataFrame, order: list[str], keys: list[str] | None = None, name: str = "position", ranges: int | None = None
) -> DataFrame:
    """Exact 1, 2, 3, ... in a total order, without gathering the rows in one task."""
    return running(df, keys or [], order, {name: ("count", F.lit(1))}, ranges)


def dense_rank_by(df: DataFrame, measure: str, name: str = "rank") -> DataFrame:
    """Dense rank, highest first, over all rows.

    Only the distinct values of the measure are ranked in one place. For counts that sum
    to N there are at most about sqrt(2 N) of them.
    """
    ranks = df.select(measure).distinct().withColumn(name, F.dense_rank().over(Window.orderBy(F.desc(measure))).cast("bigint"))
    return salted_join(df, ranks, [measure])
