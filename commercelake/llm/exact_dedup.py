"""Exact dedup by content sort.

Sampled splitters cut the order of the normalised texts into ranges, Spark's window sorts each
range externally, so that equal texts are adjacent, and every row is compared in full with its
neighbour. The splitters include the identifier: a text that many rows share is cut into
several ranges, whose runs are merged afterwards as small rows without texts.

Null texts count as empty. Rows without an identifier take part and are kept only if no row
of the group has one. A repeated row is a copy; all rows with the kept identifier stay.
Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercelake.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPLITTERS_PER_RANGE = 20
PREFIX = 64


def normalised(text: Column) -> Column:
    """A-Z as a-z, null as empty; every other character stays."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def _sort_key(norm: Column, doc_id: Column) -> Column:
    """Leading characters, then hash and identifier: a total order with short keys."""
    number = F.lpad(F.hex(F.coalesce(doc_id.cast("bigint"), F.lit(0))), 16, "0")
    return F.concat(F.substring(norm, 1, PREFIX), F.lit("\x00"), F.lpad(F.hex(F.xxhash64(norm)), 16, "0"), number)


def _splitters(keyed: DataFrame, rows: int, ranges: int) -> list[str]:
    """At most `ranges` - 1 keys, from a sample of at most about SPLITTERS_PER_RANGE per range."""
    if ranges <= 1 or not rows:
        return []
    share = min(1.0, SPLITTERS_PER_RANGE * ranges / rows)
    found = sorted(r[0] for r in keyed.select("_key").sample(share, seed=1).collect())
    return sorted({found[i * len(found) // ranges] for i in range(1, ranges)}) if found else []


def _position(key: Column, cuts: list[str]) -> Column:
    """How many cuts are not above the key, in two steps of about sqrt(n) comparisons."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    coarse = F.array(*[F.lit(c) for c in cuts[step - 1 :: step]])
    passed = F.size(F.filter(coarse, lambda c: c <= key)) * step
    rest = F.slice(F.array(*[F.lit(c) for c in cuts]), passed + 1, F.lit(step))
    return passed + F.size(F.filter(rest, lambda c: c <= key))


def sorted_runs(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, range, run and text_sha256 of every row; rows of a run have equal texts."""
    spark = docs.sparkSession
    ranges = ranges or 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", normalised(F.col("text")).alias("_norm"))
    keyed = rows.withColumn("_key", _sort_key(F.col("_norm"), F.col("doc_id")))
    cuts = _splitters(keyed, docs.select("doc_id").count(), ranges)
    placed = keyed.select("doc_id", "_norm", _position(F.col("_key"), cuts).alias("range"))
    order = Window.partitionBy("range").orderBy("_norm", "doc_id")
    opens = F.coalesce(F.lag("_norm").over(order) != F.col("_norm"), F.lit(True))
    marked = placed.select("range", "doc_id", "_norm", opens.cast("int").alias("_opens"))
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return marked.select(
        "doc_id", "range", F.sum("_opens").over(running).alias("run"), F.sha2(F.col("_norm"), 256).alias("text_sha256")
    )


def exact_dedup(docs: DataFrame, keep: str = "smallest", ranges: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; keep: smallest | largest."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = cut_lineage(sorted_runs(docs, ranges))
    runs = rows.groupBy("range", "run").agg(
        best("doc_id").alias("_keep"), F.count("*").alias("_n"), F.first("text_sha256").alias("_sha")
    )
    runs = cut_lineage(runs)
    # A text has one run in each range it fills; equal runs of different ranges meet here.
    groups = runs.groupBy("_sha").agg(best("_keep").alias("keep_id"), F.sum("_n").alias("group_size"))
    named = runs.select("range", "run", "_sha").join(groups, "_sha")
    return rows.join(named, ["range", "run"]).select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def keep_one(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of docs that stay, all columns: those of a group's kept identifier that have its text."""
    found = exact_dedup(docs, keep).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    same = docs["doc_id"].eqNullSafe(found["_id"]) & (F.sha2(normalised(docs["text"]), 256) == found["_sha"])
    return docs.join(found, same, "left_semi")
