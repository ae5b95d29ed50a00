"""Hot keys, and joins in which one key may hold a large share of the rows.

Adaptive execution splits a skewed join partition only if both inputs come straight from a
shuffle. A side that was just aggregated on the join key does not, so a hot key would end
in one task. Here the rows of hot keys are spread over salts, and the few rows of those
keys on the reduced side, which has one row per key, are repeated once per salt.

A key is hot by its share of the rows, so one plan serves tables of any size, and building
it runs no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A key with more than this part of the rows is hot.
PARTS = 4096


def key_hash(df: DataFrame, keys: list[str], like: DataFrame | None = None) -> Column:
    """Hash of the keys, NULLs included; `like` gives the types, on which a hash depends."""
    types = (like or df).schema
    return F.xxhash64(*[F.col(k).cast(types[k].dataType) for k in keys])


def hot_table(df: DataFrame, keys: list[str], parts: int = PARTS) -> DataFrame:
    """(_h, _n, _share, _salts): key hashes that hold more than 1/parts of the rows, so fewer than `parts`.

    That bound makes the table safe to broadcast at any size of df. There is one salt per
    1/parts of the rows. The count pass reads the key columns only.
    """
    counts = df.groupBy(key_hash(df, keys).alias("_h")).agg(F.count("*").alias("_n"))
    share = F.col("_n").cast("double") / counts.agg(F.sum("_n")).scalar()
    return counts.where(share * parts > 1).select("_h", "_n", share.alias("_share"), F.ceil(share * parts).cast("int").alias("_salts"))


def with_hot(df: DataFrame, hot: DataFrame, keys: list[str], like: DataFrame | None = None) -> DataFrame:
    """df with _salts, NULL for keys that are not hot."""
    small = F.broadcast(hot.select("_h", "_salts"))
    return df.withColumn("_key_hash", key_hash(df, keys, like)).join(small, F.col("_key_hash") == F.col("_h"), "left").drop(
        "_h", "_key_hash"
    )


def salted_join(large: DataFrame, reduced: DataFrame, keys: list[str], how: str = "inner", parts: int = PARTS) -> DataFrame:
    """Join on keys; how is inner, left, left_semi or left_anti.

    The salt comes from the input partition and the row: a task that runs again sends its
    rows to the same place, and copies of one row still get different salts.
    """
    hot = hot_table(large, keys, parts)
    plain = [f.name for f in large.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    draw = F.pmod(F.xxhash64(F.spark_partition_id(), *plain), F.col("_salts")).cast("int")
    spread = with_hot(large, hot, keys).withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(draw)).drop("_salts")
    each = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    repeated = with_hot(reduced, hot, keys, large).withColumn("_salt", F.explode(each)).drop("_salts")
    return spread.join(repeated, [*keys, "_salt"], how).drop("_salt")
