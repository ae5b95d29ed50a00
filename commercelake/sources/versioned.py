"""Tables kept as versions, of which each write holds its changes only.

`root/rows/kind=delta/version=N` holds the rows that version N puts in place of those of equal key, or
takes out; `root/rows/kind=base/version=N` holds the whole table as of version N, one row a key. A read
opens the newest base and the deltas after it, which the listing of `root/done` names: an entry is
made there once a folder is complete, so a run that failed half-way is not seen, and repeated, it
replaces its own folder. After `every` deltas the next write makes a new base first; older ones stay for reads
of older versions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commercelake.sources.snapshots import held_partitions

#: Deltas a read meets at most, unless a write asks for another number.
EVERY = 16


def _entry(kind: str, version: int) -> str:
    return f"{kind}-{version:012d}"


def _put(rows: DataFrame, root: str, kind: str, version: int) -> None:
    rows.write.mode("overwrite").parquet(f"{root}/rows/kind={kind}/version={version}")
    done = rows.sparkSession.createDataFrame([(version,)], "version BIGINT")
    done.write.mode("overwrite").parquet(f"{root}/done/entry={_entry(kind, version)}")


def held(spark: SparkSession, root: str, upto: int | None = None) -> tuple[int | None, list[int]]:
    """The newest base not above `upto`, and the deltas between it and `upto`, from the listing."""
    kind, number = F.substring_index("entry", "-", 1), F.substring_index("entry", "-", -1).cast("bigint")
    entries = held_partitions(spark, f"{root}/done", "entry").select(kind.alias("kind"), number.alias("version"))
    if upto is not None:
        entries = entries.where(F.col("version") <= upto)
    base = entries.where("kind = 'base'").agg(F.max("version")).first()[0]
    later = entries.where("kind = 'delta'")
    later = later if base is None else later.where(F.col("version") > base)
    return base, sorted(r["version"] for r in later.collect())


def newest(spark: SparkSession, root: str) -> int | None:
    base, deltas = held(spark, root)
    return deltas[-1] if deltas else base


def write_changes(rows: DataFrame, root: str, version: int, key: str, removed: DataFrame | None = None, every: int = EVERY) -> None:
    """Put a version: rows (one a key) take the place of those of equal key, keys of removed go.

    The write is as large as the change. Version numbers must rise; the newest may be written again
    until it is part of a base.
    """
    spark = rows.sparkSession
    base, deltas = held(spark, root)
    if version <= (base if base is not None else version - 1) or deltas and version < deltas[-1]:
        raise ValueError(f"version {version} is older than {max([*deltas, base or 0])}, or part of a base")
    if len(deltas) >= every and version > deltas[-1]:
        compact(spark, root, rows.schema, key)
    changes = rows.withColumn("_removed", F.lit(False))
    if removed is not None:
        changes = changes.unionByName(removed.select(key).withColumn("_removed", F.lit(True)), allowMissingColumns=True)
    _put(changes, root, "delta", version)


def compact(spark: SparkSession, root: str, schema, key: str) -> None:
    """Write the newest version as a base; later reads open nothing before it."""
    version = newest(spark, root)
    if version is not None and held(spark, root)[1]:
        _put(read_version(spark, root, schema, key), root, "base", version)


def read_version(spark: SparkSession, root: str, schema, key: str, version: int | None = None) -> DataFrame:
    """The table as of a version, the newest by default; a table never written is empty.

    Rows of the base meet the keys of the deltas only, and are not shuffled where those are few.
    """
    base, deltas = held(spark, root, version)
    empty = spark.createDataFrame([], schema)
    table = empty if base is None else spark.read.schema(empty.schema).parquet(f"{root}/rows/kind=base/version={base}")
    if not deltas:
        return table
    full = empty.withColumns({"_removed": F.lit(False), "_version": F.lit(0).cast("bigint")}).schema
    parts = [
        spark.read.schema(full).parquet(f"{root}/rows/kind=delta/version={v}").withColumn("_version", F.lit(v).cast("bigint")) for v in deltas
    ]
    rows = reduce(DataFrame.unionByName, parts)
    if len(deltas) > 1:
        rows = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), "_version").alias("_row")).select("_row.*")
    stale = rows.select(F.col(key).alias("_key"))
    kept = table.join(stale, F.col(key).eqNullSafe(F.col("_key")), "left_anti")
    return kept.unionByName(rows.where("NOT _removed").select(*table.columns))
