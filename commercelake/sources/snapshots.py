"""Versioned tables: upsert, checkpoints, append-once and append-only logs.

A new state is a new folder or partition that belongs to one run, and a run that is repeated
replaces its own, so a job run again after a failure neither mixes nor doubles rows.
"""

from __future__ import annotations

from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commercelake.sources.tables import load_or_empty


def upsert(existing: DataFrame, incoming: DataFrame, key: str, version: str) -> DataFrame:
    """Insert or replace per key; the highest version wins.

    An aggregate rather than a window: versions of a key are reduced before the shuffle.
    """
    rows = existing.unionByName(incoming)
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), version).alias("_row"))
    return last.select("_row.*")


def write_version(df: DataFrame, root: str, version: int) -> None:
    df.write.mode("error").parquet(f"{root}/version={version}")


def read_latest(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Newest version, by the listing; only its folder is opened."""
    last = held_partitions(spark, root, "version").agg(F.max(F.col("version").cast("bigint"))).first()[0]
    return load_or_empty(spark, f"{root}/version={last}", schema)


def _folder(path: str, name: str, value: str) -> str:
    return f"{path}/{name}={quote(value, safe='')}"


def checkpoint(df: DataFrame, path: str, checkpoint_id: str) -> None:
    """Keep a copy of a table under an id; the same id again replaces it.

    The id is put on record once the copy is complete, so a copy of no rows is one too.
    """
    df.write.mode("overwrite").parquet(_folder(f"{path}/tables", "checkpoint_id", checkpoint_id))
    kept = df.sparkSession.createDataFrame([(checkpoint_id,)], "kept STRING")
    kept.write.mode("overwrite").parquet(_folder(f"{path}/ids", "checkpoint_id", checkpoint_id))


def restore(spark: SparkSession, path: str, checkpoint_id: str, schema: str) -> DataFrame:
    """The table as kept under an id; an unknown id is an error. Reads that copy only."""
    if load_or_empty(spark, _folder(f"{path}/ids", "checkpoint_id", checkpoint_id), "kept STRING").isEmpty():
        raise LookupError(f"checkpoint not found: {checkpoint_id}")
    return spark.read.schema(schema).parquet(_folder(f"{path}/tables", "checkpoint_id", checkpoint_id))


_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


def held_partitions(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(column STRING): values of a partition column, from the file listing; no file is opened."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return spark.createDataFrame([], f"{column} STRING")
    name = F.replace(F.regexp_extract("path", f"/{column}=([^/]+)/", 1), F.lit("+"), F.lit("%2B"))
    return files.select(F.url_decode(name).alias(column)).distinct()


def append_once(batch: DataFrame, path: str) -> None:
    """Append the run dates of a batch that the target does not hold yet."""
    held = held_partitions(batch.sparkSession, path, "run_date").withColumnRenamed("run_date", "_held")
    date = F.coalesce(batch["run_date"].cast("string"), F.lit(_NULL_PARTITION))
    fresh = batch.join(held, date == held["_held"], "left_anti")
    fresh.write.mode("append").partitionBy("run_date").parquet(path)


def append_log(rows: DataFrame, path: str, batch: str) -> None:
    """Event log, one folder per batch and log. A batch that is written again replaces itself."""
    rows.write.mode("overwrite").partitionBy("log").parquet(_folder(path, "batch", batch))


# --- tagged JSON ------------------------------------------------------------------
# The tags "__decimal__" and "__dict__" of the saved format.


def encode_tagged(fields: dict[str, Column], decimals: set[str] = frozenset()) -> Column:
    """A record as {"__dict__": [[name, value], ...]}, decimals as {"__decimal__": "1.00"}."""
    pairs = []
    for name, value in fields.items():
        if name in decimals:
            tagged = F.to_json(F.struct(value.cast("string").alias("__decimal__")))
            pairs.append(F.concat(F.lit(f'["{name}",'), tagged, F.lit("]")))
        else:
            one = F.to_json(F.array(value))
            pairs.append(F.concat(F.lit(f'["{name}",'), F.substr(one, F.lit(2))))
    return F.concat(F.lit('{"__dict__":['), F.concat_ws(",", *pairs), F.lit("]}"))


def decode_tagged(payload: Column, types: dict[str, str]) -> Column:
    """Back to a struct with the given field types."""
    parsed = F.from_json(payload, "__dict__ array<array<string>>")
    fields = F.map_from_entries(F.transform(parsed["__dict__"], lambda p: F.struct(p[0], p[1])))

    def read(name: str, kind: str) -> Column:
        text = F.element_at(fields, name)
        if kind.startswith("decimal"):
            text = F.get_json_object(text, "$.__decimal__")
        return text.cast(kind).alias(name)

    return F.struct(*[read(name, kind) for name, kind in types.items()])
