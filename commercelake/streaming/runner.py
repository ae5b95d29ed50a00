"""Running a stream over what is there now, into a table others can read.

Each micro-batch writes its own folder and overwrites it when the batch is replayed, so a
restart after a failure neither loses nor repeats rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commercelake.session import discard_at_exit, shared_path
from commercelake.sources.entities import Entities
from commercelake.sources.tables import SCHEMAS, load_or_empty

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class StreamEntities(Entities):
    """The entity views over a stream of events."""

    def __init__(self, spark: SparkSession, folder: str, files_per_batch: int | None = None, bytes_per_batch: int = 2**30):
        super().__init__(spark, folder)
        self.files_per_batch, self.bytes_per_batch = files_per_batch, bytes_per_batch

    def __getattr__(self, name: str) -> DataFrame:
        if name != "events":
            return super().__getattr__(name)
        reader = self.spark.readStream.schema(SCHEMAS[name])
        # A batch is bounded, and with it what one key can bring to a task at a time.
        if self.files_per_batch:
            reader = reader.option("maxFilesPerTrigger", self.files_per_batch)
        else:
            reader = reader.option("maxBytesPerTrigger", self.bytes_per_batch)
        # A glob lets the table be one file or a folder of files.
        return reader.parquet(f"{self.folder}/{name}.parque[t]")


def _run(stream: DataFrame, mode: str, table: str | None) -> DataFrame:
    spark = stream.sparkSession
    kept, table = table is not None, table or shared_path(spark, "stream")
    out = f"{table}/rows"
    # The number of state partitions is that of the first run and stays with the state.
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    running = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", f"{table}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    if not kept:
        discard_at_exit(spark, table)
    return load_or_empty(spark, out, f"{_columns(stream)}, batch BIGINT")


def _columns(stream: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)


def appended(stream: DataFrame, table: str | None = None) -> DataFrame:
    """All rows the stream has emitted.

    table is a folder in shared storage that holds rows and state; a later run with the same
    folder goes on where the last one ended. Without it the run starts afresh, and its folder
    goes when the application ends.
    """
    return _run(stream, "append", table).drop("batch")


def updated(stream: DataFrame, keys: list[str], table: str | None = None) -> DataFrame:
    """The last version of each key the stream has emitted; table as for appended.

    In a table that is kept, each run ends with the last versions under `last`, so the next
    one reads these and its own batches, not every version there ever was.
    """
    spark, kept = stream.sparkSession, table is not None
    rows = _run(stream, "update", table)
    if kept:
        held = load_or_empty(spark, f"{table}/last", _columns(stream) + ", batch BIGINT, through BIGINT")
        through = held.agg(F.max("through")).first()[0]
        if through is not None:
            rows = rows.where(F.col("batch") > through).unionByName(held.where(F.col("through") == through).drop("through"))
    values = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_last"), F.max("batch").alias("batch"))
    last = last.select(*keys, "_last.*", "batch")
    newest = rows.agg(F.max("batch")).first()[0] if kept else None
    if newest is not None and newest != through:
        path = f"{table}/last/through={newest}"
        last.write.mode("overwrite").parquet(path)
        last = spark.read.schema(last.schema).parquet(path)
    return last.select(*keys, *values)
