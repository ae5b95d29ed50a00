"""Token-id shards with a minimal perfect hash index.

Documents are range-partitioned by identifier, encoded, and written as shards: a directory of
identifiers and offsets in ascending order, the raw ids (two bytes each while they fit), and an
index from identifier to record. The index is a minimal perfect hash: on each level a key takes
the bit its hash names if no other key wants it, else it goes on to the next level; the rank of
its bit is its slot. A slot holds a fingerprint, so that foreign keys are refused, and the record.
Shards are rows of a Parquet table that Spark writes, so a lost task's output never shows.

Null texts are empty documents of one end token. Null identifiers come first and are found by
place only. Rows that share an identifier are neighbours, in the order of their texts' hashes;
a lookup gives the first in its shard. Empty tables give an empty index; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from commercelake.llm.tokens import encoder, with_end
from commercelake.llm.words import mix

SHARD_IDS = 1 << 20
GAMMA = 1.5
SCHEMA = "part int, shard int, n_docs bigint, n_tokens bigint, width int, nulls bigint, keys binary, offsets binary, levels binary, bits binary, slots binary, payload binary"


def _at_level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    seed = np.uint64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))
    return (mix(keys + seed) % np.uint64(size)).astype(np.int64)


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xD6E8FEB86659FD93)) & np.uint64(0xFFFF)).astype(np.uint32)


def build_index(keys: np.ndarray, records: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level sizes, bits of all levels, and per slot (fingerprint, record), for distinct keys."""
    sizes, bits, rest = [], [], keys
    while len(rest):
        size = max(8, int(GAMMA * len(rest)) + 1)
        at = _at_level(rest, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        rest = rest[~alone[at]]
    levels, flat = np.array(sizes, np.int64), np.concatenate(bits) if bits else np.zeros(0, bool)
    slots = np.zeros((len(keys), 2), np.uint32)
    found = find_slots(keys, levels, flat, np.cumsum(flat))
    slots[found, 0], slots[found, 1] = _fingerprint(keys), records
    return levels, flat, slots


def find_slots(keys: np.ndarray, levels: np.ndarray, flat: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit; a foreign key may get a slot."""
    slot = np.full(len(keys), -1, np.int64)
    base = 0
    open_ = np.arange(len(keys))
    for level, size in enumerate(levels.tolist()):
        if not len(open_):
            break
        at = base + _at_level(keys[open_], level, size)
        hit = flat[at]
        slot[open_[hit]] = rank[at[hit]] - 1
        open_ = open_[~hit]
        base += size
    return slot


@dataclass
class Shard:
    """One shard in memory, with access by identifier and by record."""

    keys: np.ndarray
    nulls: int
    offsets: np.ndarray
    payload: np.ndarray
    levels: np.ndarray
    bits: np.ndarray
    slots: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Shard:
        levels = np.frombuffer(row["levels"], np.int64)
        return cls(
            np.frombuffer(row["keys"], np.int64),
            row["nulls"],
            np.frombuffer(row["offsets"], np.int64),
            np.frombuffer(row["payload"], "<u2" if row["width"] == 2 else "<u4"),
            levels,
            np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=int(levels.sum())).astype(bool),
            np.frombuffer(row["slots"], np.uint32).reshape(-1, 2),
        )

    def __post_init__(self) -> None:
        self._rank = np.cumsum(self.bits)

    def records(self, keys: np.ndarray) -> np.ndarray:
        """Record of each identifier, -1 where the fingerprint refuses it."""
        if not len(self.slots):
            return np.full(len(keys), -1, np.int64)
        asked = keys.astype(np.int64).view(np.uint64)
        slot = find_slots(asked, self.levels, self.bits, self._rank)
        known = (slot >= 0) & (self.slots[slot, 0] == _fingerprint(asked))
        return np.where(known, self.slots[slot, 1].astype(np.int64), -1)

    def ids(self, record: int) -> np.ndarray:
        return self.payload[self.offsets[record] : self.offsets[record + 1]]

    def get(self, key: int) -> np.ndarray | None:
        record = int(self.records(np.array([key], np.int64))[0])
        return None if record < 0 else self.ids(record)


def _shard(part: int, number: int, keys: np.ndarray, nulls: int, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    own = keys[nulls:]
    distinct, first = np.unique(own, return_index=True)
    levels, bits, slots = build_index(distinct.view(np.uint64), (first + nulls).astype(np.uint32))
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    row = {
        "part": pa.array([part], pa.int32()),
        "shard": pa.array([number], pa.int32()),
        "n_docs": pa.array([len(keys)], pa.int64()),
        "n_tokens": pa.array([len(ids)], pa.int64()),
        "width": pa.array([width], pa.int32()),
        "nulls": pa.array([nulls], pa.int64()),
    }
    blobs = (keys, offsets, levels, np.packbits(bits), slots, ids.astype("<u2" if width == 2 else "<u4"))
    row |= {n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("keys", "offsets", "levels", "bits", "slots", "payload"), blobs, strict=True)}
    return pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def write_index(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, shard_ids: int = SHARD_IDS, parts: int | None = None) -> None:
    """Encode every document and write the shards to path, in ascending order of identifiers."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, number = encoder(tokenizer), TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            keys, ids, lengths = (np.concatenate([h[i] for h in held]) for i in (0, 2, 3))
            return _shard(part, number, keys, sum(h[1] for h in held), ids, lengths)

        for b in batches:
            keys = b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            null = np.asarray(b.column(0).is_null())
            ids, offsets = with_end(*known.encode(b.column(1)), end_id)
            first = 0
            while first < len(keys):
                room = shard_ids - sum(len(h[2]) for h in held)
                last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + room, side="right")) - 1)
                held.append((keys[first:last], int(null[first:last].sum()), ids[offsets[first] : offsets[last]], np.diff(offsets[first : last + 1])))
                first = last
                if first < len(keys):
                    yield flush()
                    held, number = [], number + 1
        if held:
            yield flush()

    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"), F.xxhash64("text").alias("_h"))
    # The hash cuts an identifier that many rows share; equal ones stay neighbours.
    placed = rows.repartitionByRange(parts, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    placed.select("doc_id", "text").mapInArrow(write, SCHEMA).write.parquet(path)


def records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every record, read from the shards.

    Identifiers go through the index; repeated ones and nulls, which it cannot tell apart,
    are read by place.
    """
    shards = spark.read.schema(SCHEMA).parquet(path)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s = Shard.of(row)
                place = np.arange(len(s.keys))
                found = s.records(s.keys)
                found[: s.nulls] = place[: s.nulls]
                again = np.concatenate([[False], s.keys[1:] == s.keys[:-1]]) if len(place) else np.zeros(0, bool)
                found = np.where(again, place, found)
                crc = [zlib.crc32(s.ids(int(r)).astype("<u4").tobytes()) for r in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(place), row["part"]), pa.int32()),
                        pa.array(np.full(len(place), row["shard"]), pa.int32()),
                        pa.array(s.keys, pa.int64(), mask=place < s.nulls),
                        pa.array(s.offsets[found], pa.int64()),
                        pa.array(s.offsets[found + 1] - s.offsets[found], pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    names=["part", "shard", "doc_id", "_at", "n_tokens", "ids_crc32"],
                )

    rows = shards.mapInArrow(read, "part int, shard int, doc_id bigint, _at bigint, n_tokens bigint, ids_crc32 bigint")
    before = Window.orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.select("part", "shard", "n_tokens")
    first = totals.select("part", "shard", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("_first"))
    return rows.join(first, ["part", "shard"]).select("doc_id", (F.col("_first") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """doc_id and ids of the asked identifiers that the index has; keys are read once per shard range."""
    shards = spark.read.schema(SCHEMA).parquet(path)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                k = np.frombuffer(row["keys"], np.int64)[row["nulls"] :]
                if len(k):
                    yield pa.RecordBatch.from_pydict({"part": pa.array([row["part"]], pa.int32()), "shard": pa.array([row["shard"]], pa.int32()), "low": [int(k[0])], "high": [int(k[-1])]})

    ranges = shards.select("part", "shard", "nulls", "keys").mapInArrow(bounds, "part int, shard int, low bigint, high bigint")
    asked = keys.select(F.col("doc_id").cast("bigint").alias("_k")).where("_k is not null").distinct()
    per_shard = asked.join(ranges, F.col("_k").between(F.col("low"), F.col("high"))).groupBy("part", "shard").agg(F.collect_list("_k").alias("_asked"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                s, want = Shard.of(row), np.array(row["_asked"], np.int64)
                at = s.records(want)
                true = [(int(k), s.ids(int(r)).astype(np.int64).tolist()) for k, r in zip(want, at, strict=True) if r >= 0 and s.keys[r] == k]
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in true], pa.int64()), pa.array([i for _, i in true], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return shards.join(per_shard, ["part", "shard"]).mapInArrow(fetch, "doc_id bigint, ids array<bigint>")
