"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

Whole windows are cut off long documents first. What is left, in pieces of at most `piece`
tokens, goes into batches of about `batch` pieces. In a batch every piece begins as a partial
partition into k windows; the two with the largest imbalance are merged, the fullest windows
of one with the emptiest of the other, until one partition with near-equal windows remains.
k starts from the batch's total and rises while a window exceeds the capacity.

Null texts are empty documents, of one end token. Rows that share an identifier or repeat are
packed one by one, told apart by `copy`. Empty tables give an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commercelake.llm.tokens import encoder, with_end
from commercelake.session import cut_lineage

CAPACITY = 4096
PIECE = 1024
BATCH = 600


def karmarkar_karp(sizes: list[int], k: int) -> list[list[int]]:
    """k lists of indices with near-equal sums."""
    heap = []
    for i, s in enumerate(sizes):
        # Sums in descending order; a tuple of nested pairs holds the members of each window.
        heap.append((-s, i, [(s, (i, None))]))
    heapq.heapify(heap)
    serial = len(sizes)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heapq.heappop(heap)
        # Only windows with something in them are held; the rest are empty, up to k.
        short = k - len(a)
        if len(b) <= short:
            merged = a + b
        else:
            merged = a[: k - len(b)] if len(b) < k else []
            paired = a[len(merged) :]
            rest = b[: k - len(a)]
            tail = b[len(rest) :]
            merged = merged + rest + [(x[0] + y[0], (x[1], y[1])) for x, y in zip(paired, reversed(tail), strict=True)]
        merged.sort(key=lambda w: -w[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (-(merged[0][0] - least), serial, merged))
        serial += 1
    windows = heap[0][2] if heap else []
    return [_members(w[1]) for w in windows] + [[] for _ in range(k - len(windows))]


def _members(node) -> list[int]:
    out, stack = [], [node]
    while stack:
        x = stack.pop()
        if x is None:
            continue
        if isinstance(x, int):
            out.append(x)
        else:
            stack.extend(x)
    return sorted(out)


def pack(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most capacity; k rises until the partition fits. No size exceeds it."""
    k = max(1, -(-sum(sizes) // capacity)) if sizes else 0
    while k:
        windows = karmarkar_karp(sizes, k)
        if max(sum(sizes[i] for i in w) for w in windows) <= capacity:
            return [w for w in windows if w]
        k += 1
    return []


def pieces_of(total: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Lengths of a document's pieces: whole windows, then parts of at most `piece`."""
    whole, rest = divmod(total, capacity)
    parts = -(-rest // piece)
    return [capacity] * whole + [rest // parts + (i < rest % parts) for i in range(parts)]


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """doc_id, copy, start, length, ids_crc32 and doc_tokens of each piece, without the ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(tokenizer)
        for b in batches:
            ids, offsets = with_end(*known.encode(b.column(2)), end_id)
            row, start, length, crc = [], [], [], []
            view = memoryview(ids.astype("<u4", copy=False)).cast("B")
            for i in range(b.num_rows):
                at, total = int(offsets[i]), int(offsets[i + 1] - offsets[i])
                done = 0
                for n in pieces_of(total, capacity, piece):
                    row.append(i)
                    start.append(done)
                    length.append(n)
                    crc.append(zlib.crc32(view[4 * (at + done) : 4 * (at + done + n)]))
                    done += n
            row = np.array(row, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(row)),
                    b.column(1).take(pa.array(row)),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.diff(offsets)[row]),
                ],
                names=["doc_id", "copy", "start", "length", "ids_crc32", "doc_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select("doc_id", F.monotonically_increasing_id().alias("copy"), F.col("text").cast("string"))
    return numbered.mapInArrow(cut, f"doc_id {kind}, copy bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def packed(docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = CAPACITY, piece: int = PIECE, batch: int = BATCH) -> DataFrame:
    """Each piece with its sequence_id and offset in the sequence."""
    pieces = cut_lineage(cut_pieces(docs, tokenizer, end_id, capacity, piece))
    loose = pieces.where(F.col("length") < capacity)
    batches = max(1, -(-loose.count() // batch))
    # Pieces are told apart by hash, not by place, so a batch is the same after a task is lost.
    loose = loose.withColumn("_batch", F.pmod(F.xxhash64("copy", "start"), F.lit(batches)))

    def fill(batches_of: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _runs(batches_of, "_batch"):
            order = table.sort_by([("length", "descending"), ("copy", "ascending"), ("start", "ascending")])
            sizes = order.column("length").to_pylist()
            window, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
            for w, members in enumerate(pack(sizes, capacity)):
                done = 0
                for i in members:
                    window[i], offset[i] = w, done
                    done += sizes[i]
            order = order.append_column("_window", pa.array(window)).append_column("offset", pa.array(offset))
            yield from order.combine_chunks().to_batches()

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = f"doc_id {kind}, copy bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    filled = (
        loose.repartition("_batch")
        .sortWithinPartitions("_batch")
        .mapInArrow(fill, f"{columns}, _batch bigint, _window bigint, offset bigint")
    )
    filled = cut_lineage(filled)
    whole = pieces.where(F.col("length") == capacity)
    per_batch = filled.groupBy("_batch").agg((F.max("_window") + 1).alias("_windows"))
    before = Window.orderBy("_batch").rowsBetween(Window.unboundedPreceding, -1)
    first = per_batch.select(F.col("_batch").alias("_b"), F.coalesce(F.sum("_windows").over(before), F.lit(0)).alias("_first"))
    named = filled.join(first, F.col("_batch") == F.col("_b")).select(
        *pieces.columns, (2 * (F.col("_first") + F.col("_window"))).alias("sequence_id"), "offset"
    )
    # A full piece is a sequence of its own, with an odd number by its place in the written table.
    place = 2 * F.monotonically_increasing_id() + 1
    alone = whole.select(*pieces.columns, place.alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    return named.unionByName(alone)


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal key from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        keys = b.column(key).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            part = b.slice(a, z - a)
            if held and held[-1].column(key)[-1].as_py() != part.column(key)[0].as_py():
                yield pa.Table.from_batches(held)
                held = []
            if z > a:
                held.append(part)
    if held:
        yield pa.Table.from_batches(held)
