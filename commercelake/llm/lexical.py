"""Ranked lexical search: the best documents of each item by presence masks.

The documents are scored for all items of a block at once. A task keeps the documents of a batch as
a bit matrix, a row of bits per term. The rows of an item's terms, stacked and read across, give
each document's mask: which of the item's terms it holds. Documents of one mask are a group, and the
sum of the highest parts of its terms in the batch bounds the score of all of them. Masks are taken
by descending bound; an item is finished once the next bound is below its k-th best score so far,
which is kept from batch to batch. So all that could reach the result is scored, exactly.

A block is a bounded part of the items (BLOCK_TERMS terms, or one item), and only its terms travel
to the tasks. Per block the texts are read once and become postings of the block's terms, from
which the counts are taken and the documents scored. Each task ends with at most k documents an item.

Documents without terms, null and empty texts are in no count and no result. Repeated document
rows are documents of their own; null identifiers come last among equal scores. Items equal in
identifier and text count once; items without terms give no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commercelake.llm.words import Lanes, chunks, spans_of, text_bytes
from commercelake.session import cut_lineage

#: Distinct terms of all items of a block together.
BLOCK_TERMS = 1 << 16
#: Places of the matrix of documents and terms a task holds at a time.
CELLS = 1 << 22
#: Documents scored before the bound is looked at again.
STEP = 64

# The separators of terms, and what becomes lower case.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_SEPARATOR = np.zeros(256, bool)
for _first, _last in ((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)):
    _SEPARATOR[_first : _last + 1] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32


class Terms:
    """The distinct terms of a block; find() gives the number of each word that is one of them."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self._data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        self._ends = np.cumsum(lengths)
        self._starts = self._ends - lengths
        lanes, self._salt = Lanes(self._data), 0
        while len(np.unique(keys := lanes.hashes(self._starts, self._ends, self._salt))) < len(keys):
            self._salt += 1
        self._order = np.argsort(keys)
        self._keys = keys[self._order]

    def find(self, lanes: Lanes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words that are terms, and their numbers. Bytes are compared, not only hashes."""
        if not len(self._keys) or not len(starts):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        hashes = lanes.hashes(starts, ends, self._salt)
        at = np.minimum(np.searchsorted(self._keys, hashes), len(self._keys) - 1)
        place = np.flatnonzero(self._keys[at] == hashes)
        term = self._order[at[place]]
        length = ends[place] - starts[place]
        place, term, length = (x[length == self._ends[term] - self._starts[term]] for x in (place, term, length))
        same = lanes.same(starts[place], Lanes(self._data), self._starts[term], length)
        return place[same], term[same]


@dataclass
class Block:
    """Some items: per item its identifier, the numbers of its distinct terms and how often each occurs."""

    items: list[tuple[int | None, np.ndarray, np.ndarray]]
    terms: list[str]


def blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[Block]:
    """The items (item_id, text) in blocks of at most `most` terms, or of one item; a block is on the driver at a time."""
    text = F.translate(F.col("text").cast("string"), UPPER, LOWER)
    found = items.select(F.col("item_id").cast("bigint"), F.col("text").cast("string")).dropDuplicates(["item_id", "text"])
    found = found.select("item_id", F.regexp_extract_all(text, F.lit(TERM), F.lit(0)).alias("terms")).where(F.size("terms") > 0)
    own, numbers, size = [], {}, 0

    def ended() -> Block:
        return Block(own, list(numbers))

    for item_id, terms in found.toLocalIterator():
        counts = Counter(terms)
        if own and size + len(counts) > most:
            yield ended()
            own, numbers, size = [], {}, 0
        at = np.array([numbers.setdefault(t, len(numbers)) for t in counts])
        own.append((item_id, at, np.array(list(counts.values()))))
        size += len(counts)
    if own:
        yield ended()


def postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, n (terms of the text with repeats) and, for those of the given terms it holds, number and count."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms)
        for b in batches:
            data, offsets = text_bytes(b.column(1))
            for a, z in chunks(offsets):
                raw, own = _FOLD[data[offsets[a] : offsets[z]]], offsets[a : z + 1] - offsets[a]
                starts, ends, at = spans_of(raw, own, _SEPARATOR) if len(raw) else (own[:0], own[:0], own)
                place, term = known.find(Lanes(raw), starts, ends)
                row = np.searchsorted(at, place, side="right") - 1
                codes, times = np.unique(row * len(terms) + term, return_counts=True)
                first = np.searchsorted(codes, np.arange(z - a + 1) * len(terms)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(first, pa.array(x.astype(np.int32))) for x in (codes % len(terms), times)]
                out = pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(np.diff(at)), *lists], ["doc_id", "n", "terms", "times"])
                yield out.filter(pa.compute.greater(out.column("n"), 0))

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(scan, "doc_id bigint, n bigint, terms array<int>, times array<int>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column and the offsets of its rows."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def counts(held: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, their terms with repeats, and the documents that hold each term. A task gives a row a term."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, np.int64)
        for b in batches:
            total[:n_terms] += np.bincount(_flat(b.column(1))[0], minlength=n_terms)
            total[n_terms:] += (len(b), b.column(0).to_numpy().sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], ["term", "n"])

    summed = held.select("n", "terms").mapInArrow(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    total = np.zeros(n_terms + 2, np.int64)
    for term, n in summed.collect():
        total[term] = n
    return int(total[n_terms]), int(total[n_terms + 1]), total[:n_terms]


class Best:
    """The k best documents of an item so far."""

    def __init__(self, k: int):
        self.k = k
        self.scores, self.ids, self.missing = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    @property
    def least(self) -> int:
        """What a document must reach; scores of 0 never count."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        take = scores >= self.least
        scores = np.concatenate([self.scores, scores[take]])
        ids, missing = np.concatenate([self.ids, ids[take]]), np.concatenate([self.missing, missing[take]])
        order = np.lexsort((ids, missing, -scores))[: self.k]
        self.scores, self.ids, self.missing = scores[order], ids[order], missing[order]


def masks(present: np.ndarray) -> np.ndarray:
    """The columns of a bit matrix (terms by documents) as one comparable value each."""
    packed = np.packbits(present, axis=0)
    wide = np.zeros((packed.shape[1], -(-len(packed) // 8) * 8), np.uint8)
    wide[:, : len(packed)] = packed.T
    return wide.view(np.uint64)[:, 0] if wide.shape[1] == 8 else wide.view(np.dtype((np.void, wide.shape[1])))[:, 0]


def search_batch(present: np.ndarray, parts: np.ndarray, worth: np.ndarray, ids: np.ndarray, missing: np.ndarray, best: Best) -> int:
    """Add an item's documents of a batch to its best; gives the number of documents scored.

    present and parts: the item's terms by documents; worth: weight of each term in a score.
    """
    names, first, group = np.unique(masks(present), return_index=True, return_inverse=True)
    bounds = present[:, first].T.astype(np.int64) @ (worth * parts.max(axis=1))
    order = np.argsort(-bounds, kind="stable")
    sizes = np.bincount(group, minlength=len(names))[order]
    place = np.empty(len(names), np.int64)
    place[order] = np.arange(len(names))
    docs = np.argsort(place[group], kind="stable")
    upto = np.cumsum(sizes)
    done = mask = 0
    while mask < len(names) and bounds[order[mask]] >= best.least:
        # The next masks that still may count, of about STEP documents in all.
        last = max(mask + 1, int(np.searchsorted(upto, done + STEP, side="right")))
        last = mask + int(np.searchsorted(-bounds[order[mask:last]], -best.least, side="right"))
        some = docs[done : upto[last - 1]]
        best.add(worth @ parts[:, some], ids[some], missing[some])
        mask, done = last, int(upto[last - 1])
    return done


def _score(held: DataFrame, block: Block, first: int, k: int) -> DataFrame:
    """_place (of the item, from first on), item_id, doc_id and score of at most k documents an item and task."""
    n_terms = len(block.terms)
    n_docs, length, holding = counts(held, n_terms)
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in holding], np.int64)
    width = max(1, CELLS // max(1, n_terms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [Best(k) for _ in block.items]
        worth = [weights[at] * times for _, at, times in block.items]
        for b in batches:
            ids, missing = b.column(0).fill_null(0).to_numpy(), b.column(0).is_null().to_numpy(zero_copy_only=False)
            (terms, offsets), (times, _) = _flat(b.column(2)), _flat(b.column(3))
            sizes, back = np.unique(b.column(1).to_numpy(), return_inverse=True)
            # Numbers of any length: the product can pass 64 bits on large inputs.
            m = np.array([25 + (75 * n * n_docs) // length for n in sizes.tolist()], np.int64)[back]
            for a in range(0, len(b), width):
                z = min(len(b), a + width)
                own = slice(offsets[a], offsets[z])
                doc = np.repeat(np.arange(z - a), np.diff(offsets[a : z + 1]))
                tf = times[own].astype(np.int64)
                parts = np.zeros((n_terms, z - a), np.int64)
                parts[terms[own], doc] = (1_000_000_000 * tf) // (1000 * tf + 8 * m[a:z][doc])
                present = np.zeros((n_terms, z - a), bool)
                present[terms[own], doc] = True
                for i, (_, at, _) in enumerate(block.items):
                    search_batch(present[at], parts[at], worth[i], ids[a:z], missing[a:z], best[i])
        place = np.repeat(np.arange(len(best)), [len(x.scores) for x in best])
        items = pa.array([block.items[i][0] for i in place.tolist()], pa.int64())
        found = [np.concatenate([getattr(x, name) for x in best]) for name in ("ids", "missing", "scores")]
        docs = pa.array(found[0], mask=found[1])
        yield pa.RecordBatch.from_arrays([pa.array(first + place), items, docs, pa.array(found[2])], ["_place", "item_id", "doc_id", "score"])

    return held.mapInArrow(run, "_place bigint, item_id bigint, doc_id bigint, score bigint")


def search(docs: DataFrame, items: DataFrame, k: int = 10, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of the k best of docs (doc_id, text) for each of items (item_id, text)."""
    schema = "_place bigint, item_id bigint, doc_id bigint, score bigint"
    out, place = docs.sparkSession.createDataFrame([], schema), 0
    for block in blocks(items, block_terms):
        out = out.unionByName(_score(cut_lineage(postings(docs, block.terms)), block, place, k))
        place += len(block.items)
    order = Window.partitionBy("_place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(f"rank <= {k}").select("item_id", "rank", "doc_id", "score")
