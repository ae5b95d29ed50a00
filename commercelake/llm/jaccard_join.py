"""N-gram Jaccard join by T-occurrence search with DivideSkip.

1. Texts become sets of 5-word shingles. Texts with equal sets are one class.
2. An inverted index over all shingles is dealt out by shingle, as packed blocks with one entry
   per class and input batch. It gives the number of classes that hold a shingle. Shingles that
   several classes hold go back to their classes, again as packed blocks.
3. A class with T = ceil(0.8 n) shared shingles at least stays. With its shingles ordered by
   list length, a partner holds one of the n - T + 1 in front: the short lists. The classes on a
   short list are compared with the least class there, its pivot.
4. Classes connected by short lists form neighbourhoods. In most of them all classes link to the
   pivots, and nothing is left to do. In the others each class outside the largest linked part
   asks an index of the neighbourhood: short lists are merged by one sort, the long ones that
   DivideSkip sets aside are probed by binary search for all candidates at once, and classes with the required overlap link.
   Neighbourhoods of more than BLOCK shingles are cut into blocks of index and of queries.
5. Components of the links, carried to all texts of a class.

Only pairs that are already connected are left out, so components are exact. Shingles are told
apart by 64-bit hashes.

Null and empty texts, and those of blanks only, have no shingles and link with nothing. Rows
without an identifier are returned with no component. Rows that share an identifier are one
node with several texts. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercelake.llm.components import connected
from commercelake.llm.words import chunks, text_bytes, windows, word_hashes, word_spans
from commercelake.session import cut_lineage

WIDTH = 5
BLOCK = 2_000_000
#: The factor of DivideSkip in the number of long lists.
MU = 0.0085
_SALTS = 8


def shingle_sets(column: pa.Array, width: int = WIDTH) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    data, offsets = text_bytes(column)
    for a, z in chunks(offsets):
        raw, own = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        starts, ends, at = word_spans(raw, own)
        hashes = word_hashes(raw, starts, ends, fold=True)
        grams = windows(hashes, width)
        for i in range(z - a):
            n = at[i + 1] - at[i]
            if n >= width:
                yield np.unique(grams[at[i] : at[i + 1] - width + 1])
            else:
                yield windows(hashes[at[i] : at[i + 1]], int(n)) if n else np.zeros(0, np.uint64)


def class_key(found: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(docs: DataFrame, buckets: int) -> DataFrame:
    """doc_id, k, n and m (entries in the packed index) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(class_key(s), len(s), _entries(s, buckets)) for s in shingle_sets(b.column(1))]
            columns = zip(*found, strict=True) if found else ([], [], [])
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in columns]], names=["doc_id", "k", "n", "m"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, k bigint, n bigint, m bigint")


def _entries(found: np.ndarray, buckets: int) -> int:
    """Shingles of a set that the packed index tells apart, by bucket and upper half."""
    upper = found >> np.uint64(32)
    if not (upper[1:] == upper[:-1]).any():
        return len(found)
    return len(np.unique((found % np.uint64(buckets)) << np.uint64(32) | upper))


def _bucket_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Packed index entries by bucket of the shingle: 32 further bits of it, class, more than one class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = {}
            for s in shingle_sets(b.column(0)):
                if len(s):
                    sets[class_key(s)] = s
            if not sets:
                continue
            keys = np.fromiter(sets, np.int64, len(sets))
            flat = np.concatenate(list(sets.values()))
            owner = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(s) for s in sets.values()])
            bucket = (flat % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = {"bucket": [], "low": [], "owner": [], "keys": []}
            for i in range(buckets):
                own = order[cuts[i] : cuts[i + 1]]
                if len(own):
                    used, local = np.unique(owner[own], return_inverse=True)
                    out["bucket"].append(i)
                    out["low"].append((flat[own] >> np.uint64(32)).astype("<u4").tobytes())
                    out["owner"].append(local.astype("<u2" if len(used) < 1 << 16 else "<u4").tobytes())
                    out["keys"].append(keys[used].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("low", pa.binary()), ("owner", pa.binary()), ("keys", pa.binary())]))

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket bigint, low binary, owner binary, keys binary")


def _unpacked(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for bucket, low, owner, keys in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
        low, keys = np.frombuffer(low, "<u4"), np.frombuffer(keys, np.int64)
        yield bucket, low, keys[np.frombuffer(owner, "<u2" if 2 * len(low) == len(owner) else "<u4")]


def _shared_blocks(blocks: DataFrame, groups: int) -> DataFrame:
    """Packed entries of shingles that several classes hold, by group of the class."""

    def flush(bucket: int, low: list[np.ndarray], key: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        token, key_ = np.concatenate(low), np.concatenate(key)
        order = np.lexsort((key_, token))
        token, key_ = token[order], key_[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (key_[1:] != key_[:-1])])
        token, key_ = token[new], key_[new]
        _, count = np.unique(token, return_counts=True)
        held = np.repeat(count, count)
        keep = held > 1
        token, key_, held = token[keep].astype(np.int64), key_[keep], held[keep]
        if len(token):
            # The bucket makes the name of the shingle whole again.
            name = (token << 24) ^ bucket
            group = key_ % groups
            order = np.lexsort((key_, group))
            cuts = np.searchsorted(group[order], np.arange(groups + 1))
            rows = [(g, order[cuts[g] : cuts[g + 1]]) for g in range(groups) if cuts[g] < cuts[g + 1]]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in rows], pa.int64()),
                    *[pa.array([x[o].tobytes() for _, o in rows], pa.binary()) for x in (name, key_, np.minimum(held, 2**31 - 1).astype(np.int32))],
                ],
                names=["g", "name", "key", "held"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, low, key = None, [], []
        for b in batches:
            for bucket, t, k in _unpacked(b):
                if bucket != now and low:
                    yield from flush(now, low, key)
                    low, key = [], []
                now = bucket
                low.append(t)
                key.append(k)
        if low:
            yield from flush(now, low, key)

    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "g bigint, name binary, key binary, held binary")


def _short_lists(shared: DataFrame, sizes: DataFrame, groups: int) -> DataFrame:
    """k, n and name for each short list a class is on; classes with too few shared shingles go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _grouped(batches, "g"):
            known = {}
            for ks, ns in zip(g["ks"], g["ns"], strict=True):
                if ks is not None:
                    known |= zip(np.frombuffer(ks, np.int64).tolist(), np.frombuffer(ns, np.int64).reshape(-1, 2).tolist(), strict=True)
            parts = [(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64), np.frombuffer(c, np.int32)) for a, b, c in zip(g["name"], g["key"], g["held"], strict=True) if a is not None]
            if not parts:
                continue
            name, key, held = (np.concatenate([p[i] for p in parts]) for i in range(3))
            order = np.lexsort((name, held, key))
            name, key = name[order], key[order]
            cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            ks, ns, names = [], [], []
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                n = known[int(key[a])][0]
                # Shingles that no other class holds come first; they use up room in front.
                room = n // 5 + 1 - (known[int(key[a])][1] - (z - a))
                if room > 0:
                    took = name[a : min(z, a + room)]
                    ks.append(np.full(len(took), key[a]))
                    ns.append(np.full(len(took), n))
                    names.append(took)
            if ks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ks, ns, names)], names=["k", "n", "name"])

    # A class's group is one packed row of names and sizes per input task, so equal groups meet.
    packed_sizes = sizes.select("k", "n", "m").repartition(groups, F.pmod("k", F.lit(groups))).mapInArrow(_pack_sizes(groups), "g bigint, ks binary, ns binary")
    none = F.lit(None).cast("binary")
    both = shared.select("g", "name", "key", "held", none.alias("ks"), none.alias("ns")).unionByName(
        packed_sizes.select("g", none.alias("name"), none.alias("key"), none.alias("held"), "ks", "ns")
    )
    return both.repartition("g").sortWithinPartitions("g").mapInArrow(run, "k bigint, n bigint, name bigint")


def _pack_sizes(groups: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, n, m = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            both = np.stack([n, m], axis=1)
            g = k % groups
            order = np.argsort(g, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], g[order][1:] != g[order][:-1], [True]])) if len(k) else []
            parts = [order[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(g[p[0]]) for p in parts], pa.int64()), pa.array([k[p].tobytes() for p in parts], pa.binary()), pa.array([both[p].tobytes() for p in parts], pa.binary())],
                names=["g", "ks", "ns"],
            )

    return run


def _grouped(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, list]]:
    """Rows of equal key, from batches sorted by it."""
    held: dict[str, list] = {}
    for b in batches:
        rows = b.to_pydict()
        keys = rows[key]
        a = 0
        for value, run in groupby(keys):
            z = a + len(list(run))
            if held and held[key][0] != value:
                yield held
                held = {}
            for c, v in rows.items():
                held.setdefault(c, []).extend(v[a:z])
            a = z
    if held:
        yield held


def _with_tokens(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """k, n and the packed shingles of the classes in reps (k, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = list(shingle_sets(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([class_key(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())],
                names=["_want", "k", "n", "tokens"],
            )

    wanted = reps.select(F.col("k").alias("_want"), F.col("rep").alias("_rep")).hint("shuffle_hash")
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    found = rows.join(wanted, rows["doc_id"] == F.col("_rep")).select("_want", "text").mapInArrow(run, "_want bigint, k bigint, n bigint, tokens binary")
    # An identifier that several texts share has their other classes here too, and repeats.
    return found.where("_want = k").drop("_want").dropDuplicates(["k"])


def _linked(a: np.ndarray, b: np.ndarray) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= 80 * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = sets.select(F.col("k").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("k").alias("b"), F.col("tokens").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a bigint, b bigint")


class InvertedIndex:
    """Lists of set numbers by shingle, for T-occurrence search."""

    def __init__(self, sets: list[np.ndarray]):
        self._lengths = np.array([len(s) for s in sets], np.int64)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self._lengths)
        order = np.argsort(flat, kind="stable")
        self._owner = owner[order]
        self._tokens, first = np.unique(flat[order], return_index=True)
        self._cuts = np.append(first, len(flat))

    def _lists(self, query: np.ndarray) -> list[np.ndarray]:
        if not len(self._tokens):
            return []
        at = np.minimum(np.searchsorted(self._tokens, query), len(self._tokens) - 1)
        return [self._owner[self._cuts[i] : self._cuts[i + 1]] for i in at[self._tokens[at] == query].tolist()]

    def search(self, query: np.ndarray, skip) -> Iterator[int]:
        """Sets that link with the query, without those for which skip(numbers of sets) is true."""
        lists = sorted(self._lists(query), key=len)
        least = -(-4 * len(query) // 5)
        if len(lists) < least:
            return
        # DivideSkip: as many long lists are set aside as pay, fewer than the least overlap.
        long_ = min(least - 1, int(least / (MU * math.log2(max(2, len(lists[-1]))) + 1)))
        short, aside = lists[: len(lists) - long_], lists[len(lists) - long_ :]
        found, seen = np.unique(np.concatenate(short), return_counts=True)
        live = np.flatnonzero(seen >= least - long_)
        live = live[~np.broadcast_to(skip(found[live]), live.shape)]
        found, seen = found[live], seen[live]
        both = len(query) + self._lengths[found]
        need = -(-80 * both // 180)
        for i, x in enumerate(aside):
            live = seen + len(aside) - i >= need
            if not live.all():
                found, seen, both, need = found[live], seen[live], both[live], need[live]
            if not len(found):
                return
            at = np.searchsorted(x, found)
            seen = seen + (x[np.minimum(at, len(x) - 1)] == found)
        yield from found[100 * seen >= 80 * (both - seen)].tolist()


def _search_units(units: DataFrame) -> DataFrame:
    """Links found by the queries of each unit in its index; a link per pair of parts at most."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        _, part = np.unique(rows["part"].to_numpy(), return_inverse=True)
        indexed, asks = (np.flatnonzero(rows[c].to_numpy(bool)) for c in ("indexed", "asks"))
        names, tokens = rows["k"].to_numpy(), [np.frombuffer(t, np.uint64) for t in rows["tokens"]]
        lookup = InvertedIndex([tokens[i] for i in indexed])
        parts, names_there = part[indexed], names[indexed]
        parent = np.arange(part.max() + 1)

        def roots(x: np.ndarray) -> np.ndarray:
            root = parent[x]
            while (parent[root] != root).any():
                root = parent[root]
            parent[x] = root
            return root

        out = []
        for i in asks.tolist():
            own = part[[i]]
            for j in lookup.search(tokens[i], lambda them, own=own: roots(parts[them]) == roots(own)):
                here, there = roots(own)[0], roots(parts[[j]])[0]
                if here != there:
                    parent[there] = here
                    out.append((names[i], names_there[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return units.groupBy("hood", "ask_block", "index_block").applyInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    spark = docs.sparkSession
    buckets = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = cut_lineage(_sets(docs, buckets))
    classes = cut_lineage(rows.where("n > 0 and doc_id is not null").groupBy("k").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("m").alias("m")))
    shared = _shared_blocks(_bucket_blocks(docs.where("doc_id is not null"), buckets), buckets)
    short = cut_lineage(_short_lists(shared, classes, buckets))
    pivots = short.groupBy("name").agg(F.min("k").alias("b"), F.max("k").alias("_top")).where("b < _top")
    pairs = cut_lineage(short.join(pivots, "name").where("k <> b").select(F.col("k").alias("a"), "b").distinct())
    hoods = connected(pairs)
    sets = cut_lineage(_with_tokens(docs, classes.join(hoods.select(F.col("node").alias("k")), "k", "left_semi")))
    links = cut_lineage(_verified(pairs, sets))
    parts = connected(links)

    inside = hoods.select(F.col("node").alias("k"), F.col("label").alias("hood")).join(
        parts.select(F.col("node").alias("k"), F.col("label").alias("part")), "k", "left"
    )
    inside = cut_lineage(inside.withColumn("part", F.coalesce("part", "k")).join(sets.select("k", "n"), "k"))
    sizes = inside.groupBy("hood", "part").agg(F.count("*").alias("_c"), F.sum("n").alias("_t"))
    open_ = (
        sizes.groupBy("hood")
        .agg(F.count("*").alias("_parts"), F.max_by("part", F.struct("_c", "part")).alias("main"), F.sum("_t").alias("_all"), F.max(F.struct("_c", "part", "_t"))["_t"].alias("_main"))
        .where("_parts > 1")
        .select("hood", "main", F.ceil(F.col("_all") / block).alias("_ib"), F.ceil(F.greatest(F.col("_all") - F.col("_main"), F.lit(1)) / block).alias("_ab"))
    )
    left = inside.join(open_, "hood").join(sets.select("k", "tokens"), "k")
    index = left.withColumn("index_block", F.pmod(F.xxhash64("k"), F.col("_ib"))).withColumn("ask_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ab") - 1)))
    asks = left.where("part <> main").withColumn("ask_block", F.pmod(F.xxhash64("k"), F.col("_ab"))).withColumn("index_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_ib") - 1)))
    columns = ["hood", "ask_block", "index_block", "k", "part", "tokens"]
    units = index.select(*columns, F.lit(True).alias("indexed"), F.lit(False).alias("asks")).unionByName(asks.select(*columns, F.lit(False).alias("indexed"), F.lit(True).alias("asks")))
    # Written, so that no task holds a Python worker for the search and another for what follows.
    more = cut_lineage(_search_units(units))

    # Texts under one identifier are one node.
    several = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("k").alias("b"), F.max("k").alias("_top")).where("b < _top")
    same = rows.where("n > 0").join(several, "doc_id").select(F.col("k").alias("a"), "b")
    # The parts stand for their links.
    stars = parts.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b"))
    labels = connected(stars.unionByName(more).unionByName(same))
    least = labels.join(classes.select(F.col("k").alias("node"), "rep"), "node").groupBy("label").agg(F.min("rep").alias("component_id"))
    named = labels.join(least, "label").select(F.col("node").alias("k"), "component_id")
    # Classes of one text without links need no entry; a hot class is salted.
    copies = rows.where("n > 0 and doc_id is not null").groupBy("k").agg(F.count("*").alias("_c"), F.min("doc_id").alias("rep")).where("_c > 1")
    entries = named.join(copies.select("k", "rep"), "k", "full_outer").select("k", F.coalesce("component_id", "rep").alias("component_id"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(_SALTS)))
    entries = entries.withColumn("_salt", F.expr(f"explode(sequence(0L, {_SALTS - 1}L))"))
    found = salted.join(entries, ["k", "_salt"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce(F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))), F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose identifier is the least of their component, all columns."""
    stays = near_duplicates(docs).where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(stays, docs["doc_id"] == stays["_id"], "left_semi")
