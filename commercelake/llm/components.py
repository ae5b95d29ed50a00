"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercelake.session import cut_lineage

#: Links that a task replaces at a time by the stars of their own components.
CHUNK = 500_000


def connected(links: DataFrame) -> DataFrame:
    """node and label (least node reachable) of every node in links (a, b); rounds grow with log n.

    Each task first replaces its links, some at a time, by stars of what they connect. A round
    then sends the larger neighbours of each node to the least one, then the smaller ones.
    Neighbour lists are never gathered: the least neighbour is an aggregate that is joined
    back to the links. Ends when only stars are left.
    """
    pairs = links.where("a <> b").select(F.col("a").cast("bigint"), F.col("b").cast("bigint"))
    edges = cut_lineage(pairs.mapInArrow(_stars, "a bigint, b bigint").distinct())
    while not _only_stars(edges):
        large = _star(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), F.col("b") > F.col("a"))
        edges = cut_lineage(_star(large, F.lit(True)))
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, least node) of the components of every CHUNK links, without the least nodes themselves."""
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        names, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        x, y = ends.reshape(2, -1)
        label, before = np.arange(len(names)), None
        # Each node points to its least neighbour, and from there on until nothing changes.
        while before is None or (label != before).any():
            before = label.copy()
            least = np.minimum(label[x], label[y])
            np.minimum.at(label, before[x], least)
            np.minimum.at(label, before[y], least)
            while (label[label] != label).any():
                label = label[label]
        leaf = label != np.arange(len(names))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(names[leaf]), pa.array(names[label[leaf]])], names=["a", "b"])

    for b in batches:
        held.append(np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(2)]))
        if sum(h.shape[1] for h in held) >= CHUNK:
            yield flush()
    if held:
        yield flush()


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one link to a least node, or is a least node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("n"), F.lit(1).alias("up")), F.struct(F.col("b").alias("n"), F.lit(0).alias("up")))).alias("e"))
    each = ends.groupBy("e.n").agg(F.sum("e.up").alias("_up"), F.min("e.up").alias("_least"))
    return each.where("_up > 1 or _up = 1 and _least = 0").agg(F.count("*")).first()[0] == 0


def _star(edges: DataFrame, which) -> DataFrame:
    """Links (larger, least): each node's chosen neighbours, and itself, to its least neighbour."""
    least = edges.groupBy(F.col("a").alias("_a")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
    moved = edges.join(least, F.col("a") == F.col("_a"))
    out = moved.select(F.explode(F.array(F.struct(F.when(which, F.col("b")).alias("x"), "m"), F.struct(F.col("a").alias("x"), "m"))).alias("_e")).select("_e.*")
    return out.where("x <> m").select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()
