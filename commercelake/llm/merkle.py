"""Merkle manifest of a dataset: a content-addressed DAG and inclusion proofs by descent.

Leaves of a group stand in the order of their identifier; runs of ARITY consecutive nodes become
the digest of their digests, until one node is left. The roots of the groups, in the order of the
group, become the root of the dataset in the same way.

The store keeps digest-to-children records. SEGMENT levels of records below one digest lie in one
row, the segment of that digest, so a tree of n leaves takes log n to the base ARITY**SEGMENT
rounds. Leaf requests descend from the root: each round joins the segments that hold a requested
leaf, the digits of the leaf's rank say which child to take at each record, and the children not
taken are collected. The steps of all segments, reversed, are the proof from the leaf up. Requests
below one digest travel as one row until the last round, so the root is no hot key.

Rows are leaves even if repeated. Null identifiers stand first in their group and null groups
first of all; rows with equal identifiers are ordered by digest, so their order cannot change a
root. Without rows there is no root and no proof.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercelake.session import cut_lineage

ARITY = 3
#: Levels of records in a row of the store: at most 81 leaves and 40 records.
SEGMENT = 4
SPAN = ARITY**SEGMENT

STEP = "struct<before: string, after: string>"


def digest(*fields: Column) -> Column:
    """Lowercase hex sha256 of the fields, each `-` if null, else its UTF-8 byte count, `:` and value."""
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _div(value: Column, by: Column | int) -> Column:
    return F.call_function("div", value, by if isinstance(by, Column) else F.lit(by))


def _joined(digests: Column) -> Column:
    return F.array_join(digests, "")


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with _rank, from 0, in their group and _n, the rows of the group, in a written table.

    One shuffle into ranges of (group, order), which cut a hot group; a row's place in its range
    less that of the group's first row there, plus the group's rows in earlier ranges.
    """
    tie = rows.withColumn("_tie", F.monotonically_increasing_id())
    by = [group, *order, "_tie"]
    placed = tie.repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie").withColumn("_at", F.monotonically_increasing_id())
    placed = cut_lineage(placed.withColumn("_part", F.shiftright("_at", 33)))
    runs = placed.groupBy(F.col(group).alias("_g"), F.col("_part").alias("_p")).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    # A group has at most one row here for each range of rows.
    own = Window.partitionBy("_g")
    earlier = own.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")
    runs = runs.select("_g", "_p", shift.alias("_shift"), F.sum("_rows").over(own).alias("_n"))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))
    return cut_lineage(placed.join(runs, same).withColumn("_rank", F.col("_at") + F.col("_shift")).drop("_g", "_p", "_shift", "_at", "_part"))


def _height(most: int) -> Column:
    """Levels above the _n leaves of a group, where no group has more than `most`."""
    powers, power = [], 1
    while power < most:
        powers.append(power)
        power *= ARITY
    return sum((F.when(F.col("_n") > p, 1).otherwise(0) for p in powers), F.lit(0))


def _records(leaves: Column, steps: Column) -> Column:
    """All records (digest, children) of `steps` levels above an array of digests, lowest level first.

    Each level keeps its records; the next one is made from the digests of the last.
    """
    record = "struct<digest: string, children: array<string>>"
    ground = F.array(F.transform(leaves, lambda d: F.struct(d.alias("digest"), F.array().cast("array<string>").alias("children"))))

    def above(levels: Column, _: Column) -> Column:
        below = F.element_at(levels, -1)["digest"]
        runs = F.transform(
            F.sequence(F.lit(0), _div(F.size(below) - 1, ARITY).cast("int")),
            lambda i: F.slice(below, i * ARITY + 1, F.lit(ARITY)),
        )
        level = F.transform(runs, lambda c: F.struct(F.sha2(_joined(c).cast("binary"), 256).alias("digest"), c.alias("children")))
        return F.concat(levels, F.array(level))

    return F.aggregate(F.sequence(F.lit(1), steps), ground.cast(f"array<array<{record}>>"), above)


@dataclass
class Tree:
    """A forest: per group its root and height, and per round the segments of all groups."""

    roots: DataFrame  # _group, _height, _root
    segments: list[DataFrame]  # _segment, _records (digest to children)


def build(leaves: DataFrame) -> Tree:
    """The trees over leaves (_group, _rank, _n, _leaf), one round for each SEGMENT levels of the highest."""
    most = leaves.agg(F.max("_n")).first()[0] or 0
    nodes = leaves.select("_group", "_rank", _height(most).alias("_height"), "_leaf")
    roots = nodes.where("_height = 0").select("_group", "_height", F.col("_leaf").alias("_root"))
    top = 0
    while ARITY**top < most:
        top += 1
    segments = []
    for base in range(0, top, SEGMENT):
        run = F.sort_array(F.collect_list(F.struct("_rank", "_leaf"))).alias("_run")
        blocks = nodes.where(f"_height > {base}").groupBy("_group", _div(F.col("_rank"), SPAN).alias("_block"), "_height").agg(run)
        steps = F.least(F.lit(SEGMENT), F.col("_height") - base)
        levels = blocks.select("_group", "_block", "_height", _records(F.col("_run._leaf"), steps).alias("_levels"))
        made = cut_lineage(
            levels.select(
                "_group", "_block", "_height",
                F.element_at("_levels", -1)[0]["digest"].alias("_top"),
                F.map_from_entries(F.array_distinct(F.flatten(F.slice("_levels", 2, SEGMENT)))).alias("_records"),
            )
        )
        segments.append(made.select(F.col("_top").alias("_segment"), "_records"))
        roots = roots.unionByName(made.where(f"_height <= {base + SEGMENT}").select("_group", "_height", F.col("_top").alias("_root")))
        nodes = made.select("_group", F.col("_block").alias("_rank"), "_height", F.col("_top").alias("_leaf")).where(f"_height > {base + SEGMENT}")
    return Tree(roots, segments)


def _path(records: Column, start: Column, rank: Column, steps: Column) -> Column:
    """From a digest down by the last `steps` digits of a rank: (at, before, after) per record, top first."""
    begin = F.array(F.struct(start.alias("at"), F.lit("").alias("before"), F.lit("").alias("after")))

    def down(path: Column, level: Column) -> Column:
        digit = F.pmod(_div(rank, F.pow(F.lit(ARITY), level).cast("bigint")), F.lit(ARITY)).cast("int")
        return F.concat(
            path,
            F.transform(
                F.array(F.element_at(records, F.element_at(path, -1)["at"])),
                lambda c: F.struct(
                    F.element_at(c, digit + 1).alias("at"),
                    _joined(F.slice(c, F.lit(1), digit)).alias("before"),
                    _joined(F.slice(c, digit + 2, F.lit(ARITY))).alias("after"),
                ),
            ),
        )

    return F.aggregate(F.sequence(steps - 1, F.lit(0)), begin, down)


def _finder(steps: Column, last: bool):
    def found(wanted: Column) -> Column:
        path = _path(F.col("_records"), F.col("_at"), wanted["unit"], steps)
        return F.struct(wanted["unit"].alias("unit"), path.alias("path"), *([wanted["_asked"].alias("asked")] if last else []))

    return found


def descend(tree: Tree, starts: DataFrame, requests: DataFrame) -> DataFrame:
    """requests (_group, _rank, _asked) with _leaf, _proof (STEPs from the leaf up) and _carried of its start.

    starts has a row per group: _group, _height, _at (the digest its descent begins at), _above (the
    steps from there up), _carried. A round goes down the segments of one depth in all groups.
    """
    own = F.col("_group").eqNullSafe(F.col("_g"))
    lone = starts.where("_height = 0").select(F.col("_group").alias("_g"), "_at", "_above", "_carried")
    out = requests.join(lone, own).select("_group", "_rank", "_asked", F.col("_at").alias("_leaf"), F.col("_above").alias("_proof"), "_carried")
    frontier = None
    for depth in range(len(tree.segments), 0, -1):
        begun = starts.where(F.ceil(F.col("_height") / SEGMENT) == depth)
        begun = begun.select("_group", F.lit(0).cast("bigint").alias("_block"), "_height", "_at", "_above", "_carried")
        frontier = begun if frontier is None else frontier.unionByName(begun)
        # Where the requests go on: units of this depth, each once, but the requests themselves at the end.
        unit = _div(F.col("_rank"), SPAN ** (depth - 1))
        wanted = F.collect_list(F.struct(unit.alias("unit"), "_asked")) if depth == 1 else F.collect_set(F.struct(unit.alias("unit")))
        asked = requests.groupBy(F.col("_group").alias("_g"), _div(F.col("_rank"), SPAN**depth).alias("_b")).agg(wanted.alias("_wanted"))
        held = tree.segments[depth - 1].groupBy("_segment").agg(F.first("_records").alias("_records"))
        here = frontier.join(asked, own & (F.col("_block") == F.col("_b"))).join(held, F.col("_at") == F.col("_segment"))
        steps = F.least(F.lit(SEGMENT), F.col("_height") - (depth - 1) * SEGMENT)

        each = here.select("_group", "_height", "_above", "_carried", F.explode(F.transform("_wanted", _finder(steps, depth == 1))).alias("_f"))
        climbed = F.transform(F.reverse(F.slice("_f.path", 2, SEGMENT)), lambda s: F.struct(s["before"].alias("before"), s["after"].alias("after")))
        at, above = F.element_at("_f.path", -1)["at"], F.concat(climbed, "_above")
        if depth > 1:
            frontier = each.select("_group", F.col("_f.unit").alias("_block"), "_height", at.alias("_at"), above.alias("_above"), "_carried")
        else:
            leaves = each.select("_group", F.col("_f.unit").alias("_rank"), F.col("_f.asked").alias("_asked"), at.alias("_leaf"), above.alias("_proof"), "_carried")
            out = out.unionByName(leaves)
    return out


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda d, step: F.sha2(F.concat(step["before"], d, step["after"]).cast("binary"), 256))


def siblings(proof: Column) -> Column:
    """The digests of a proof level by level, joined."""
    return F.array_join(F.transform(proof, lambda step: F.concat(step["before"], step["after"])), "")


@dataclass
class Manifest:
    """The trees of all groups and, above them, that of their roots."""

    below: Tree
    above: Tree
    groups: DataFrame  # _group, _rank: the place of each group's root


def manifest(leaves: DataFrame) -> Manifest:
    """The manifest of leaves (_group, _rank, _n, _leaf), as ranked() gives them."""
    below = build(leaves)
    subroots = below.roots.select(F.lit(0).alias("_all"), F.col("_group").alias("_name"), F.col("_root").alias("_leaf"))
    placed = ranked(subroots, "_all", ["_name"])
    above = build(placed.select(F.col("_all").alias("_group"), "_rank", "_n", "_leaf"))
    return Manifest(below, above, placed.select(F.col("_name").alias("_group"), "_rank"))


def proofs(held: Manifest, requests: DataFrame) -> DataFrame:
    """requests (_group, _rank, _asked) with _leaf, _subroot, _root and _proof. A leaf is asked for once.

    One descent from the root to the requested groups' roots, one from there to the leaves.
    """
    steps = F.array().cast(f"array<{STEP}>")
    top = held.above.roots.select("_group", "_height", F.col("_root").alias("_at"), steps.alias("_above"), F.col("_root").alias("_carried"))
    named = requests.select("_group").distinct()
    at = held.groups.join(named.withColumnRenamed("_group", "_g"), F.col("_group").eqNullSafe(F.col("_g")), "left_semi")
    asked = at.select(F.lit(0).alias("_group"), "_rank", F.struct("_group").alias("_asked"))
    found = descend(held.above, top, asked).select(
        F.col("_asked._group").alias("_g"), F.col("_leaf").alias("_at"), F.col("_proof").alias("_above"), F.struct(F.col("_leaf").alias("subroot"), F.col("_carried").alias("root")).alias("_carried")
    )
    sizes = held.below.roots.select("_group", "_height")
    starts = cut_lineage(sizes.join(found, F.col("_group").eqNullSafe(F.col("_g"))).drop("_g"))
    return descend(held.below, starts, requests).select(
        "_group", "_rank", "_asked", "_leaf", F.col("_carried.subroot").alias("_subroot"), F.col("_carried.root").alias("_root"), "_proof"
    )


def document_leaves(docs: DataFrame) -> DataFrame:
    """doc_id, _group (source), _leaf, and _tampered: the digest with the text changed, null where it is not.

    Every second document, by the CRC-32 of its identifier, loses the line feeds of its text.
    """
    doc = docs.select(
        F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("lang").cast("string"), F.col("n_chars").cast("bigint"), F.col("text").cast("string")
    )
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(chosen & F.contains("text", F.lit("\n")), digest(*fields, F.translate("text", "\n", "")))
    return doc.select("doc_id", F.col("source").alias("_group"), digest(*fields, F.col("text")).alias("_leaf"), changed.alias("_tampered"))


def verified_documents(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each document.

    Texts are read once, for the leaves; all else works on digests.
    """
    leaves = cut_lineage(document_leaves(docs))
    placed = ranked(leaves, "_group", ["doc_id", "_leaf"])
    held = manifest(placed.select("_group", "_rank", "_n", "_leaf"))
    requests = placed.select("_group", "_rank", F.struct("doc_id", "_tampered").alias("_asked"))
    root = folded(F.coalesce("_asked._tampered", "_leaf"), F.col("_proof"))
    out = proofs(held, requests).select(
        F.col("_asked.doc_id").alias("doc_id"),
        F.col("_leaf").alias("leaf"),
        F.col("_subroot").alias("subroot"),
        F.col("_root").alias("root"),
        F.sha2(siblings(F.col("_proof")).cast("binary"), 256).alias("proof_sha256"),
        root.alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
