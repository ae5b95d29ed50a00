"""The Merkle manifest against a plain loop, on awkward rows and on a subset of requests."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from commercelake.llm import merkle

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, _leaf string, _rank string, _group string, _g string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest(*last[i : i + 3]) for i in range(0, len(last), 3)])
    return levels


def path(levels, i):
    for nodes in levels[:-1]:
        start = i // 3 * 3
        yield "".join(nodes[start:i]), "".join(nodes[i + 1 : start + 3])
        i //= 3


def by_loop(rows):
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted."""

    def leaf(r, text):
        return digest(*map(field, (*r[:4], text)))

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    for some in groups.values():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r[4]) for r in groups[s]]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    root = top[-1][0] if names else None
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            end = leaf(r, r[4].replace("\n", "") if tampered else r[4])
            for before, after in steps:
                end = digest(before, end, after)
            out.append((r[0], trees[s][0][i], trees[s][-1][0], root, digest(*[a + b for a, b in steps]), end, end == root))
    return sorted(out, key=str)


def rows():
    rng = random.Random(3)
    out = [(i, "a", "en", i, "x\n" * (i % 4)) for i in range(250)]
    out += [(1000 + i, f"s{i:02d}", None, None, None) for i in range(11)]
    out += [(2000 + i, None, "de", 1, "é\nü") for i in range(5)]
    out += [(3000, "z", "", -5, "")] * 4 + [(None, "z", "en", 2, "a\nb"), (None, "z", "en", 2, "b\na"), (3001, "ä", "en", 3, "long \n" * 50_000)]
    rng.shuffle(out)
    return out


def read(df):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def docs(spark, some):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in some], SCHEMA).repartition(3)


@pytest.mark.parametrize("some", [rows(), rows()[:1], [(7, None, None, None, None)] * 3], ids=["all", "one", "copies"])
def test_every_document_against_a_loop(spark, some):
    found = read(merkle.verified_documents(docs(spark, some)))
    assert found == by_loop(some)
    if len(some) > 3:
        assert {v[-1] for v in found} == {True, False}


def test_no_documents(spark):
    assert read(merkle.verified_documents(docs(spark, []))) == []


def test_some_requests_descend_alone(spark):
    some = sorted({r[0]: r for r in rows() if r[0] is not None}.values())
    leaves = merkle.document_leaves(docs(spark, some))
    placed = merkle.ranked(leaves, "_group", ["doc_id", "_leaf"])
    held = merkle.manifest(placed.select("_group", "_rank", "_n", "_leaf"))
    asked = placed.where("doc_id IN (0, 81, 249, 1003, 2004)").select("_group", "_rank", F.struct("doc_id").alias("_asked"))
    found = merkle.proofs(held, asked).select(
        F.col("_asked.doc_id").alias("doc_id"), "_leaf", "_root", merkle.folded(F.col("_leaf"), F.col("_proof")).alias("end")
    )
    want = {r[0]: r[1] for r in by_loop(some)}
    found = {r["doc_id"]: (r["_leaf"], r["end"] == r["_root"]) for r in found.collect()}
    assert found == {i: (want[i], True) for i in (0, 81, 249, 1003, 2004)}
