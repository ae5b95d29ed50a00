"""Ranked search against a plain loop; exact terms; pruning that loses nothing."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from commercelake.llm import lexical
from commercelake.llm.words import Lanes, spans_of
from commercelake.session import ship_package

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans(lexical.UPPER, lexical.LOWER)
CLASHES = "n string, terms string, times string, item_id string, score string, rank string, _place string"


def terms_of(text):
    return TERM.findall((text or "").translate(FOLD))


def by_loop(docs, items, k=10):
    held = [(i, Counter(terms_of(t)), len(terms_of(t))) for i, t in docs]
    held = [h for h in held if h[2]]
    length, df = sum(n for *_, n in held), Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for doc, tf, n in held:
            m = 25 + (75 * n * len(held)) // length
            score = 0
            for term in terms_of(text):
                if term in tf:
                    w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[term] + 1)))
                    score += w * ((1000000000 * tf[term]) // (1000 * tf[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -score) for rank, (score, _, _, doc) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def data():
    rng = random.Random(11)
    words = [a + b for a in ("ka", "Ri", "tö", "mu", "9") for b in ("l", "nd", "sé", "x" * 20, "rt", "p", "")]
    weights = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 60)))) for i in range(300)]
    docs += [(300, None), (301, ""), (302, " .,;-\n"), (None, docs[0][1]), (None, docs[1][1]), (7, docs[7][1]), (303, docs[7][1])]
    docs += [(304, "kal " * 30_000), (305, "y" * 300_000 + " kal"), (306, "KAL-kal_kal\x00KAL`É é")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 12)))) for i in range(12)]
    items += [(20, None), (21, "..."), (22, "unseen"), (23, "kal kal KAL"), (23, "rind"), (24, "kal kal KAL"), (24, "kal kal KAL"), (None, "rtp é")]
    items += [(25, " ".join(f"w{i}" for i in range(150)) + " kal mup tösé"), (26, "y" * 300_000)]
    docs += [(400 + i, " ".join(f"w{j}" for j in range(i, 150, i + 1))) for i in range(20)]
    return docs, items


@pytest.mark.parametrize("block_terms", [lexical.BLOCK_TERMS, 20])
def test_search_against_a_loop(spark, block_terms, monkeypatch):
    ship_package(spark)
    docs, items = data()
    held = spark.createDataFrame([(*d, *["x"] * 7) for d in docs], f"doc_id bigint, text string, {CLASHES}").repartition(3)
    asked = spark.createDataFrame([(*i, "x", "x") for i in items], "item_id bigint, text string, doc_id string, _place string")
    found = lexical.search(held, asked, 10, block_terms)
    assert sorted((tuple(r) for r in found.collect()), key=str) == by_loop(docs, items)


def test_empty_tables(spark):
    ship_package(spark)
    docs, items = spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "kal")], "item_id bigint, text string")
    assert lexical.search(docs, some).count() == 0
    assert lexical.search(docs, items).count() == 0
    assert lexical.search(some.withColumnRenamed("item_id", "doc_id"), items).count() == 0


@pytest.mark.parametrize("n_terms", [3, 64, 65, 130])
def test_masks_leave_documents_out_and_lose_none(n_terms):
    rng = np.random.default_rng(n_terms)
    present = rng.random((n_terms, 500)) < rng.random((1, 500))
    parts = np.where(present, rng.integers(1, 50, present.shape), 0)
    worth, ids = rng.integers(0, 9, n_terms), rng.permutation(500)
    best, scored = lexical.Best(5), 0
    for a in range(0, 500, 100):
        z = a + 100
        scored += lexical.search_batch(present[:, a:z], parts[:, a:z], worth, ids[a:z], np.zeros(100, bool), best)
    scores = worth @ parts
    want = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist(), strict=True) if s > 0)[:5]
    assert [(-s, i) for s, i in zip(best.scores.tolist(), best.ids.tolist(), strict=True)] == want
    assert scored < 500


def test_words_of_one_hash_are_told_apart():
    """Bytes decide: a hash that never differs still finds the right term."""

    class Weak(Lanes):
        def hashes(self, starts, ends, salt=0):
            return np.full(len(starts), 7, np.uint64)

    data_ = np.frombuffer(b"abc abd abcdefghij abcdefghik abc", np.uint8)
    starts, ends, _ = spans_of(data_, np.array([0, len(data_)]), lexical._SEPARATOR)
    for term, places in ((b"abc", [0, 4]), (b"abcdefghij", [2]), (b"x" * 200, [])):
        known = lexical.Terms([term.decode()])
        known._keys = np.full(1, 7, np.uint64)
        assert known.find(Weak(data_), starts, ends)[0].tolist() == places
    long_ = np.frombuffer(b"a" * 199 + b"b", np.uint8)
    one = Lanes(long_)
    assert not one.same(np.array([0]), Lanes(long_[::-1].copy()), np.array([0]), np.array([200]))[0]
    assert one.same(np.array([0]), one, np.array([0]), np.array([200]))[0]


def test_terms_stop_at_rows_and_ascii():
    data_ = np.frombuffer("ab cdé-é".encode(), np.uint8)
    starts, ends, at = spans_of(data_, np.array([0, 1, 4, len(data_)]), lexical._SEPARATOR)
    assert [data_[s:e].tobytes().decode() for s, e in zip(starts, ends, strict=True)] == ["a", "b", "c", "dé", "é"]
    assert at.tolist() == [0, 1, 3, 5]
