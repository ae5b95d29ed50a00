"""Rounds of the components, and searches over many near copies."""

import numpy as np

from commercelake.llm import components
from commercelake.llm.jaccard_join import InvertedIndex


def test_links_that_a_task_can_join_take_no_round(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(components, "cut_lineage", lambda df, old=components.cut_lineage: cuts.append(1) or old(df))
    path = [(i, i + 1) for i in range(50)] + [(200 - i, 100) for i in range(50)] + [(7, 7)]
    links = spark.createDataFrame(path, "a bigint, b bigint").coalesce(1)
    found = {r["node"]: r["label"] for r in components.connected(links).collect()}
    assert found == {i: 0 for i in range(51)} | {i: 100 for i in [100, *range(151, 201)]}
    assert len(cuts) == 1


def test_links_over_several_tasks_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(components, "CHUNK", 3)
    rng = np.random.default_rng(3)
    pairs = rng.integers(-60, 60, (70, 2)).tolist()
    want = {x: x for p in pairs if p[0] != p[1] for x in p}
    for _ in pairs:
        for a, b in pairs:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    links = spark.createDataFrame(pairs, "a bigint, b bigint").repartition(5)
    rows = components.connected(links).collect()
    assert {r["node"]: r["label"] for r in rows} == want and len(rows) == len(want)


def test_candidates_of_a_search_are_judged_together():
    rng = np.random.default_rng(4)
    base = rng.permutation(5000)[:200]
    sets = [np.unique(np.append(rng.permutation(base)[: rng.integers(150, 200)], rng.integers(5000, 9000, 10))).astype(np.uint64) for _ in range(400)]
    index, left_out = InvertedIndex(sets), set(range(0, 400, 3))
    for query in sets[:20]:
        calls = []
        found = list(index.search(query, lambda them, calls=calls: calls.append(them) or np.isin(them, list(left_out))))
        brute = {i for i, s in enumerate(sets) if 100 * len(np.intersect1d(s, query)) >= 80 * len(np.union1d(s, query))}
        assert set(found) == brute - left_out and len(found) == len(set(found))
        assert len(calls) == 1 and brute <= set(calls[0].tolist())
