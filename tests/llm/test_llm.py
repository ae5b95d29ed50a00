"""The training-data operators against plain loops, on small tables with awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from commercelake.llm import exact_dedup, jaccard_join, licenses, main_text, mixing, packing, personal_data, quality, token_index, toxicity
from commercelake.llm.components import connected
from commercelake.llm.queries import ORACLES, QUERIES, vocabulary
from commercelake.session import shared_path, ship_package

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Names that operators use inside.
CLASHES = ("k", "n", "run", "range", "copy", "label", "_key", "_id", "_norm", "part", "size", "_salt", "tokens", "_group")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)


def rows():
    rng = random.Random(5)
    vocabulary_ = [a + b for a in ("ka", "ri", "to", "Ma") for b in ("l", "nd", "s", "ü", "rt", "p")]
    base = [" ".join(rng.choice(vocabulary_) for _ in range(120)) for _ in range(6)]
    out = [
        (1, None, None, None),
        (2, "", "en", None),
        (3, " \n\t ", "en", "a"),
        (4, "One two", "en", "a"),
        (5, "one TWO", None, "b"),
        (6, "straße É one two three", "de", "b"),
        (7, base[0], "en", "a"),
        (8, base[0].upper(), "en", "a"),
        (8, base[0].upper(), "en", "a"),
        (9, base[0] + " tail", "en", "c"),
        (10, " ".join(base[0].split()[3:]), "en", "c"),
        (11, base[1] + "\n" + base[1], "fr", "c"),
        (12, " ".join(rng.choice(vocabulary_) for _ in range(9000)), "en", "a"),
        (13, base[2] + " mail me@site.example.com or +1 (988) 555-2485 from 42.144.35.254 ok", "en", "b"),
        (None, base[0], "en", "a"),
        (14, "x" * 5000, "en", "b"),
    ]
    out += [(20 + i, base[3], "en", "a") for i in range(6)]
    for i in range(12):
        words = base[4].split()
        words[i * 9] = f"new{i}"
        out.append((40 + i, " ".join(words), "en", "b"))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    ship_package(spark)
    return spark.createDataFrame([(*r, len(r[1] or "")) + ("x",) * len(CLASHES) for r in rows()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def records(df):
    return [r.asDict() for r in df.collect()]


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return set(zip(*[w[i:] for i in range(5)], strict=False)) if len(w) >= 5 else ({tuple(w)} if w else set())


def components(pairs):
    """doc_id to least doc_id reachable, by comparing all texts."""
    nodes = [(i, shingles(t)) for i, t in pairs if i is not None]
    root = {i: i for i, _ in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(nodes):
        for j, t in nodes[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in nodes}


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 20] + [(7, 3), (50, 50)], "a bigint, b bigint")
    assert {r["node"]: r["label"] for r in connected(links).collect()} == {i: 0 if i <= 20 else 21 for i in range(41)}


@pytest.mark.parametrize("block", [2_000_000, 300])
def test_jaccard_join(docs, block):
    want = components([r[:2] for r in rows()])
    found = records(jaccard_join.near_duplicates(docs, block))
    assert len(found) == len(rows())
    assert sorted((r["doc_id"] or 0, r["n_shingles"]) for r in found) == sorted((r[0] or 0, len(shingles(r[1]))) for r in rows())
    assert all(r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None) for r in found)


def test_jaccard_join_many_near_copies(spark):
    """Near copies around the threshold, many of which link with others but not with the pivot."""
    rng = random.Random(3)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        texts.append((i, " ".join(words)))
    found = jaccard_join.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string"), 700).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == components(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sets(st.integers(0, 30), min_size=1, max_size=25), min_size=1, max_size=12), st.sets(st.integers(0, 30), min_size=1, max_size=25))
def test_divide_skip(sets, query):
    index = jaccard_join.InvertedIndex([np.array(sorted(s), np.uint64) for s in sets])
    found = set(index.search(np.array(sorted(query), np.uint64), lambda _: False))
    assert found == {i for i, s in enumerate(sets) if 100 * len(s & query) >= 80 * len(s | query)}


@pytest.mark.parametrize("ranges", [1, 7])
def test_exact_dedup(docs, ranges):
    groups = defaultdict(list)
    for i, t, *_ in rows():
        groups[(t or "").translate(LOWER)].append(i)
    for keep, best in (("largest", max), ("smallest", min)):
        found = records(exact_dedup.exact_dedup(docs, keep, ranges))
        assert len(found) == len(rows())
        by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
        for r in found:
            ids = by_sha[r["text_sha256"]]
            keep_id = best(i for i in ids if i is not None)
            assert r["doc_id"] in ids and (r["keep_id"], r["group_size"]) == (keep_id, len(ids))
            assert r["kept"] == (r["doc_id"] == keep_id)


def test_jaccard_join_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op1_ngram_jaccard_join"]).fetchall()
    found = QUERIES["op1_ngram_jaccard_join"](spark, SF).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, found)) == sorted(want)
    assert any(component < doc_id for doc_id, _, component in want)


def test_exact_dedup_against_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(ORACLES["op2_exact_dedup"]).fetchall()
    found = QUERIES["op2_exact_dedup"](spark, SF).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
    assert sorted(map(tuple, found)) == sorted(want)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


AWKWARD = ["don't <|endoftext|> STOP", "é ́x É ß  12,5%", "ΑΣ ΒΓ İ ﬁ", "", "日本語テキスト a b", "😀👍🏽 #x"]


def test_words_encode_as_texts(tokenizer):
    import pyarrow as pa

    from commercelake.llm.tokens import Encoder

    texts = AWKWARD + [r[1] or "" for r in rows()]
    ids, at = Encoder(vocabulary()).encode(pa.array(texts))
    assert [ids[a:z].tolist() for a, z in zip(at, at[1:], strict=False)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("shard_ids", [1 << 20, 50])
def test_token_index(spark, docs, tokenizer, shard_ids):
    path = shared_path(spark, "test-index")
    token_index.write_index(docs, path, vocabulary(), 1, shard_ids, 3)
    found = sorted(token_index.records(spark, path).collect(), key=lambda r: (r["start"]))
    ids = defaultdict(list)
    for i, t, *_ in rows():
        ids[i].append(zlib.crc32(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()))
    assert [r["doc_id"] for r in found] == sorted((r[0] for r in rows()), key=lambda i: (i is not None, i))
    at = 0
    for r in found:
        assert r["start"] == at and r["ids_crc32"] in ids[r["doc_id"]]
        at += r["n_tokens"]
    asked = spark.createDataFrame([(7,), (9,), (999,), (None,)], "doc_id bigint")
    got = {r["doc_id"]: r["ids"] for r in token_index.lookup(spark, path, asked).collect()}
    assert set(got) == {7, 9}
    assert got[9] == tokenizer.encode(dict(r[:2] for r in rows())[9], add_special_tokens=False).ids + [1]


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(2**62), 2**62, 5000))
    levels, bits, slots = token_index.build_index(keys.view(np.uint64), np.arange(len(keys), dtype=np.uint32))
    assert sorted(slots[:, 1]) == list(range(len(keys)))
    shard = token_index.Shard(keys, 0, np.arange(len(keys) + 1), np.arange(len(keys)), levels, bits, slots)
    assert (shard.records(keys) == np.arange(len(keys))).all()
    assert (shard.records(keys + 2**62) >= 0).mean() < 0.01


def test_mixing(docs):
    found = records(mixing.mix_counts(docs))
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows()}
    assert len(found) == len(rows()) and all(r["size"] == size[r["doc_id"]] for r in found)
    assert all(r["taken"] <= 2 * r["size"] and r["taken"] == r["epochs"] * r["size"] for r in found)
    by = defaultdict(list)
    for r in found:
        by[r["source"]].append(r)
    sizes = {s: sum(r["size"] for r in rs) for s, rs in by.items()}
    assert all(r["source_size"] == sizes[r["source"]] for r in found)
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    # Capped sources are taken out one round after the other.
    target, open_, budget = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = budget / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in over:
            target[s] = 2 * sizes[s]
        open_, budget = open_ - over, budget - sum(target[s] for s in over)
    for s, rs in by.items():
        assert rs[0]["target"] == pytest.approx(target[s])
        assert abs(sum(r["taken"] for r in rs) - target[s]) <= max(r["size"] for r in rs) / 2 + 1
    assert sorted(map(str, records(mixing.mix_counts(docs.repartition(5))))) == sorted(map(str, found))


@pytest.mark.parametrize("weight", ["0.01 + 0.99 * (id % 2)", "1 / (1 + id % 97)", "pow(2, id % 30)", "1"])
def test_mixing_buckets_are_even(spark, weight):
    """No bucket holds much more than twice its share, and buckets ascend with the key."""
    drawn = spark.range(100_000).selectExpr("id", f"cast({weight} as double) AS w")
    drawn = drawn.selectExpr("w", "-ln((pmod(xxhash64(id), 1000003) + 0.5) / 1000003) / w AS key")
    octaves = {r["o"]: r["count"] for r in drawn.groupBy(F.floor(F.log2("w")).cast("int").alias("o")).count().collect()}
    placed = drawn.select("key", mixing.bucket_of(F.col("key"), octaves, 100).alias("b")).toPandas().sort_values("key")
    assert placed["b"].is_monotonic_increasing and placed["b"].between(0, 99).all()
    assert placed["b"].value_counts().max() < 2.3 * 1000


@pytest.mark.parametrize("value", [None, float("nan"), float("inf"), -1.0, 0.0])
def test_mixing_odd_weights(docs, value):
    weighted = docs.withColumn("w", F.lit(value).cast("double"))
    found = records(mixing.mix_counts(weighted, weight="w"))
    assert len(found) == len(rows()) and all(r["taken"] <= 2 * r["size"] for r in found)


def statistics(text):
    w = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = defaultdict(list)
    for i in range(len(w) - 2):
        grams[tuple(w[i : i + 3])].append(i)
    again = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_statistics(docs):
    found = records(quality.verdicts(docs, min_group=4))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = sorted((r[0] or 0, *statistics(r[1])) for r in rows())
    assert sorted((r["doc_id"] or 0, *[r[n] for n in names]) for r in found) == want
    assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) for r in found)
    assert not any(r["kept"] and r["base_failed"] for r in found)


def test_quality_rejects_outliers_only(spark):
    rng = random.Random(2)
    words = [a + b for a in ("ka", "ri", "to", "sen") for b in ("l", "nd", "s", "ver")]
    texts = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(300)]
    texts += [(1000 + i, " ".join(rng.choice(words) + "###" for _ in range(200))) for i in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = quality.verdicts(df).select("doc_id", "kept", "distance").collect()
    assert all(r["kept"] == (r["doc_id"] < 1000) for r in found)
    # The same distances as a plain loop of concentration steps on all vectors.
    x = np.array([[np.log(s[1] / s[0]), np.log1p(1000 * s[2] / s[0]), 0.0, np.sqrt(s[4] / s[0])] for s in (statistics(t) for _, t in texts)])
    ridge = np.diag(np.square(quality.FLOORS))

    def model(rows_):
        return rows_.mean(0), np.linalg.inv(np.cov(rows_.T, bias=True) + ridge)

    m, inverse = model(x)
    for _ in range(quality.STEPS):
        d = np.einsum("ij,jk,ik->i", x - m, inverse, x - m)
        bins = np.floor(np.log(d + 1e-6) * quality.BINS_PER_E)
        m, inverse = model(x[bins <= np.sort(bins)[(len(x) + 1) // 2 - 1]])
    d = np.einsum("ij,jk,ik->i", x - m, inverse, x - m)
    assert [r["distance"] for r in sorted(found, key=lambda r: r["doc_id"])] == pytest.approx(d.tolist(), rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("kind", ["lines", "words", "symbols"])
def test_quality_each_statistic_rejects(spark, kind):
    rng = random.Random(3)
    words = [a + b + c for a in ("ka", "ri", "to", "sen") for b in ("l", "nd", "s", "ver") for c in ("a", "e", "in", "o", "ul", "ir")]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    page = lambda n: "\n".join(" ".join(some(20)) for _ in range(n))
    texts = [(i, page(rng.randint(3, 40))) for i in range(400)]
    # A clean text with one line twice stays.
    texts += [(500, f"{page(9)}\nend\n{page(9)}\nend")]
    phrase = " ".join(some(9))
    odd = {
        "lines": "\n".join(f"{rng.choice(words[:12])}" for _ in range(300)),
        "words": page(6) + f" {phrase} " + " ".join(some(20)) + (f" {phrase}" * 9),
        "symbols": " ".join(w + "&" for w in some(400)),
    }[kind]
    stats = statistics(odd)
    assert stats[0] >= 50 and stats[4] <= 0.5 * stats[0]
    texts += [(1000, odd)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert [r["doc_id"] for r in quality.verdicts(df).where("not kept").collect()] == [1000]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=25))
def test_pack(sizes):
    windows = packing.pack(sizes, 40)
    assert sorted(i for w in windows for i in w) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in w) <= 40 for w in windows)


def test_karmarkar_karp_balances():
    sizes = [random.Random(1).randrange(1, 1000) for _ in range(200)]
    sums = [sum(sizes[i] for i in w) for w in packing.karmarkar_karp(sizes, 20)]
    assert sum(sums) == sum(sizes) and max(sums) - min(sums) <= 5


def test_packing(docs, tokenizer):
    found = records(packing.packed(docs, vocabulary()))
    texts = defaultdict(list)
    for i, t, *_ in rows():
        texts[i].append(np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4"))
    by = defaultdict(list)
    for r in found:
        by[r["copy"]].append(r)
    assert Counter(v[0]["doc_id"] for v in by.values()) == Counter(r[0] for r in rows())
    for pieces in by.values():
        pieces.sort(key=lambda r: r["start"])
        ids = next(x for x in texts[pieces[0]["doc_id"]] if len(x) == pieces[0]["doc_tokens"] and zlib.crc32(x[: pieces[0]["length"]].tobytes()) == pieces[0]["ids_crc32"])
        at = 0
        for p in pieces:
            assert p["start"] == at and p["ids_crc32"] == zlib.crc32(ids[at : at + p["length"]].tobytes())
            at += p["length"]
        assert at == len(ids)
    windows = defaultdict(list)
    for r in found:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for w in windows.values():
        at = 0
        for offset, length in sorted(w):
            assert offset == at
            at += length
        assert at <= 4096


def brute_segments(scores):
    """All maximal segments by the recursive definition: the best one, then both sides."""
    if not len(scores):
        return []
    best = max(((sum(scores[a:z]), a - z, a, z) for a in range(len(scores)) for z in range(a + 1, len(scores) + 1)), key=lambda x: (x[0], x[1]))
    if best[0] <= 0:
        return []
    _, _, a, z = best
    return brute_segments(scores[:a]) + [(a, z - 1)] + [(x + z, y + z) for x, y in brute_segments(scores[z:])]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 1.3, 2.7, 4.1]), max_size=25))
def test_maximal_segments(odds):
    scores = [x if x > 0 else -0.5 for x in odds]
    places = [i for i, x in enumerate(odds) if x > 0]
    found = toxicity.maximal_segments(places, [odds[i] for i in places])
    assert sum(s for *_, s in found) == pytest.approx(sum(sum(scores[a : z + 1]) for a, z in brute_segments(scores)))


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = QUERIES["op4_toxicity"](spark, folder).join(labels, "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["toxic"] for r in found) >= 0.97 * len(found)


@pytest.mark.parametrize("size", [20, 600])
def test_toxicity_rate_follows_the_words_of_clean_texts(spark, size):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choice(["kal", "rin", "tos", "sen"]) for _ in range(size)) + (" zuvex zuvex" if i % 2 or i % 20 == 0 else ""), i % 2) for i in range(400)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string, label int")
    model = toxicity.fit(df, df.select("doc_id", "label"))
    assert len(model.odds) == 3
    clean = [t.split() for _, t, toxic in texts if not toxic]
    share = (sum(t.count("zuvex") for t in clean) + 0.5) / sum(map(len, clean))
    assert model.rate == pytest.approx(toxicity._rate(model.odds, np.full(3, share)))


def test_toxicity_edges(spark, docs, empty):
    model = toxicity.fit(docs, docs.select("doc_id", F.lit(0).alias("label")))
    found = toxicity.score(docs, model).collect()
    assert len(found) == len(rows()) and all(0 <= r["score"] < 0.01 for r in found)
    # Copies count once in the fit, so every text has a word of its own.
    texts = {i: f"u{i} " + ("aa bb cc vile " * 5 if i % 2 else "aa bb cc dd " * 5) for i in range(60)}
    toxic = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    model = toxicity.fit(toxic, toxic.select("doc_id", (F.col("doc_id") % 2).alias("label")))
    for r in toxicity.score(toxic, model).collect():
        assert (r["score"] > 0.5) == (r["doc_id"] % 2 == 1)
        for s in r["segments"]:
            assert "vile" in texts[r["doc_id"]][s["start"] : s["end"]]


def test_personal_data(spark, docs):
    text = dict(r[:2] for r in rows())[13]
    want = [(0, "me@site.example.com"), (1, "42.144.35.254"), (3, "+1 (988) 555-2485")]
    assert [(k, text[s:e]) for k, s, e in personal_data.base_spans(text)] == want
    found = {r["doc_id"]: r for r in personal_data.digest(personal_data.find(docs, personal_data.fit(docs))).collect()}
    spans = ",".join(f"{personal_data.KINDS[k]}:{s}:{e}" for k, s, e in personal_data.base_spans(text))
    assert found[13]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    assert (found[13]["n_email"], found[13]["n_ip"], found[13]["n_card"], found[13]["n_phone"]) == (1, 1, 0, 1)
    assert set(spans.split(",")) <= set(found[13]["spans"].split(","))
    assert found[1]["spans"] == "" and found[1]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert personal_data.base_spans("300.1.1.1 4111 1111 1111 1112 +12 34") == []
    assert [k for k, *_ in personal_data.base_spans("4111 1111 1111 1111")] == [2]


def test_marginals_are_exact_on_a_chain():
    rng = np.random.default_rng(3)
    field = personal_data.Field(rng.normal(size=(5, 2)), rng.normal(size=(5, 5)))
    graph = personal_data.Graph([(0, 1)] * 3, rng.normal(size=(3, 2)), [(0, 1), (1, 2)], [])
    unary = graph.features @ field.weights.T
    joint = np.exp(unary[0][:, None, None] + unary[1][None, :, None] + unary[2][None, None, :] + field.chain[:, :, None] + field.chain[None])
    want = np.stack([joint.sum((1, 2)), joint.sum((0, 2)), joint.sum((0, 1))]) / joint.sum()
    assert np.allclose(field.marginals(graph, 60), want, atol=1e-6)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/a">Home of the</a></li></ul></nav>
<div class="cookie-notice">We use the cookies of this site to be as good as it is in all that we do for you and them.</div>
<article><h1>A &amp; B</h1><p>The <b>first</b> of the words &lt;is&gt; in it, and   that was
for the one with this.<p>Short.</article><div class="comments"><p>This is the comment of a reader to the article and it is long.</p></div>
<form>Your name <input></form><footer>&copy; all of it</footer><script>var a="<p>";</script></body></html>"""


def test_main_text(spark):
    ship_package(spark)
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<p>broken <b", "x")], "page_id bigint, url string, html string, text string")
    found = {r["page_id"]: r["text"] for r in main_text.extract(df).collect()}
    assert found[1] == "A & B\nThe first of the words <is> in it, and that was for the one with this.\nShort."
    assert found[2] == "" and found[3] == ""
    assert main_text.extract(df.limit(0)).count() == 0


LONG = "This is a text of the words that are in it and for the one with this, as it was to be in the end. "


def test_main_text_short_blocks_in_an_article_follow_their_neighbours():
    links = "<p><a href='/a'>Other news of the day</a></p>"
    page = f"<nav><a>n</a></nav><div id=content><h1>Title</h1><p>{LONG}</p><p>He said no.</p><p>{LONG}</p>{links}<p>Share this</p>{links}<p>Read more</p></div><footer>f</footer>"
    assert main_text.main_text(page).split("\n") == ["Title", LONG.strip(), "He said no.", LONG.strip()]
    verse = "".join(f"<p>Line {i} of short verse</p>" for i in range(12))
    assert main_text.main_text(f"<article>{links}{verse}{links}</article>").count("verse") == 12
    assert main_text.main_text(f"<article>{links}<p>Share this</p>{links}</article>") == ""
    assert main_text.main_text("<nav>n</nav><article><p>Short.</p></article><footer>f</footer>") == "Short."


def test_main_text_of_other_languages():
    text = "Nel mezzo cammin nostra vita ritrovai una selva oscura ché diritta via era smarrita quanto dir qual cosa dura questa selva selvaggia aspra forte nel pensier rinova paura tant amara poco più morte trattar ben vidi trovai"
    assert main_text.main_text(f"<nav>a b</nav><div><p>{text}</p></div><footer>c</footer>") == text
    medium = "Ritrovai una selva oscura ché diritta via era smarrita quanto dir qual cosa dura"
    assert main_text.main_text(f"<nav>a b</nav><div><p>{medium}</p><p>{text}</p></div><footer>c</footer>") == f"{medium}\n{text}"
    assert main_text.main_text(f"<div><p><a>{text}</a></p></div>") == ""


def test_main_text_of_short_paragraphs_without_decided_neighbours():
    short = [f"Line {i} is short." for i in range(3)]
    for page in ("<nav><a>n</a></nav>{}<footer>f</footer>", "{}"):
        for tag in ("p", "div"):
            assert main_text.main_text(page.format("".join(f"<{tag}>{x}</{tag}>" for x in short))).split("\n") == short


@pytest.mark.parametrize("name", ["has-sidebar", "no-sidebar", "with-header", "page header-wrap"])
def test_main_text_of_wrapper_names(name):
    page = f"<div class='{name}'><div class=sidebar><p>{LONG}</p></div><article><p>{LONG}</p></article></div>"
    assert main_text.main_text(page) == LONG.strip()
    assert main_text.main_text(f"<main><p>{LONG}</p><div class=comments><article><p>A reader: {LONG}</p></article></div></main>") == LONG.strip()


def test_license_scan(docs, spark):
    noise = "tokens of a text that comes before "
    grant = licenses.TEMPLATES["mit-grant"].replace("sublicense,", "sub-license,").replace("deal in", "deal freely in")
    df = spark.createDataFrame([(1, noise + grant + " end"), (2, noise + "LICENSED under the Apache License, Version 2.0!"), (3, None), (4, "")], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in licenses.scan(df).collect()}
    assert set(found) == {1, 2} and found[1]["license"] == "mit-grant" and 0.95 < found[1]["coverage"] < 1
    assert (noise + grant)[found[1]["start"] : found[1]["end"]] == grant
    assert found[2]["start"] == len(noise) and found[2]["coverage"] == 1
    assert licenses.scan(docs).count() == 0


def test_license_scan_whole_texts(spark):
    names = ["mit", "mit-0", "isc", "0bsd", "bsd-2-clause", "bsd-3-clause", "unlicense", "zlib", "apache-2.0", "gpl-2.0", "gpl-3.0", "mpl-2.0", "cc0-1.0", "agpl-3.0-notice", "epl-2.0-notice"]
    before = "Copyright (c) 2020 Someone\n\n"
    texts = [(i, before + licenses.TEMPLATES[n] + "\nmore text") for i, n in enumerate(names)]
    # Some words more and others changed; two copies; a variant or version that is no template.
    changed = licenses.TEMPLATES["mit"].replace("The above copyright", "The very above copyright").replace("AUTHORS OR COPYRIGHT HOLDERS", "OWNERS OF IT")
    texts += [(100, before + changed), (101, licenses.TEMPLATES["mit"] + "\n\n" + licenses.TEMPLATES["mit"])]
    texts += [(200, "This work is licensed under the GNU General Public License, version 2."), (201, "Released under the BSD License."), (202, "Licensed under CC BY-ND 4.0."), (203, "This work is licensed under the GNU Lesser General Public License, version 3.")]
    found = defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(texts, "doc_id bigint, text string")).collect():
        found[r["doc_id"]].append(r)
    for i, n in enumerate(names):
        (r,) = found[i]
        assert r["license"] == n and r["coverage"] == 1 and r["start"] == len(before), n
        assert licenses.TEMPLATES[n].strip()[: r["end"] - r["start"]].split()[-20:] == licenses.TEMPLATES[n].split()[-20:] or r["end"] >= len(texts[i][1]) - 15
    assert [r["license"] for r in found[100]] == ["mit"] and 0.9 < found[100][0]["coverage"] < 1 and found[100][0]["start"] == len(before)
    assert [r["license"] for r in found[101]] == ["mit", "mit"]
    assert not any(found[i] for i in range(200, 204))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=8), st.lists(st.integers(0, 4), max_size=10))
def test_alignment_of_long_templates(template, text):
    m, first, last = licenses.align_long(np.array(template), np.array(text, np.int64), 0, 12)
    assert m == licenses.align(template, text, 0, 12)[0]
    assert m == 0 or text[first] in template and text[last] in template and last - first + 1 >= m


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), min_size=1, max_size=8), st.lists(st.integers(0, 4), max_size=10))
def test_alignment(template, text):
    best = [[0] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i, w in enumerate(template):
        for j, x in enumerate(text):
            best[i + 1][j + 1] = best[i][j] + 1 if w == x else max(best[i][j + 1], best[i + 1][j])
    assert licenses.align(template, text, 0, 12)[0] == best[-1][-1]


def test_empty_tables(spark, empty, docs):
    path = shared_path(spark, "test-empty")
    token_index.write_index(empty, path, vocabulary())
    model = toxicity.fit(empty, empty.select("doc_id", F.lit(1).alias("label")))
    for df in (
        jaccard_join.near_duplicates(empty),
        exact_dedup.exact_dedup(empty),
        token_index.records(spark, path),
        toxicity.score(empty, model),
        quality.verdicts(empty),
        mixing.mix_counts(empty),
        licenses.scan(empty),
        packing.packed(empty, vocabulary()),
        personal_data.digest(personal_data.find(empty, personal_data.fit(empty))),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, docs, empty):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    kept, stages = docs, [f for _, f in corpus_pipeline.STAGES]
    want = {r[0] for r in rows() if r[0] is not None and not (statistics(r[1])[0] < 50 or 100 * statistics(r[1])[4] > 50 * statistics(r[1])[0])}
    kept = stages[0](spark, kept, SF)
    assert tuple(kept.columns) == corpus_pipeline.COLUMNS and {r["doc_id"] for r in kept.collect()} == want
    kept = stages[1](spark, kept, SF)
    texts = dict(r[:2] for r in rows())
    first = {}
    for i in sorted(want):
        first.setdefault(texts[i].translate(LOWER), i)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())
    kept = stages[2](spark, kept, SF)
    roots = components([(i, texts[i]) for i in first.values()])
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(roots.values()))
    mixed_ = stages[3](spark, kept, SF)
    times = Counter(r["doc_id"] for r in mixed_.collect())
    assert times == Counter({r["doc_id"]: r["epochs"] for r in mixing.mix_counts(kept).collect() if r["epochs"]})
    assert Counter(r["doc_id"] for r in stages[4](spark, mixed_, SF).where("start = 0").collect()) == times
    for f in stages:
        assert f(spark, empty, SF).count() == 0


def test_pipeline_exact_copies_keeps_texts_that_share_an_identifier(spark):
    texts = [(1, "b x"), (2, "a y"), (2, "B x"), (2, "c z"), (2, "c z"), (2, "C Z")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = sorted((r["doc_id"], r["text"].lower()) for r in corpus_pipeline.exact_copies(spark, df, SF).collect())
    assert found == [(1, "b x"), (2, "a y"), (2, "c z")]


def test_pipeline_runs(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
