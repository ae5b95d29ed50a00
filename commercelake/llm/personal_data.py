"""Personal data by a skip-chain conditional random field over base patterns.

Base patterns find emails, addresses, cards and phones. Words that hold a digit or an @, and words
that repeat one of a found span, are the nodes of a field with labels other, email, ip, card and
phone. Neighbours in the text share chain potentials; equal words, and words with the same last
DIGITS digits, share skip potentials with their previous occurrence. Loopy messages run until they settle
over each document, ROUNDS times at most. Words with a marginal of SURE or more for a kind, outside all base spans,
become spans of that kind. Texts without digit and @ have no nodes and need no inference.

The word weights are a softmax regression, and the chain potentials are counts, both from base
spans in a sample of at most about MAX_TRAIN documents, chosen by hash. Base spans always stay.

Null, empty and blank texts have no spans. Repeated rows are handled one by one. Empty tables give
a model without weights, which adds nothing, and an empty result; other columns are ignored.
Spans are code points, end exclusive.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MAX_TRAIN = 4000
#: Rounds of messages at most, and the change below which they have settled. Evidence moves one
#: link a round, so in all but the longest chains of repeats it is the change that ends them.
ROUNDS = 200
SETTLED = 1e-7
#: Hashes by which documents are drawn.
SPACE = 1 << 62
SURE = 0.9
SKIP = 2.0
DIGITS = 7

# The base patterns.
LOCAL = string.ascii_letters + string.digits + "._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Only where digits begin: from a later one of them the pattern would go on in the same way.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?()[]{}<>\"'"
_MARKED = re.compile(r"[0-9@]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _runs(pattern: re.Pattern, text: str, sign: str) -> Iterator[re.Match]:
    """The pattern's matches; a text without its sign has none."""
    return pattern.finditer(text) if sign in text else iter(())


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of LOCAL characters, @ and DOMAIN.

    A match has one @, so each is looked at once, back to the last match or @ and on through the domain.
    """
    done, at = 0, text.find("@")
    while at >= 0:
        ahead = text[done:at]
        local = len(ahead) - len(ahead.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if local else None
        if found:
            yield at - local, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the base patterns, by kind, then start."""
    out = [(0, start, end) for start, end in _emails(text)]
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _runs(IP, text, ".") if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 16:
                digits = m.group().replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    out.append((2, m.start(), m.end()))
        out += [(3, m.start(), m.end()) for m in _runs(PHONE, text, "+") if 8 <= len(_DIGIT.findall(m.group())) <= 15]
    return out


def _features(word: str, before: str, after: str) -> list[float]:
    digits = len(_DIGIT.findall(word))
    letters = sum(c.isalpha() for c in word)
    return [
        1.0,
        float("@" in word),
        float("@" in word and "." in word.split("@")[-1]),
        float(digits == 0),
        float(1 <= digits <= 3),
        float(4 <= digits <= 9),
        float(10 <= digits <= 15),
        float(16 <= digits <= 19),
        float(digits > 19),
        float(letters > 0),
        float(digits > 0 and letters > 0),
        float(word.count(".") == 3 and letters == 0),
        float(word.startswith("+")),
        float("-" in word and letters == 0),
        float("=" in word),
        float(before.startswith("+")),
        float(before.startswith("(") and before.endswith(")")),
        float(len(_DIGIT.findall(before)) >= 3),
        float(len(_DIGIT.findall(after)) >= 3),
        float(digits > 0 and letters == 0),
    ]


N_FEATURES = len(_features("", "", ""))


@dataclass
class Graph:
    """Nodes of a text: trimmed words with their spans, features and links."""

    spans: list[tuple[int, int]]
    features: np.ndarray
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def graph_of(text: str, base: list[tuple[int, int, int]]) -> Graph | None:
    """The nodes of a text; none if no word has a digit or an @."""
    words = list(_WORD.finditer(text)) if _MARKED.search(text) else []
    if not words:
        return None
    known = {w for _, s, e in base for w in _WORD.findall(text[s:e])}
    nodes = [i for i, m in enumerate(words) if _MARKED.search(m.group()) or m.group().strip(_EDGES) in known]
    spans, rows, chain, skip = [], [], [], []
    last: dict[str, int] = {}
    for n, i in enumerate(nodes):
        m = words[i]
        raw = m.group()
        word = raw.strip(_EDGES) or raw
        start = m.start() + raw.index(word)
        spans.append((start, start + len(word)))
        rows.append(_features(raw, words[i - 1].group() if i else "", words[i + 1].group() if i + 1 < len(words) else ""))
        if n and nodes[n - 1] == i - 1:
            chain.append((n - 1, n))
        digits = "".join(_DIGIT.findall(word))
        for name in {word.lower(), "#" + digits[-DIGITS:] if len(digits) >= DIGITS else word.lower()}:
            if name in last:
                skip.append((last[name], n))
            last[name] = n
    return Graph(spans, np.array(rows), chain, skip)


def _labels(graph: Graph, base: list[tuple[int, int, int]]) -> np.ndarray:
    out = np.zeros(len(graph.spans), np.int64)
    ordered = sorted(base, key=lambda b: b[1])
    starts = np.array([b[1] for b in ordered], np.int64)
    for i, (s, e) in enumerate(graph.spans):
        j = int(np.searchsorted(starts, e)) - 1
        if j >= 0 and ordered[j][2] > s:
            out[i] = ordered[j][0] + 1
    return out


@dataclass
class Field:
    """Weights of words by label, and potentials of neighbours."""

    weights: np.ndarray
    chain: np.ndarray

    def marginals(self, graph: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Label probabilities of each node after loopy message passing."""
        unary = graph.features @ self.weights.T
        n, k = unary.shape
        skip = SKIP * (np.eye(k) - np.eye(k)[0][:, None] * np.eye(k)[0])
        edges = [*graph.chain, *graph.skip]
        if not edges:
            return _softmax(unary)
        a, b = np.array(edges).T
        kinds = np.array([0] * len(graph.chain) + [1] * len(graph.skip))
        both = np.stack([self.chain, skip])[kinds]
        # Messages over each edge both ways, as logs.
        source, target = np.concatenate([a, b]), np.concatenate([b, a])
        potential = np.concatenate([both, both.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
        message = np.zeros((len(source), k))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, target, message)
            x = (belief[source] - message[back])[:, :, None] + potential
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            before, message = message, 0.5 * message + 0.5 * (new - new.max(axis=1, keepdims=True))
            if np.abs(message - before).max() < SETTLED:
                break
        belief = unary.copy()
        np.add.at(belief, target, message)
        return _softmax(belief)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def threshold(most: int, rows: int) -> int:
    """The hashes modulo SPACE below which about `most` of the rows fall; above 0 at any size."""
    return SPACE * min(most, max(1, rows)) // max(1, rows)


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Field | None:
    """Weights from the base spans of at most about max_train documents with digits or an @."""
    marked = docs.select("doc_id", F.col("text").cast("string")).where(F.rlike("text", F.lit("[0-9@]")))
    picked = marked.where(F.pmod(F.xxhash64("doc_id"), F.lit(SPACE)) < threshold(max_train, marked.count())).select("text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal feature vectors with equal labels are counted; pairs of neighbours too."""
        seen: dict[tuple, int] = {}
        for b in batches:
            for text in b.column(0).to_pylist():
                base = base_spans(text or "")
                graph = graph_of(text or "", base)
                if graph is None:
                    continue
                y = _labels(graph, base).tolist()
                for x, label in zip(graph.features.tolist(), y, strict=True):
                    seen[(0, label, *x)] = seen.get((0, label, *x), 0) + 1
                for i, j in graph.chain:
                    seen[(1, y[i], y[j])] = seen.get((1, y[i], y[j]), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([list(map(float, s)) for s in seen], pa.list_(pa.float64())), pa.array(list(seen.values()), pa.int64())], names=["what", "n"])

    found = picked.mapInArrow(count, "what array<double>, n bigint").groupBy("what").agg(F.sum("n").alias("n")).collect()
    k = len(KINDS) + 1
    pairs = np.ones((k, k))
    for r in found:
        if r["what"][0] == 1:
            pairs[int(r["what"][1]), int(r["what"][2])] += r["n"]
    # Sorted, so that a model does not depend on the order in which tasks end.
    words = sorted((list(r["what"]), r["n"]) for r in found if r["what"][0] == 0)
    if not words:
        return None
    x = np.array([w[2:] for w, _ in words])
    y = np.array([int(w[1]) for w, _ in words])
    n = np.array([c for _, c in words], float)
    weights, rate = np.zeros((k, x.shape[1])), 1.0
    for _ in range(400):
        p = _softmax(x @ weights.T)
        p[np.arange(len(y)), y] -= 1
        weights -= rate * ((p * n[:, None]).T @ x / n.sum() + 1e-4 * weights)
    joint = pairs / pairs.sum()
    chain = np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
    return Field(weights, np.clip(chain, -3, 3))


def spans_of(text: str, field: Field | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, each by kind, then start."""
    base = base_spans(text)
    graph = graph_of(text, base) if field is not None else None
    if graph is None:
        return base, base
    free = _labels(graph, base) == 0
    if not free.any():
        return base, base
    p = field.marginals(graph)
    kind = p.argmax(axis=1)
    take = free & (kind > 0) & (p.max(axis=1) >= SURE)
    return base, sorted(base + [(int(kind[i]) - 1, *graph.spans[i]) for i in np.flatnonzero(take)])


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """doc_id and spans (kind, start, end, base) of every row, by kind as in KINDS, then start."""
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                base, whole = spans_of(text or "", field)
                own = set(base)
                out.append([{"kind": k, "start": s, "end": e, "base": (k, s, e) in own} for k, s, e in whole])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, kind)], names=["doc_id", "spans"])

    of = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {of}, spans array<struct<kind:int,start:bigint,end:bigint,base:boolean>>")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, the numbers of base spans by kind, base_sha256 and spans as one string."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


