"""Toxicity by maximum-scoring segments of token log-odds.

A word has three tokens, A-Z folded: the whole word without punctuation at its end, its first six
and its first four bytes. From labelled texts, copies once, each token gets the log-odds of toxic
against clean texts with an informative Dirichlet prior; those whose z-score passes Z count. A
word scores its best token's log-odds, any other word -DRIFT. The linear scan of all
maximal-scoring segments finds passages; a segment's score S in a text of n words has
E = n exp(-lambda S), with lambda from the clean texts' score distribution, and is significant
if E <= 0.05. The evidence of a text is -ln of the least probability of the sum of its r best
segments, over all r, by the sum statistics of extreme values; it becomes a probability by a
logistic curve fitted to the labelled texts.

The model is fitted on at most about MAX_LABELLED labelled rows, chosen by hash; its size is
bounded by theirs, so it is collected and sent to the tasks.

Null, empty and blank texts have no segments and get the score of no evidence. Rows without a
label, or with labels for unknown texts, do not count in the fit; copies count once there. Without
labels of both kinds the score is the share of toxic labels (0 without any). Empty tables give an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commercelake.llm.words import chunks, text_bytes, word_hashes, word_spans
from commercelake.session import cut_lineage

MAX_LABELLED = 200_000
#: The prior's weight, as a share of the labelled texts that hold a token.
PRIOR = 0.1
Z = 2.5
LEAST_TOXIC = 4
DRIFT = 0.5
SIGNIFICANT_E = 0.05
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_BINS = 80
_EDGE = np.zeros(256, bool)
_EDGE[[ord(c) for c in ".,;:!?)]}\"'#*$%&|"]] = True


def tokens_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The whole, six-byte and four-byte token of each word, as numbers that tell them apart."""
    for _ in range(2 if len(data) else 0):
        ends = ends - ((ends - 1 > starts) & _EDGE[data[np.maximum(ends - 1, 0)]])
    whole = (word_hashes(data, starts, ends, fold=True) | np.uint64(1 << 63)).view(np.int64)
    long_, short = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for k in range(6):
        at = starts + k
        inside = at < ends
        byte = np.where(inside, _FOLD[data[np.minimum(at, len(data) - 1)]], 0).astype(np.int64) if len(data) else long_
        long_ = long_ << 8 | byte
        if k < 4:
            short = short << 8 | byte
    return whole, long_ | 1 << 56, short


@dataclass
class Model:
    """Tokens with their log-odds, lambda and the logistic curve."""

    tokens: np.ndarray
    odds: np.ndarray
    rate: float
    base: float
    slope: float

    def word_scores(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log-odds of each word, 0 where none of its tokens counts."""
        out = np.zeros(len(starts))
        if not len(self.tokens):
            return out
        for found in tokens_of(data, starts, ends):
            at = np.minimum(np.searchsorted(self.tokens, found), len(self.tokens) - 1)
            out = np.where(self.tokens[at] == found, np.maximum(out, self.odds[at]), out)
        return out

    def evidence(self, segments: list[tuple[int, int, float]], n: int) -> tuple[float, list[tuple[int, int, float, float]]]:
        """-ln of the least probability of a sum of segments, and the significant segments with their E."""
        size, best, total, log_r = math.log(max(n, 1)), 0.0, 0.0, 0.0
        for r, s in enumerate(sorted((s for *_, s in segments), reverse=True), 1):
            total, log_r = total + self.rate * s - size, log_r + math.log(r)
            t = total + log_r
            if t > r:
                best = max(best, t - (r - 1) * math.log(t) + 2 * log_r - math.log(r))
        found = ((first, last, s, math.exp(max(-600.0, size - self.rate * s))) for first, last, s in segments)
        return best, [x for x in found if x[3] <= SIGNIFICANT_E]

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * np.log1p(evidence), -30, 30)))


def maximal_segments(places: list[int], scores: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence of -drift except at places.

    One pass over the positive places with a stack of candidates, each with the cumulative
    score before it and at its end.
    """
    stack: list[tuple[int, int, float, float]] = []
    total, at = 0.0, 0
    for i, s in zip(places, scores, strict=True):
        total -= drift * (i - at)
        low, high = total, total + s
        total, at = high, i + 1
        first = i
        while True:
            # The nearest earlier candidate that begins lower; those between cannot grow.
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= low:
                j -= 1
            if j < 0 or stack[j][3] >= high:
                break
            first, low = stack[j][0], stack[j][2]
            del stack[j:]
        stack.append((first, i, low, high))
    return [(first, last, high - low) for first, last, low, high in stack]


def _segments(model: Model, column: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray, np.ndarray]]:
    """Per text: its number of words, segments by word, and code points of word starts and ends."""
    data, offsets = text_bytes(column)
    for a, z in chunks(offsets):
        raw, own = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
        starts, ends, at = word_spans(raw, own)
        odds = model.word_scores(raw, starts, ends)
        positive = np.flatnonzero(odds > 0)
        cuts = np.searchsorted(positive, at)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        for i in range(z - a):
            own_positive = positive[cuts[i] : cuts[i + 1]]
            found = maximal_segments((own_positive - at[i]).tolist(), odds[own_positive].tolist()) if len(own_positive) else []
            w = slice(at[i], at[i + 1])
            yield int(at[i + 1] - at[i]), found, heads[starts[w]] - heads[own[i]], heads[ends[w]] - heads[own[i]]


def _sample(docs: DataFrame, labelled: DataFrame, max_labelled: int) -> DataFrame:
    """text and label of at most about max_labelled rows; their labels are small enough to send to all."""
    labels = labelled.select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label")).where("label is not null")
    share = min(1.0, max_labelled / max(1, labels.count()))
    labels = labels.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    texts = docs.select("doc_id", F.col("text").cast("string"))
    # Of equal texts with one label the first counts; only hashes are shuffled.
    hashed = texts.select("doc_id", F.xxhash64("text").alias("_h")).join(F.broadcast(labels), F.col("doc_id") == F.col("_id"))
    once = cut_lineage(hashed.groupBy("_h", "label").agg(F.min("_id").alias("_id")).select("_id", "label"))
    return texts.join(F.broadcast(once), F.col("doc_id") == F.col("_id")).select("text", "label")


def fit(docs: DataFrame, labelled: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """A model from docs (doc_id, text) and labelled (doc_id, label: 1 toxic, 0 clean)."""
    sample = _sample(docs, labelled, max_labelled)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = text_bytes(b.column(0))
            label = b.column(1).to_numpy(zero_copy_only=False)
            parts = []
            for a, z in chunks(offsets):
                raw, own = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
                starts, ends, at = word_spans(raw, own)
                row = np.repeat(np.arange(z - a), np.diff(at))
                words = tokens_of(raw, starts, ends)
                clean_word = label[a:z][row] != 1
                # Token 0 counts the texts.
                code = np.concatenate([*words, np.zeros(z - a, np.int64)])
                row = np.concatenate([row, row, row, np.arange(z - a)])
                names, back = np.unique(code, return_inverse=True)
                pairs = np.unique(row * len(names) + back)
                toxic = label[a:z][pairs // len(names)] == 1
                which = pairs % len(names)
                # Occurrences in words of clean texts; those of token 0 are all words.
                seen = back[: 3 * len(starts)][np.concatenate([clean_word] * 3)]
                times = np.bincount(seen, minlength=len(names))
                times[np.searchsorted(names, 0)] = clean_word.sum()
                parts.append((names, np.bincount(which[toxic], minlength=len(names)), np.bincount(which[~toxic], minlength=len(names)), times))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts, strict=True)], names=["token", "toxic", "clean", "times"])

    counts = sample.mapInArrow(count, "token bigint, toxic bigint, clean bigint, times bigint").groupBy("token")
    counts = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.sum("times").alias("w"))
    counts = counts.where((F.col("t") >= LEAST_TOXIC) | (F.col("token") == 0)).toPandas()
    texts = counts[counts["token"] == 0]
    n_toxic, n_clean = (int(texts[x].sum()) for x in ("t", "c"))
    share = n_toxic / max(1, n_toxic + n_clean)
    none = Model(np.zeros(0, np.int64), np.zeros(0), 1.0, float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), 0.0)
    if not n_toxic or not n_clean:
        return none
    own = counts[counts["token"] != 0].sort_values("token")
    t, c = own["t"].to_numpy(float), own["c"].to_numpy(float)
    prior = PRIOR * (t + c)
    rest = lambda x, n: np.maximum(n - x, 0.5)
    odds = np.log((t + prior) / rest(t, n_toxic)) - np.log((c + prior) / rest(c, n_clean))
    z = odds / np.sqrt(1 / (t + prior) + 1 / (c + prior))
    keep = (z > Z) & (odds > 3 * DRIFT)
    if not keep.any():
        return none
    tokens, odds = own["token"].to_numpy(np.int64)[keep], odds[keep]
    # Share of the words of clean texts with each score, at least half a word.
    per_word = (own["w"].to_numpy(float)[keep] + 0.5) / max(1.0, float(texts["w"].sum()))
    model = Model(tokens, odds, _rate(odds, per_word), 0.0, 1.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [model.evidence(found, n)[0] for n, found, _, _ in _segments(model, b.column(0))]
            bins = np.minimum(_BINS - 1, (12 * np.log1p(np.array(x))).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(bins, pa.int64()), b.column(1)], names=["bin", "label"])

    binned = sample.mapInArrow(weigh, "bin bigint, label int").groupBy("bin").agg(F.sum("label").alias("t"), F.count("*").alias("n")).toPandas()
    x = np.where(binned["bin"] > 0, (binned["bin"] + 0.5) / 12, 0.0)
    model.base, model.slope = _logistic(x, binned["t"].to_numpy(float), binned["n"].to_numpy(float))
    return model


def _rate(odds: np.ndarray, share: np.ndarray) -> float:
    """The positive root of E exp(rate * score) = 1, by bisection."""
    rest = max(1 - share.sum(), 0.01)
    low, high = 1e-6, 20.0
    for _ in range(80):
        mid = (low + high) / 2
        if rest * np.exp(-mid * DRIFT) + (share * np.exp(np.minimum(mid * odds, 600))).sum() > 1:
            high = mid
        else:
            low = mid
    return max(low, 0.05)


def _logistic(x: np.ndarray, positive: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Base and slope by Newton steps on counts, with a weak ridge."""
    beta, design = np.zeros(2), np.stack([np.ones(len(x)), x], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        ridge = 0.01
        gradient = design.T @ (positive - n * p) - ridge * beta
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + ridge * np.eye(2)
        beta = np.clip(beta + np.linalg.solve(hessian, gradient), -20, 20)
    return float(beta[0]), float(beta[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, n_segments, best (-ln E of the most significant) and segments of every row.

    segments: start and end in code points, score and e of each significant passage, in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("e", pa.float64())]))
        for b in batches:
            evidence, best, spans = [], [], []
            for n, found, starts, ends in _segments(model, b.column(1)):
                x, significant = model.evidence(found, n)
                evidence.append(x)
                best.append(max((-np.log(max(e, 1e-300)) for *_, e in significant), default=0.0))
                spans.append([{"start": int(starts[f]), "end": int(ends[t]), "score": s, "e": e} for f, t, s, e in significant])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(model.probability(np.array(evidence)), pa.float64()),
                    pa.array([len(s) for s in spans], pa.int64()),
                    pa.array(best, pa.float64()),
                    pa.array(spans, kind),
                ],
                names=["doc_id", "score", "n_segments", "best", "segments"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = "array<struct<start:bigint,end:bigint,score:double,e:double>>"
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, score double, n_segments bigint, best double, segments {spans}")
