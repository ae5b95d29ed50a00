"""Token ids of whole texts, by a public tokenizer whose words are independent.

The tokenizer drops white space before it splits, so a text's ids are those of its words, one
after the other. Each distinct word is encoded by the library once and kept under its hash, with
its bytes, to which every word found under that hash is compared; texts become gathers from that
table. Only for tokenizers with this property: word_bpe_49k.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa

from commercelake.llm.words import Lanes, chunks, text_bytes, word_spans

CHUNK = 4 << 20
KEPT_WORDS = 1_000_000


class Encoder:
    """encode() gives the ids of a text column and the offsets of its rows."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._clear()

    def _clear(self) -> None:
        self._segments: list[tuple[np.ndarray, ...]] = []
        self._pool = np.zeros(1 << 16, np.uint32)
        self._used = 0
        self._bytes: list[bytes] = []
        self._filled = 0

    def _keep(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Encode words; where their ids begin in the pool, and how many there are."""
        texts = [w.decode("utf-8", "replace") for w in words]
        found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum()))
        while self._used + len(ids) > len(self._pool):
            self._pool = np.concatenate([self._pool, np.zeros_like(self._pool)])
        self._pool[self._used : self._used + len(ids)] = ids
        starts = self._used + np.cumsum(lengths) - lengths
        self._used += len(ids)
        return starts, lengths

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        starts, lengths = self._keep(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        new = (hashes, starts, lengths, self._filled + np.cumsum(sizes) - sizes, sizes)
        self._bytes.append(b"".join(words))
        self._filled += int(sizes.sum())
        while self._segments and len(self._segments[-1][0]) < 2 * len(new[0]):
            both = [np.concatenate(x) for x in zip(self._segments.pop(), new, strict=True)]
            order = np.argsort(both[0], kind="stable")
            new = tuple(x[order] for x in both)
        self._segments.append(new)

    def _find(self, hashes: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Per hash where its ids begin and their number, where its word's bytes begin and theirs; and which are missing."""
        out = [np.zeros(len(hashes), np.int64) for _ in range(4)]
        missing = np.ones(len(hashes), bool)
        for keys, *values in self._segments:
            at = np.searchsorted(keys, hashes)
            at[at == len(keys)] = 0
            hit = keys[at] == hashes
            for x, own in zip(out, values, strict=True):
                x[hit] = own[at[hit]]
            missing &= ~hit
        return out, missing

    def _other_words(self, lanes: Lanes, starts: np.ndarray, sizes: np.ndarray, back: np.ndarray, kept: list[np.ndarray]) -> np.ndarray:
        """Places of words that are not the kept word of their hash, of which back and kept give place and size.

        Short ones of one length and hash never differ.
        """
        other = sizes != kept[1][back]
        far = np.flatnonzero((sizes > 8) & ~other)
        if len(far):
            if len(self._bytes) > 1:
                self._bytes = [b"".join(self._bytes)]
            known = Lanes(np.frombuffer(self._bytes[0], np.uint8))
            other[far] = ~lanes.same(starts[far], known, kept[0][back[far]], sizes[far])
        return np.flatnonzero(other)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offsets = text_bytes(column)
        parts, totals = [], [np.zeros(1, np.int64)]
        for a, z in chunks(offsets, CHUNK):
            raw, own = data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a]
            starts, ends, at = word_spans(raw, own)
            lanes = Lanes(raw)
            hashes = lanes.hashes(starts, ends)
            distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            if sum(len(s[0]) for s in self._segments) > KEPT_WORDS:
                self._clear()
            found, missing = self._find(distinct)
            if missing.any():
                where = first[missing]
                whole = raw.tobytes()
                self._learn(distinct[missing], [whole[s:e] for s, e in zip(starts[where], ends[where], strict=True)])
                found, _ = self._find(distinct)
            begin, per_word = found[0][back], found[1][back]
            # Another word of the same hash is encoded by itself.
            other = self._other_words(lanes, starts, ends - starts, back, found[2:])
            if len(other):
                begin[other], per_word[other] = self._keep([raw[s:e].tobytes() for s, e in zip(starts[other], ends[other], strict=True)])
            done = np.concatenate([[0], np.cumsum(per_word)])
            index = np.repeat(begin - done[:-1], per_word) + np.arange(done[-1])
            parts.append(self._pool[index])
            totals.append(totals[-1][-1] + done[at[1:]])
        ids = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        return ids, np.concatenate(totals)


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each followed by end_id."""
    rows = len(offsets) - 1
    ends = offsets[1:] + np.arange(rows)
    out = np.empty(len(ids) + rows, np.uint32)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[ends], out[inner] = end_id, ids
    return out, offsets + np.arange(rows + 1)


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker, whose table of words serves all its tasks."""
    return Encoder(path)
