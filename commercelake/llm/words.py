"""Words of whole texts as hashes, over the raw bytes of Arrow batches.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. These separators are ASCII, so
cutting UTF-8 at them never cuts a character. Hashing is one prefix sum over the bytes: with
an odd base its powers have inverses modulo 2**64, and a word's polynomial is the difference
of two sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser that spreads every input bit over the whole value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for at least n positions."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        both = []
        for base in (_BASE, inverse):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _POWERS[size] = (both[0], both[1])
    return _POWERS[size]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if column.type != pa.large_binary() else column
    column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data[:0], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes; a longer row is a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(rows, max(last, first + 1))
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and per row the number of words before it."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(offsets), np.int64)
    separator = _SEPARATOR[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, separator[:-1]
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, separator[1:]
    filled = offsets[1:] > offsets[:-1]
    before[offsets[:-1][filled]] = True
    after[offsets[1:][filled] - 1] = True
    inside = ~separator
    starts = np.flatnonzero(before & inside)
    ends = np.flatnonzero(after & inside) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """64-bit hashes of the words; fold treats A-Z as a-z."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data))
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((_FOLDED if fold else _BYTE)[data] * power[: len(data)], dtype=np.uint64, out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of `width` words in a row, one for each start."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = mix(out * np.uint64(_BASE) + hashes[k : k + count])
    return out


def spans_of(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As word_spans, for any table of 256 flags that says which bytes separate words."""
    inside = ~separator[data]
    # A flag on either side of each row keeps words of neighbouring rows apart.
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    joined = inside[1:] & inside[:-1] & ~edges[1 : len(data)]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~joined
    last[:-1] &= ~joined
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


_LANE_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


class Lanes:
    """Eight bytes from any position on as one number, for hashes and comparisons of whole words."""

    #: Words longer than this are hashed one by one.
    MANY = 128

    def __init__(self, data: np.ndarray):
        self._padded = np.concatenate([data, np.zeros(8, np.uint8)])
        self.at = np.ndarray((len(data) + 1,), "<u8", self._padded, strides=(1,))

    def _lane(self, places: np.ndarray, left: np.ndarray) -> np.ndarray:
        """The bytes at places, of which `left` or eight count."""
        return self.at[places] & _LANE_MASKS[np.minimum(left, 8)]

    def hashes(self, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
        """64-bit hashes of non-empty words; those of at most eight bytes and one length never collide."""
        lengths = ends - starts
        seeds = lengths.astype(np.uint64) * np.uint64(_BASE) + np.uint64(mix(np.array([salt], np.uint64))[0])
        out = mix(self._lane(starts, lengths) ^ seeds)
        live, done = np.flatnonzero((lengths > 8) & (lengths <= self.MANY)), 8
        while len(live):
            left = lengths[live] - done
            out[live] = mix(out[live] ^ self._lane(starts[live] + done, left))
            live, done = live[left > 8], done + 8
        for i in np.flatnonzero(lengths > self.MANY):
            word = self._padded[starts[i] : ends[i]].tobytes()
            out[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8, salt=salt.to_bytes(8, "little")).digest(), "little")
        return out

    def same(self, starts: np.ndarray, other: Lanes, other_starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether words of equal lengths here and there are the same bytes."""
        equal = np.ones(len(starts), bool)
        live, done = np.flatnonzero(lengths <= self.MANY), 0
        while len(live):
            left = lengths[live] - done
            differ = self._lane(starts[live] + done, left) != other._lane(other_starts[live] + done, left)
            equal[live[differ]] = False
            live, done = live[(left > 8) & ~differ], done + 8
        for i in np.flatnonzero(lengths > self.MANY):
            a, b, n = starts[i], other_starts[i], lengths[i]
            equal[i] = np.array_equal(self._padded[a : a + n], other._padded[b : b + n])
        return equal
