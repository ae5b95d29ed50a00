"""Rows that wait in state until the watermark has passed them, so that batches may come in any order.

Keys are dealt into groups, and a group's rows lie in its state as pieces of columns, not row by row:
a batch costs a few reads and writes a group, whatever the number of keys. A piece holds rows of
one stretch of time in order. Frames are put together up to GATHER rows; what are few rows then is one
piece, more are cut where the hour changes after PIECE rows, so that there are few pieces. These are read
one after the other in time, so what is in memory at a time are those that overlap, not all that waits.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.streaming import StatefulProcessorHandle

#: Rows that stay one piece, rows of frames that are put together, and pieces that are read at a time.
PIECE = 4096
GATHER = 1 << 18
READ = 16
HOUR = 3600 * 10**6


class Waiting:
    """The waiting rows of one group: int64 columns, the first of them `at` (microseconds), then `event_id`."""

    def __init__(self, handle: StatefulProcessorHandle, columns: list[str]):
        self.columns = columns
        self._pieces = handle.getMapState("waiting", "first bigint, last bigint, part bigint", "rows binary")

    def add(self, rows: np.ndarray) -> None:
        """Keep rows (a column of the array each) as new pieces."""
        if not rows.shape[1]:
            return
        rows = rows[:, np.lexsort((rows[1], rows[0]))]
        hours = np.flatnonzero(np.diff(rows[0] // HOUR)) + 1
        cuts, last = [], 0
        while (i := np.searchsorted(hours, last + PIECE)) < len(hours):
            last = int(hours[i])
            cuts.append(last)
        for piece in np.split(rows, cuts, axis=1):
            # The clock tells pieces of one stretch apart; a batch that is run again starts from the state before it.
            self._pieces.updateValue((int(piece[0, 0]), int(piece[0, -1]), time.time_ns()), (piece.tobytes(),))

    def _keys(self) -> list[tuple[int, int, int]]:
        return sorted(tuple(map(int, k)) for k in self._pieces.keys())

    def in_order(self, since: int | None = None) -> Iterator[np.ndarray]:
        """All rows in order of (at, event_id), some at a time; pieces that end before `since` are left out."""
        keys = [k for k in self._keys() if since is None or k[1] >= since]
        yield from self._merged(keys, self._read)

    def _merged(self, keys: list[tuple[int, int, int]], read) -> Iterator[np.ndarray]:
        """What read gives for each key, in order of (at, event_id)."""
        held, n, most = [], 0, READ * PIECE
        for i, key in enumerate(keys):
            held.append(read(key))
            n += held[-1].shape[1]
            if i + 1 < len(keys) and n < most:
                continue
            rows = np.concatenate(held, axis=1)
            ready = rows[0] < keys[i + 1][0] if i + 1 < len(keys) else np.ones(n, bool)
            some, held = rows[:, ready], [rows[:, ~ready]]
            n = held[0].shape[1]
            # At least as much again is read before what overlaps is looked at once more.
            most = max(READ * PIECE, 2 * n)
            if some.shape[1]:
                yield some[:, np.lexsort((some[1], some[0]))]

    def _read(self, key: tuple[int, int, int]) -> np.ndarray:
        return np.frombuffer(bytes(self._pieces.getValue(key)[0]), np.int64).reshape(len(self.columns), -1)

    def take(self, upto: int) -> Iterator[np.ndarray]:
        """Rows not later than `upto` in order, which no longer wait; later ones of their pieces stay."""

        def read(key: tuple[int, int, int]) -> np.ndarray:
            piece = self._read(key)
            self._pieces.removeKey(key)
            self.add(piece[:, piece[0] > upto])
            return piece[:, piece[0] <= upto]

        yield from self._merged([k for k in self._keys() if k[0] <= upto], read)

    def first(self) -> int | None:
        return min((k[0] for k in self._keys()), default=None)


class Slots:
    """A few int64 numbers per key of a group, in `slots` arrays of which only those in use are read and written."""

    def __init__(self, handle: StatefulProcessorHandle, name: str, width: int, slots: int = 4):
        self._state, self._width, self._slots = handle.getMapState(name, "slot bigint", "rows binary"), width, slots

    def load(self, keys: np.ndarray) -> dict[int, dict[int, tuple[int, ...]]]:
        """The values by slot and key, of all slots that hold any of the keys."""
        out = {}
        for slot in np.unique(keys % self._slots).tolist():
            found = self._state.getValue((slot,))
            rows = np.frombuffer(bytes(found[0]) if found else b"", np.int64).reshape(-1, self._width + 1)
            out[slot] = {r[0]: tuple(r[1:]) for r in rows.tolist()}
        return out

    def save(self, held: dict[int, dict[int, tuple[int, ...]]]) -> None:
        for slot, values in held.items():
            if values:
                self._state.updateValue((slot,), (np.array([(k, *v) for k, v in values.items()], np.int64).tobytes(),))
            elif self._state.containsKey((slot,)):
                self._state.removeKey((slot,))

    def slot(self, key: int) -> int:
        return key % self._slots


def columns_of(pdf: pd.DataFrame, names: list[str]) -> np.ndarray:
    return np.stack([pdf[n].to_numpy(np.int64) for n in names])


def gathered(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[np.ndarray]:
    """The columns of the frames, GATHER rows or a little more at a time."""
    held, n = [], 0
    for pdf in frames:
        held.append(columns_of(pdf, names))
        n += len(pdf)
        if n >= GATHER:
            yield np.concatenate(held, axis=1)
            held, n = [], 0
    if n:
        yield np.concatenate(held, axis=1)
