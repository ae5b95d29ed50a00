"""Rows waiting in state: few pieces however many frames and hours, and results like a plain loop's."""

import numpy as np
import pandas as pd
import pytest

from commercelake.streaming import jobs, waiting


class Handle:
    """State and timers of one group in memory, with a count of the writes."""

    def __init__(self):
        self.maps, self.writes, self.timers = {}, 0, []

    def getMapState(self, name, *_):
        handle, held = self, self.maps.setdefault(name, {})

        class Map:
            def updateValue(self, key, value):
                handle.writes += 1
                held[key] = value

            def getValue(self, key):
                return held.get(key)

            def keys(self):
                return iter(list(held))

            def removeKey(self, key):
                held.pop(key)

            def containsKey(self, key):
                return key in held

        return Map()

    def registerTimer(self, at):
        self.timers.append(at)


class At:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def _rows(rng, n, hours, buyers):
    at = rng.integers(0, hours * waiting.HOUR, n)
    return pd.DataFrame({"at": at, "event_id": np.arange(n), "buyer_id": rng.integers(0, buyers, n), "is_view": rng.integers(0, 2, n), "value_cents": rng.integers(0, 99, n)})


def _plain(rows):
    last, out = {}, {}
    for r in rows.sort_values(["at", "event_id"]).itertuples():
        if r.is_view:
            last[r.buyer_id] = r.at
        elif r.buyer_id in last and r.at - last[r.buyer_id] <= waiting.HOUR:
            out[r.event_id] = (r.buyer_id, r.value_cents, (r.at - last[r.buyer_id]) // 10**6)
    return out


def test_many_frames_over_many_hours_are_few_pieces_and_few_results():
    rows, handle, own = _rows(np.random.default_rng(1), 60_000, 720, 900), Handle(), jobs.LastViewProcessor()
    own.init(handle)
    frames = [rows.iloc[i : i + 10_000] for i in range(0, len(rows), 10_000)]
    found = list(own.handleInputRows((0,), iter(frames), None))
    assert handle.writes <= 20 and len(found) <= 20
    got = {r.event_id: (r.buyer_id, r.value_cents, r.age_seconds) for f in found for r in f.itertuples()}
    assert got == _plain(rows)


@pytest.mark.parametrize("piece", [7, 4096])
def test_batches_in_any_order_with_a_watermark(monkeypatch, piece):
    monkeypatch.setattr(waiting, "PIECE", piece)
    monkeypatch.setattr(waiting, "GATHER", 100)
    rng = np.random.default_rng(2)
    rows, handle, own = _rows(rng, 1500, 40, 9), Handle(), jobs.LastViewProcessor()
    own.init(handle)
    got, upto = {}, 0
    # A row comes at most ten hours late.
    for _, batch in rows.groupby((rows["at"] + rng.integers(0, 10 * waiting.HOUR, len(rows))) // (3 * waiting.HOUR)):
        for f in own.handleInputRows((0,), iter([batch.iloc[:30], batch.iloc[30:]] if len(batch) > 30 else [batch]), None):
            got |= {r.event_id: (r.buyer_id, r.value_cents, r.age_seconds) for r in f.itertuples()}
        upto = max(upto, int(batch["at"].max()) - 16 * waiting.HOUR)
        list(own.handleExpiredTimer((0,), At(upto // 1000), None))
    assert got == _plain(rows) and len(handle.maps["last_view"]) > 0
    list(own.handleExpiredTimer((0,), At(10**9), None))
    assert not handle.maps["waiting"]
