"""Streaming operators. Each takes a streaming DataFrame and returns one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from commercelake.functions.money import ratio
from commercelake.operators.checkout import metrics
from commercelake.operators.wallet import settle_amounts
from commercelake.streaming.waiting import HOUR, Slots, Waiting, gathered

ERROR_ALERT = 0.05
PAYMENT_ALERT = 0.01
RETENTION = "90 days"


def live_checkout_metrics(decided: DataFrame) -> DataFrame:
    """The batch metrics, kept up to date as attempts arrive."""
    return metrics(decided.where("decision <> 'rejected'"))


def _rate_alert(events: DataFrame, failed: Column, window: str, delay: str, limit: float, level: str) -> DataFrame:
    per_window = (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"))
        .agg(F.count("*").alias("events"), F.count_if(failed).alias("failures"))
    )
    out = per_window.select(F.col("w.start").alias("window_start"), "events", "failures", ratio(F.col("failures"), F.col("events")).alias("rate"))
    return out.withColumn("level", F.when(F.col("rate") > limit, level).otherwise("OK"))


def error_rate_alert(events: DataFrame) -> DataFrame:
    """CRITICAL for 15 minutes with more than 5 % errors."""
    return _rate_alert(events, F.col("event_type") == "error", "15 minutes", "15 minutes", ERROR_ALERT, "CRITICAL")


def payment_failure_alert(decided: DataFrame) -> DataFrame:
    """ALERT for an hour with more than 1 % failed payments."""
    return _rate_alert(decided, F.col("decision") != "approved", "1 hour", "15 minutes", PAYMENT_ALERT, "ALERT")


def hourly_searches(navigation: DataFrame) -> DataFrame:
    """Searches per item and hour: one state and one row for 24 sliding windows."""
    per_hour = (
        navigation.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "item_id").agg(F.count("*").alias("searches"))
    )
    return per_hour.select("item_id", F.col("w.start").alias("hour"), "searches")


def demand(hourly: DataFrame) -> DataFrame:
    """Searches of the last 24 hours per item, every hour, at weight 4, from the hourly counts."""
    hours = F.sequence(F.lit(1), F.lit(24))
    end = F.col("hour") + F.make_dt_interval(hours=F.col("_i"))
    spread = hourly.select("item_id", "hour", "searches", F.explode(hours).alias("_i")).withColumn("as_of", end)
    out = spread.groupBy("item_id", "as_of").agg(F.sum("searches").alias("searches"))
    return out.withColumn("score", F.col("searches") * 4)


def navigation_sessions(navigation: DataFrame, gap: str = "30 minutes", delay: str = "15 minutes") -> DataFrame:
    """Closed sessions per buyer."""
    per_session = (
        navigation.withWatermark("ts", delay)
        .groupBy(F.session_window("ts", gap).alias("w"), "buyer_id")
        .agg(F.count("*").alias("events"))
    )
    return per_session.select("buyer_id", F.col("w.start").alias("started_at"), F.col("w.end").alias("ends_at"), "events")


def ingest_once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without the copies a sender repeats within the watermark."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def retained_daily(events: DataFrame) -> DataFrame:
    """Events per day; rows more than 90 days late are dropped."""
    per_day = events.withWatermark("ts", RETENTION).groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("events"))
    return per_day.select(F.col("w.start").alias("day"), "events")


# --- per-buyer state ---------------------------------------------------------------
# Rows wait in state until the watermark has passed them, so batches may come in any order within
# `delay`; rows later than that are dropped. Buyers are dealt into `groups`, a few for each state
# partition, whose number stays with the table like that of the partitions. A result is given at
# once, from what is settled and what still waits, and again when rows that come later change it.

GROUPS = 32
DELAY = "1 day"
WALLET_SCHEMA = "buyer_id bigint, balance_cents bigint, accepted bigint, refused bigint"
VIEW_SCHEMA = "event_id bigint, buyer_id bigint, value_cents bigint, age_seconds bigint"


def _by_buyer(rows: np.ndarray, buyer: int) -> Iterator[tuple[int, slice, np.ndarray]]:
    """Rows in order of time as runs of one buyer each: the buyer, the run's place, and the rows by buyer."""
    rows = rows[:, np.argsort(rows[buyer], kind="stable")]
    edges = np.flatnonzero(np.diff(rows[buyer])) + 1
    for a, b in zip([0, *edges.tolist()], [*edges.tolist(), rows.shape[1]], strict=True):
        yield int(rows[buyer, a]), slice(a, b), rows


class _Released(StatefulProcessor):
    """Keeps rows waiting, and settles them in order once the watermark has passed."""

    columns: list[str]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = Waiting(handle, self.columns)

    def receive(self, rows: Iterator[pd.DataFrame]) -> Iterator[np.ndarray]:
        """Put the frames of a batch into state, and give them back as columns, many rows at a time."""
        first = None
        for new in gathered(rows, self.columns):
            self.waiting.add(new)
            first = min(x for x in (first, int(new[0].min())) if x is not None)
            yield new
        if first is not None:
            self.handle.registerTimer(first // 1000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # Once per batch: the first timer settles all, and those after it find nothing.
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        for rows in self.waiting.take(upto):
            self.settle(rows, upto)
        first = self.waiting.first()
        if first is not None:
            self.handle.registerTimer(max(first, upto) // 1000 + 1)
        return iter(())

    def settle(self, rows: np.ndarray, upto: int) -> None:
        raise NotImplementedError

    def close(self) -> None:
        pass


class WalletProcessor(_Released):
    """Applies credits and debits in order of time; a debit larger than the balance is refused."""

    columns = ["at", "event_id", "buyer_id", "amount_cents"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.wallets = Slots(handle, "wallets", 3)

    def _apply(self, rows: np.ndarray, held: dict[int, dict[int, tuple[int, ...]]]) -> None:
        for buyer, run, ordered in _by_buyer(rows, 2):
            own = held[self.wallets.slot(buyer)]
            balance, accepted, refused = own.get(buyer, (0, 0, 0))
            amounts = ordered[3, run]
            balance, n, *_ = settle_amounts(balance, amounts)
            own[buyer] = (balance, accepted + len(amounts) - n, refused + n)

    def settle(self, rows: np.ndarray, upto: int) -> None:
        held = self.wallets.load(np.unique(rows[2]))
        self._apply(rows, held)
        self.wallets.save(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        buyers = np.unique(np.concatenate([np.unique(new[2]) for new in self.receive(rows)]))
        held = self.wallets.load(buyers)
        for some in self.waiting.in_order():
            self._apply(some[:, np.isin(some[2], buyers)], held)
        found = [(b, *held[self.wallets.slot(b)][b]) for b in buyers.tolist()]
        yield pd.DataFrame(found, columns=["buyer_id", "balance_cents", "accepted", "refused"])


class LastViewProcessor(_Released):
    """Purchases with the buyer's last view, if it is at most an hour old.

    Of the settled rows only each buyer's last view stays, until the watermark is an hour past it.
    """

    columns = ["at", "event_id", "buyer_id", "is_view", "value_cents"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = Slots(handle, "last_view", 1)

    def settle(self, rows: np.ndarray, upto: int) -> None:
        held = self.last.load(np.unique(rows[2]))
        for slot, own in held.items():
            held[slot] = {b: v for b, v in own.items() if v[0] >= upto - HOUR}
        views = rows[:, (rows[3] == 1) & (rows[0] >= upto - HOUR)]
        for buyer, at in zip(views[2].tolist(), views[0].tolist(), strict=True):
            held[self.last.slot(buyer)][buyer] = (at,)
        self.last.save(held)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ids, buyers, since = [], [], None
        for new in self.receive(rows):
            ids.append(new[1])
            buyers.append(np.unique(new[2]))
            since = min(x for x in (since, int(new[0].min())) if x is not None)
        ids, buyers = np.sort(np.concatenate(ids)), np.unique(np.concatenate(buyers))
        never = np.iinfo(np.int64).min // 2
        # The last view of each buyer and whether it came with this batch.
        last_at, last_new = np.full(len(buyers), never), np.zeros(len(buyers), bool)
        kept = {b: v[0] for own in self.last.load(buyers).values() for b, v in own.items()}
        for b in np.intersect1d(buyers, np.fromiter(kept, np.int64, len(kept))).tolist():
            last_at[np.searchsorted(buyers, b)] = kept[b]
        for some in self.waiting.in_order(since - HOUR):
            some = some[:, np.isin(some[2], buyers)]
            if not some.shape[1]:
                continue
            # All buyers at once: rows by buyer, each with the place of the last view up to it.
            at, event_id, buyer, is_view, value = some[:, np.argsort(some[2], kind="stable")]
            new, rows_ = np.isin(event_id, ids), np.arange(len(at))
            begins = np.concatenate([[True], buyer[1:] != buyer[:-1]])
            place = np.maximum.accumulate(np.where(is_view == 1, rows_, -1))
            own = place >= np.maximum.accumulate(np.where(begins, rows_, 0))
            who = np.searchsorted(buyers, buyer)
            view = np.where(own, at[place], last_at[who])
            from_new = np.where(own, new[place], last_new[who])
            ends = np.append(begins[1:], True)
            last_at[who[ends]], last_new[who[ends]] = view[ends], from_new[ends]
            # What is no news was given before.
            hit = (is_view == 0) & (at - view <= HOUR) & (new | from_new)
            if hit.any():
                yield pd.DataFrame({"event_id": event_id[hit], "buyer_id": buyer[hit], "value_cents": value[hit], "age_seconds": (at - view)[hit] // 10**6})


def _grouped(rows: DataFrame, delay: str, groups: int):
    """Rows with ts by groups of buyers, under a watermark."""
    group = F.pmod(F.xxhash64("buyer_id"), F.lit(groups)).alias("_group")
    return rows.withWatermark("ts", delay).select("*", group).groupBy("_group")


def live_wallet(ledger: DataFrame, delay: str = DELAY, groups: int = GROUPS) -> DataFrame:
    """Balance, accepted and refused movements per buyer, over all movements so far in order of time."""
    rows = ledger.select("at", "event_id", "buyer_id", "amount_cents", F.timestamp_micros("at").alias("ts"))
    return _grouped(rows, delay, groups).transformWithStateInPandas(WalletProcessor(), WALLET_SCHEMA, "Update", "EventTime")


def live_attribution(events: DataFrame, delay: str = DELAY, groups: int = GROUPS, mode: str = "Append") -> DataFrame:
    """Purchases with the age of the last view within an hour.

    A purchase is given once it and such a view are there, and again if a later view turns up
    afterwards; with mode "Update" the last row of an event_id counts.
    """
    rows = events.where("event_type IN ('view', 'purchase')").select(
        F.unix_micros("ts").alias("at"), "event_id", F.col("user_id").alias("buyer_id"),
        (F.col("event_type") == "view").cast("bigint").alias("is_view"), "value_cents", "ts",
    )
    return _grouped(rows, delay, groups).transformWithStateInPandas(LastViewProcessor(), VIEW_SCHEMA, mode, "EventTime")
