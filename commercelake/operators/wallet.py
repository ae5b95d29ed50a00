"""Wallet ledgers in which a debit larger than the balance is refused.

Whether a debit is accepted depends on every earlier decision, so the balance is a fold
and not a window sum. Spark brings a buyer's movements together in order (shuffle and
sort, which spill) and the fold reads them as a stream of batches with one balance in
memory. A buyer with more than `limit` movements is cut into time slices of about `limit`
rows that are folded in parallel, each from an assumed opening balance. The slices'
results are then chained:

* a slice whose lowest running sum does not take the opening balance below zero refuses
  nothing, so its closing balance is opening + total, whatever the opening is;
* any other slice is right only if it was folded from the opening the chain now shows.

Slices that were folded from another opening are folded again, once. That settles ledgers in
which different openings end in the same balance. Where some slice is still open, one ordered
pass goes on from the buyer's first such slice, whose opening is certain, with one balance in
memory: it is as long as the buyer's remaining rows, and ends what could take one round per
slice. So openings take three passes at most, and the result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commercelake.functions.money import as_money
from commercelake.operators.ordered import running, with_range
from commercelake.operators.skew import hot_table, with_hot
from commercelake.session import cut_lineage
from commercelake.sources import versioned
from commercelake.sources.snapshots import held_partitions

SLICE_ROWS = 2_000_000
#: Movements that are looked at as one step.
BLOCK = 128

_KEYS = ["buyer_id", "_slice"]


def wallet_slices(ledger: DataFrame, limit: int = SLICE_ROWS) -> tuple[DataFrame, bool]:
    """(buyer_id, at, event_id, amount_cents, _slice, _hot), and whether any buyer is hot."""
    hot = hot_table(ledger, ["buyer_id"]).where(F.col("_n") > limit)
    rows = hot.agg(F.sum("_n")).first()[0]
    if not rows:
        return ledger.withColumns({"_slice": F.lit(0).cast("bigint"), "_hot": F.lit(False)}), False
    # A slice is folded as a stream, so there need not be more of them than tasks.
    ranges = min(-(-rows // limit), 2 * int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    marked = with_hot(ledger, hot, ["buyer_id"]).withColumn("_hot", F.col("_salts").isNotNull()).drop("_salts")
    cut = with_range(marked, ["at", "event_id"], ranges, "_slice", "_hot")
    return cut.withColumn("_slice", F.col("_slice").cast("bigint")), True


def _in_order(rows: DataFrame) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "at", "event_id")


def _pieces(pdf: pd.DataFrame) -> Iterator[tuple[int, int]]:
    """Bounds of the runs of rows of one slice."""
    buyer, part = pdf["buyer_id"].to_numpy(), pdf["_slice"].to_numpy()
    change = np.flatnonzero((buyer[1:] != buyer[:-1]) | (part[1:] != part[:-1])) + 1
    edges = [0, *change.tolist(), len(pdf)]
    return zip(edges, edges[1:])


FOLD_SCHEMA = (
    "buyer_id bigint, _slice bigint, assumed bigint, closing bigint, accepted bigint, refused bigint, "
    "refused_cents bigint, total bigint, low bigint"
)


def settle_amounts(balance: int, amounts: np.ndarray) -> tuple[int, int, int, int, int]:
    """Balance after the amounts, number and sum of the refused, lowest running sum and total.

    A block in which nothing is refused is one step.
    """
    sums = np.cumsum(amounts)
    starts = np.arange(0, len(amounts), BLOCK)
    ends = np.append(starts[1:], len(amounts))
    lows, after = np.minimum.reduceat(sums, starts).tolist(), sums[ends - 1].tolist()
    before, refused, cents = 0, 0, 0
    for a, b, low, end in zip(starts.tolist(), ends.tolist(), lows, after, strict=True):
        if balance + low - before >= 0:
            balance += end - before
        else:
            for amount in amounts[a:b].tolist():
                if balance + amount >= 0:
                    balance += amount
                else:
                    refused += 1
                    cents -= amount
        before = end
    return balance, refused, cents, min(lows), after[-1]


def _fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per slice from its rows in order; low is its lowest running sum."""
    names = [field.split()[0] for field in FOLD_SCHEMA.split(", ")]
    key, state = None, None
    for pdf in frames:
        done = []
        amounts, openings = pdf["amount_cents"].to_numpy(), pdf["opening"].tolist()
        buyers, parts = pdf["buyer_id"].tolist(), pdf["_slice"].tolist()
        for a, b in _pieces(pdf):
            if key != (buyers[a], parts[a]):
                if key is not None:
                    done.append((*key, *state))
                key, opening = (buyers[a], parts[a]), openings[a]
                assumed, balance, accepted, refused, refused_cents, total, low = opening, opening, 0, 0, 0, 0, 0
            else:
                assumed, balance, accepted, refused, refused_cents, total, low = state
            balance, n, cents, lowest, change = settle_amounts(balance, amounts[a:b])
            low, total = min(low, total + lowest), total + change
            accepted, refused, refused_cents = accepted + b - a - n, refused + n, refused_cents + cents
            state = (assumed, balance, accepted, refused, refused_cents, total, low)
        if done:
            yield pd.DataFrame(done, columns=names)
    if key is not None:
        yield pd.DataFrame([(*key, *state)], columns=names)


def _fold_slices(rows: DataFrame) -> DataFrame:
    return _in_order(rows.select(*_KEYS, "at", "event_id", "amount_cents", "opening")).mapInPandas(_fold, FOLD_SCHEMA)


def _chain(slices: DataFrame) -> DataFrame:
    """The opening of each slice that the slices before it imply, one row per slice in order."""
    def carry(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buyer, balance = None, 0
        for pdf in frames:
            openings = np.empty(len(pdf), dtype=np.int64)
            columns = (pdf[c].tolist() for c in ("buyer_id", "total", "low", "closing"))
            for i, (own, total, low, closing) in enumerate(zip(*columns)):
                if own != buyer:
                    buyer, balance = own, 0
                openings[i] = balance
                balance = balance + total if balance + low >= 0 else closing
            yield pdf[_KEYS].assign(opening=openings)

    ordered = slices.select(*_KEYS, "total", "low", "closing").repartition("buyer_id").sortWithinPartitions(*_KEYS)
    return ordered.mapInPandas(carry, "buyer_id bigint, _slice bigint, opening bigint")


def _walk_on(rows: DataFrame, first: DataFrame) -> DataFrame:
    """The opening of each slice from first (buyer_id, _first, _open) on, in one ordered pass per buyer."""

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buyer, part, balance = None, None, 0
        for pdf in frames:
            amounts, opens = pdf["amount_cents"].to_numpy(), pdf["_open"].tolist()
            buyers, parts = pdf["buyer_id"].tolist(), pdf["_slice"].tolist()
            found = []
            for a, b in _pieces(pdf):
                if buyers[a] != buyer:
                    buyer, part, balance = buyers[a], None, opens[a]
                if parts[a] != part:
                    part = parts[a]
                    found.append((buyer, part, balance))
                balance = settle_amounts(balance, amounts[a:b])[0]
            if found:
                yield pd.DataFrame(found, columns=[*_KEYS, "_walked"])

    # Hot buyers only, of which there are fewer than skew.PARTS.
    rest = rows.join(F.broadcast(first), "buyer_id").where("_slice >= _first").drop("_first")
    ordered = rest.repartition("buyer_id").sortWithinPartitions(*_KEYS, "at", "event_id")
    return ordered.mapInPandas(walk, "buyer_id bigint, _slice bigint, _walked bigint")


def opening_balances(hot_rows: DataFrame) -> DataFrame:
    """Exact opening balance of every slice of the hot buyers."""
    rows = cut_lineage(hot_rows.select(*_KEYS, "at", "event_id", "amount_cents"))
    folded = _fold_slices(rows.withColumn("opening", F.lit(0).cast("bigint")))
    state = cut_lineage(folded.select(*_KEYS, "assumed", "closing", "total", "low"))
    chained = cut_lineage(state.join(_chain(state), _KEYS))
    still_open = "opening + low < 0 AND opening <> assumed"
    stale = chained.where(still_open).select(*_KEYS, "opening")
    if stale.isEmpty():
        return chained.select(*_KEYS, "opening")
    again = _fold_slices(rows.join(stale, _KEYS)).select(*_KEYS, F.col("assumed").alias("_assumed"), F.col("closing").alias("_closing"))
    state = cut_lineage(
        state.join(again, _KEYS, "left").select(
            *_KEYS, F.coalesce("_assumed", "assumed").alias("assumed"), F.coalesce("_closing", "closing").alias("closing"), "total", "low"
        )
    )
    chained = cut_lineage(state.join(_chain(state), _KEYS))
    first = chained.where(still_open).groupBy("buyer_id").agg(F.min("_slice").alias("_first"), F.min_by("opening", "_slice").alias("_open"))
    if first.isEmpty():
        return chained.select(*_KEYS, "opening")
    walked = cut_lineage(_walk_on(rows, first))
    return chained.join(walked, _KEYS, "left").select(*_KEYS, F.coalesce("_walked", "opening").alias("opening"))


def _with_openings(ledger: DataFrame, limit: int) -> DataFrame:
    rows, several = wallet_slices(ledger, limit)
    zero = F.lit(0).cast("bigint")
    if not several:
        return rows.withColumn("opening", zero)
    openings = opening_balances(rows.where("_hot"))
    return rows.join(openings, _KEYS, "left").withColumn("opening", F.coalesce("opening", zero))


def wallet_fold(ledger: DataFrame, limit: int = SLICE_ROWS) -> DataFrame:
    """Balance, accepted and refused movements per buyer."""
    folded = _fold_slices(_with_openings(ledger, limit))
    return folded.groupBy("buyer_id").agg(
        as_money(F.max_by("closing", "_slice")).alias("balance"),
        F.sum("accepted").alias("accepted"),
        F.sum("refused").alias("refused"),
        as_money(F.sum("refused_cents")).alias("refused_amount"),
    )


def steps(balance: int, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each movement whether it is accepted, and the balance after it; blocks without refusals are one step."""
    accepted, balances = np.ones(len(amounts), bool), np.empty(len(amounts), np.int64)
    for a in range(0, len(amounts), BLOCK):
        some = slice(a, min(a + BLOCK, len(amounts)))
        after = balance + np.cumsum(amounts[some])
        if after.min() < 0:
            for i, amount in enumerate(amounts[some].tolist()):
                accepted[a + i] = balance + amount >= 0
                balance += amount if accepted[a + i] else 0
                after[i] = balance
        balances[some] = after
        balance = int(after[-1])
    return accepted, balances


STATEMENT_SCHEMA = "buyer_id bigint, event_id bigint, amount_cents bigint, accepted boolean, balance_cents bigint"


def _statement(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, balance = None, 0
    for pdf in frames:
        balances = np.empty(len(pdf), dtype=np.int64)
        accepted = np.empty(len(pdf), dtype=bool)
        amounts, openings = pdf["amount_cents"].to_numpy(), pdf["opening"].tolist()
        buyers, parts = pdf["buyer_id"].tolist(), pdf["_slice"].tolist()
        for a, b in _pieces(pdf):
            if key != (buyers[a], parts[a]):
                key, balance = (buyers[a], parts[a]), openings[a]
            accepted[a:b], balances[a:b] = steps(balance, amounts[a:b])
            balance = int(balances[b - 1])
        yield pdf[["buyer_id", "event_id", "amount_cents"]].assign(accepted=accepted, balance_cents=balances)


def wallet_statement(ledger: DataFrame, limit: int = SLICE_ROWS) -> DataFrame:
    """Every movement with its outcome and the balance after it."""
    rows = _with_openings(ledger, limit).select(*_KEYS, "at", "event_id", "amount_cents", "opening")
    return _in_order(rows).mapInPandas(_statement, STATEMENT_SCHEMA)


def running_balance(ledger: DataFrame, ranges: int | None = None) -> DataFrame:
    """Balance after each movement when nothing can be refused."""
    return running(ledger, ["buyer_id"], ["at", "event_id"], {"balance_cents": ("sum", F.col("amount_cents"))}, ranges)


def check_credits(credits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a credit must be greater than zero."""
    good = F.coalesce(F.col("amount_cents") > 0, F.lit(False))
    return credits.where(good), credits.where(~good)


def signed_balance(*movements: DataFrame) -> DataFrame:
    """Credits less debits per buyer over any number of (buyer_id, amount_cents) tables."""
    total = movements[0].select("buyer_id", "amount_cents")
    for more in movements[1:]:
        total = total.unionByName(more.select("buyer_id", "amount_cents"))
    return total.groupBy("buyer_id").agg(as_money(F.sum("amount_cents")).alias("balance"))


CLOSING = "buyer_id bigint, balance_cents bigint, accepted bigint, refused bigint, refused_cents bigint"


def write_ledger(ledger: DataFrame, path: str, days: int = 1) -> None:
    """Put movements into a ledger of periods of some days, numbered from 1970; the periods written are replaced."""
    period = F.floor(F.col("at") / (days * 86_400 * 10**6)).cast("bigint")
    rows = ledger.select("buyer_id", "at", "event_id", "amount_cents", period.alias("period"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period").parquet(path)


def close_periods(spark: SparkSession, path: str, closings: str, limit: int = SLICE_ROWS) -> list[int]:
    """Fold the periods of a ledger that are not closed yet, in order, and return them.

    closings is a versioned table: a period's version holds the buyers that moved in it, so a run
    reads the new periods and the balances of their buyers, not the ledger before them. A buyer's
    balance opens its next period as a credit ahead of all movements, which is always accepted. What
    one task must take in order is one buyer's rows of one period at most. A period is closed once:
    movements that reach its folder later are not seen.
    """
    last = versioned.newest(spark, closings)
    periods = held_partitions(spark, path, "period").select(F.col("period").cast("bigint"))
    fresh = sorted(r[0] for r in (periods if last is None else periods.where(F.col("period") > last)).collect())
    for period in fresh:
        rows = spark.read.parquet(f"{path}/period={period}").select("buyer_id", "at", "event_id", "amount_cents")
        before = versioned.read_version(spark, closings, CLOSING, "buyer_id")
        opened = before.join(rows.select(F.col("buyer_id").alias("_b")), F.col("buyer_id") == F.col("_b"), "left_semi")
        least = F.lit(-(2**63)).cast("bigint")
        credit = opened.select("buyer_id", least.alias("at"), least.alias("event_id"), F.col("balance_cents").alias("amount_cents"))
        folded = _fold_slices(_with_openings(rows.unionByName(credit), limit)).groupBy(F.col("buyer_id").alias("_b"))
        folded = folded.agg(
            F.max_by("closing", "_slice").alias("balance_cents"),
            *[F.sum(c).alias(f"_{c}") for c in ("accepted", "refused", "refused_cents")],
        )
        known = opened.select("buyer_id", "accepted", "refused", "refused_cents")
        joined = folded.join(known, F.col("_b") == F.col("buyer_id"), "left")
        # The opening is a movement that was counted before.
        opening = F.when(F.col("buyer_id").isNull(), 0).otherwise(1)
        total = {c: F.col(f"_{c}") + F.coalesce(c, F.lit(0)) for c in ("accepted", "refused", "refused_cents")}
        total["accepted"] -= opening
        closed = joined.select(F.col("_b").alias("buyer_id"), "balance_cents", *[v.cast("bigint").alias(c) for c, v in total.items()])
        versioned.write_changes(closed, closings, period, "buyer_id")
    return fresh


def closing_balances(spark: SparkSession, closings: str, period: int | None = None) -> DataFrame:
    """Balance and counts per buyer as of a closed period, the last by default."""
    found = versioned.read_version(spark, closings, CLOSING, "buyer_id", period)
    return found.select(
        "buyer_id", as_money(F.col("balance_cents")).alias("balance"), "accepted", "refused", as_money(F.col("refused_cents")).alias("refused_amount")
    )
