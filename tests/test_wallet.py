"""The wallet fold against a plain loop, with one buyer cut into many slices."""

import random

import numpy as np
import pytest

from commercelake.operators import wallet
from commercelake.session import shared_path


def ledger(seed, n, debit_share, hot_share=0.5):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        buyer = 0 if rng.random() < hot_share else rng.randint(1, 9)
        amount = rng.randint(1, 40) * (-1 if rng.random() < debit_share else 1)
        out.append((buyer, rng.randint(0, n // 3), i, amount))
    return out


def walk(data):
    balance, counts, steps = {}, {}, {}
    for buyer, at, i, amount in sorted(data, key=lambda r: (r[1], r[2])):
        before = balance.get(buyer, 0)
        ok = before + amount >= 0
        balance[buyer] = before + amount if ok else before
        accepted, refused, cents = counts.get(buyer, (0, 0, 0))
        counts[buyer] = (accepted + ok, refused + (not ok), cents - (0 if ok else amount))
        steps[i] = (ok, balance[buyer])
    return balance, counts, steps


@pytest.mark.parametrize("debit_share", [0.1, 0.5, 0.8])
@pytest.mark.parametrize("limit", [25, 10_000])
def test_fold_and_statement_match_a_plain_loop(spark, debit_share, limit):
    data = ledger(int(debit_share * 10) + limit, 400, debit_share)
    df = spark.createDataFrame(data, "buyer_id bigint, at bigint, event_id bigint, amount_cents bigint").repartition(4)
    balance, counts, steps = walk(data)
    folded = {
        r["buyer_id"]: (int(r["balance"] * 100), r["accepted"], r["refused"], int(r["refused_amount"] * 100))
        for r in wallet.wallet_fold(df, limit).collect()
    }
    assert folded == {b: (balance[b], *counts[b]) for b in balance}
    rows = {r["event_id"]: (r["accepted"], r["balance_cents"]) for r in wallet.wallet_statement(df, limit).collect()}
    assert rows == steps


def test_hot_buyer_is_sliced(spark):
    data = ledger(1, 400, 0.5)
    df = spark.createDataFrame(data, "buyer_id bigint, at bigint, event_id bigint, amount_cents bigint")
    sliced, several = wallet.wallet_slices(df, 25)
    sizes = {(r["buyer_id"], r["_slice"]): r["count"] for r in sliced.groupBy("buyer_id", "_slice").count().collect()}
    assert several and max(sizes.values()) < 80
    assert sum(1 for b, _ in sizes if b == 0) > 4


SHAPES = {
    "alternating refusals": lambda i: (7, -5, -9)[i % 3],
    "growing debits": lambda i: 50 + i % 7 if i % 2 == 0 else -(40 + i // 3),
    "slow drain": lambda i: 5000 if i == 0 else (-13 if i % 4 else 3),
}


@pytest.mark.parametrize("shape", SHAPES)
def test_openings_take_three_passes_at_most(spark, shape, monkeypatch):
    data = [(b, i, i * 2 + b, SHAPES[shape](i)) for i in range(400) for b in (0, 1)]
    df = spark.createDataFrame(data, "buyer_id bigint, at bigint, event_id bigint, amount_cents bigint").repartition(4)
    passes = []
    for name in ("_fold_slices", "_walk_on"):
        monkeypatch.setattr(wallet, name, lambda *a, f=getattr(wallet, name), n=name: passes.append(n) or f(*a))
    sliced, several = wallet.wallet_slices(df, 20)
    wallet.opening_balances(sliced.where("_hot"))
    assert several and len(passes) <= 3
    _, _, steps = walk(data)
    assert {r["event_id"]: (r["accepted"], r["balance_cents"]) for r in wallet.wallet_statement(df, 20).collect()} == steps


@pytest.mark.parametrize("seed", range(6))
def test_steps_over_blocks_match_a_plain_loop(seed):
    amounts = np.random.default_rng(seed).integers(-30, 30 + 5 * seed, 128 * 3 + seed)
    balance, refused, cents, sums = 100, 0, 0, np.cumsum(amounts)
    for a in amounts.tolist():
        balance, refused, cents = (balance + a, refused, cents) if balance + a >= 0 else (balance, refused + 1, cents - a)
    assert wallet.settle_amounts(100, amounts) == (balance, refused, cents, sums.min(), sums[-1])


def test_credit_then_payment(spark):
    df = spark.createDataFrame([(1, 1, 1, 5000), (1, 2, 2, -3000)], "buyer_id bigint, at bigint, event_id bigint, amount_cents bigint")
    assert str(wallet.wallet_fold(df).first()["balance"]) == "20.00"


@pytest.mark.parametrize("seed", range(4))
def test_steps_of_a_statement_match_a_plain_loop(seed):
    amounts = np.random.default_rng(seed).integers(-30, 31, 128 * 3 + seed)
    accepted, balances = wallet.steps(20, amounts)
    balance, want = 20, []
    for a in amounts.tolist():
        ok = balance + a >= 0
        balance += a if ok else 0
        want.append((ok, balance))
    assert list(zip(accepted.tolist(), balances.tolist(), strict=True)) == want


DAY = 86_400 * 10**6


@pytest.mark.parametrize("shape", SHAPES)
def test_a_closed_period_is_not_read_again(spark, shape):
    """Each run gets a ledger that holds the new period alone."""
    schema = "buyer_id bigint, at bigint, event_id bigint, amount_cents bigint"
    data = [(b, i * DAY // 100, i * 3 + b, SHAPES[shape](i)) for i in range(300) for b in (0, 1) if b == 0 or i % 7 == 0 or i > 250]
    data += [(5, 10, 5000, 40), (6, 250 * DAY // 100, 5001, -40)]
    closings = shared_path(spark, "closings")
    for day in range(3):
        path = shared_path(spark, "ledger")
        some = [r for r in data if r[1] // DAY == day]
        wallet.write_ledger(spark.createDataFrame(some, schema).repartition(3), path)
        assert wallet.close_periods(spark, path, closings, limit=25) == [day]
        assert wallet.close_periods(spark, path, closings, limit=25) == []
        balance, counts, _ = walk([r for r in data if r[1] // DAY <= day])
        found = wallet.closing_balances(spark, closings).collect()
        got = {r["buyer_id"]: (int(r["balance"] * 100), r["accepted"], r["refused"], int(r["refused_amount"] * 100)) for r in found}
        assert got == {b: (balance[b], *counts[b]) for b in balance}
    first = {r["buyer_id"]: r["accepted"] + r["refused"] for r in wallet.closing_balances(spark, closings, period=0).collect()}
    assert first == {b: sum(r[0] == b and r[1] < DAY for r in data) for b in (0, 1, 5)}
    # Buyers without movements in a period take no room in its version.
    moved = spark.read.parquet(f"{closings}/rows/kind=delta/version=1")
    assert {r["buyer_id"] for r in moved.collect()} == {0, 1}
