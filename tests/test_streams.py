"""Streams fed in several batches must agree with the batch SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import oracle_sql
from commercelake.functions.money import as_money
from commercelake.operators import checkout, wallet
from commercelake.session import shared_path
from commercelake.sources.entities import Entities
from commercelake.sources.tables import SCHEMAS
from commercelake.streaming import jobs, waiting
from commercelake.streaming.runner import StreamEntities, appended, updated
from tests.oracle import TESTDATA, compare, connect


@pytest.fixture(scope="module")
def live(spark):
    """The events in five files, in time order, read one per batch."""
    folder = shared_path(spark, "events-in-parts")
    events = spark.read.schema(SCHEMAS["events"]).parquet(f"{TESTDATA}/sf0.001/events.parquet")
    for part in range(5):
        days = F.dayofmonth("ts")
        rows = events.where((days > part * 6) & (days <= part * 6 + 6)) if part < 4 else events.where(days > 24)
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    return StreamEntities(spark, folder, files_per_batch=1)


@pytest.fixture(scope="module")
def con():
    return connect(f"{TESTDATA}/sf0.001")


def _stamped(df, *names):
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


def test_metrics(live, con):
    out = updated(jobs.live_checkout_metrics(checkout.classify(live.checkouts)), [])
    assert compare(out, con, oracle_sql()["st01_checkout_metrics"]) is None


def test_error_windows(live, con):
    out = updated(jobs.error_rate_alert(live.activity), ["window_start"])
    assert compare(_stamped(out, "window_start"), con, oracle_sql()["st02_error_rate_alert"]) is None


def test_demand(live, con):
    out = jobs.demand(updated(jobs.hourly_searches(live.navigation), ["item_id", "hour"]))
    assert compare(_stamped(out, "as_of"), con, oracle_sql()["st03_hourly_demand"]) is None


def test_sessions(live, con):
    out = appended(jobs.navigation_sessions(live.navigation))
    assert compare(_stamped(out, "started_at", "ends_at"), con, oracle_sql()["st04_navigation_sessions"]) is None


def test_wallet(live, con):
    out = updated(jobs.live_wallet(live.ledger), ["buyer_id"])
    out = out.select("buyer_id", as_money(F.col("balance_cents")).alias("balance"), "accepted", "refused")
    assert compare(out, con, oracle_sql()["st06_live_wallet"]) is None


def test_attribution(live, con):
    out = appended(jobs.live_attribution(live.activity))
    out = out.select("event_id", "buyer_id", as_money(F.col("value_cents")).alias("amount"), "age_seconds")
    assert compare(out, con, oracle_sql()["st09_live_attribution"]) is None


@pytest.fixture(scope="module")
def shuffled(spark):
    """The events in four files, later days first, and half of all rows by one buyer: folder and rows."""
    folder = shared_path(spark, "events-out-of-order")
    events = spark.read.schema(SCHEMAS["events"]).parquet(f"{TESTDATA}/sf0.001/events.parquet")
    events = events.withColumn("user_id", F.when(F.col("event_id") % 2 == 0, 7).otherwise(F.col("user_id")))
    events.write.parquet(f"{folder}/all/events.parquet")
    for part in (1, 0, 3, 2):
        rows = events.where((F.hour("ts") % 2 == part % 2) & ((F.dayofmonth("ts") <= 15) == (part < 2)))
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/parts/events.parquet")
    return folder


@pytest.mark.parametrize("delay", ["40 days", "16 days"])
def test_wallet_in_any_order_within_the_watermark(spark, shuffled, delay, monkeypatch):
    monkeypatch.setattr(waiting, "PIECE", 50)
    live = StreamEntities(spark, f"{shuffled}/parts", files_per_batch=1)
    out = updated(jobs.live_wallet(live.ledger, delay, groups=3), ["buyer_id"])
    want = wallet.wallet_fold(Entities(spark, f"{shuffled}/all").ledger).select("buyer_id", "balance", "accepted", "refused")
    got = out.select("buyer_id", as_money(F.col("balance_cents")).alias("balance"), "accepted", "refused")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("delay", ["40 days", "16 days"])
def test_attribution_in_any_order_within_the_watermark(spark, shuffled, delay):
    live = StreamEntities(spark, f"{shuffled}/parts", files_per_batch=1)
    out = updated(jobs.live_attribution(live.activity, delay, groups=3, mode="Update"), ["event_id"])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{shuffled}/all/events.parquet/*.parquet')")
    out = out.select("event_id", "buyer_id", as_money(F.col("value_cents")).alias("amount"), "age_seconds")
    assert compare(out, con, oracle_sql()["st09_live_attribution"]) is None


def test_a_second_run_goes_on_where_the_first_ended(spark):
    folder, table = shared_path(spark, "growing"), shared_path(spark, "wallets")
    spent = []
    for part, (kind, value) in enumerate([("signup", 50.0), ("purchase", 30.0), ("purchase", 30.0)]):
        row = spark.createDataFrame([(part, 7, kind, value)], "event_id bigint, user_id bigint, event_type string, value double")
        ts = F.lit(f"2024-01-0{part + 1} 00:00:00").cast("timestamp_ntz")
        row = row.select("event_id", ts.alias("ts"), "user_id", "event_type", "value", F.lit('{"k": 1}').alias("props"))
        row.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
        out = updated(jobs.live_wallet(StreamEntities(spark, folder).ledger), ["buyer_id"], table).first()
        spent.append((out["balance_cents"], out["accepted"], out["refused"]))
    assert spent == [(5000, 1, 0), (2000, 2, 0), (2000, 2, 1)]
    # Without new events the last versions stand.
    again = updated(jobs.live_wallet(StreamEntities(spark, folder).ledger), ["buyer_id"], table).first()
    assert (again["balance_cents"], again["accepted"], again["refused"]) == spent[-1]


def test_rows_later_than_the_retention_are_dropped(spark):
    folder = shared_path(spark, "late")
    for ts, event_id in (("2024-06-01 00:00:00", 1), ("2024-06-02 00:00:00", 2), ("2024-04-01 00:00:00", 3), ("2024-01-01 00:00:00", 4)):
        row = spark.createDataFrame([(event_id,)], "event_id bigint").select(
            "event_id", F.lit(ts).cast("timestamp_ntz").alias("ts"), F.lit(1).cast("bigint").alias("user_id"),
            F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props"),
        )
        row.coalesce(1).write.mode("append").parquet(f"{folder}/events.parquet")
    stream = StreamEntities(spark, folder, files_per_batch=1)
    days = {str(r["day"])[:10] for r in updated(jobs.retained_daily(stream.activity), ["day"]).collect()}
    assert days == {"2024-06-01", "2024-06-02", "2024-04-01"}
