"""Streaming queries, run over all events that are there, checked against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from commercelake.functions.money import as_money
from commercelake.operators import checkout
from commercelake.plans.commerce import _FOLD, _METRICS
from commercelake.plans.registry import query
from commercelake.streaming import jobs
from commercelake.streaming.runner import StreamEntities, appended, updated


def _live(e) -> StreamEntities:
    return StreamEntities(e.spark, e.folder)


def _stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query("st01_checkout_metrics", _METRICS)
def _(e):
    return updated(jobs.live_checkout_metrics(checkout.classify(_live(e).checkouts)), [])


def _alert_sql(source: str, failed: str, width: str, limit: float, level: str) -> str:
    return f"""WITH w AS (SELECT time_bucket(INTERVAL '{width}', ts) AS b, count(*) AS events, count(*) FILTER ({failed}) AS failures FROM {source} GROUP BY 1),
    r AS (SELECT *, CAST(round_even(CAST(failures::DOUBLE / events AS DECIMAL(28,12)), 4) AS DECIMAL(18,4)) AS rate FROM w)
    SELECT strftime(b, '%Y-%m-%d %H:%M:%S') AS window_start, events, failures, rate, CASE WHEN rate > {limit} THEN '{level}' ELSE 'OK' END AS level FROM r"""


@query("st02_error_rate_alert", _alert_sql("activity", "event_type = 'error'", "15 minutes", 0.05, "CRITICAL"))
def _(e):
    out = updated(jobs.error_rate_alert(_live(e).activity), ["window_start"])
    return out.withColumn("window_start", _stamp("window_start"))


@query(
    "st03_hourly_demand",
    """WITH h AS (SELECT item_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM navigation GROUP BY 1, 2),
    x AS (SELECT item_id, hour + to_hours(CAST(i AS INT)) AS as_of, n FROM h, range(1, 25) r(i))
    SELECT item_id, strftime(as_of, '%Y-%m-%d %H:%M:%S') AS as_of, CAST(sum(n) AS BIGINT) AS searches, CAST(4 * sum(n) AS BIGINT) AS score FROM x GROUP BY 1, 2""",
)
def _(e):
    out = jobs.demand(updated(jobs.hourly_searches(_live(e).navigation), ["item_id", "hour"]))
    return out.withColumn("as_of", _stamp("as_of"))


@query(
    "st04_navigation_sessions",
    """WITH g AS (SELECT *, ts >= lag(ts) OVER (PARTITION BY buyer_id ORDER BY ts, event_id) + INTERVAL 30 MINUTES AS fresh FROM navigation),
    s AS (SELECT buyer_id, ts, sum(CASE WHEN coalesce(fresh, true) THEN 1 ELSE 0 END) OVER (PARTITION BY buyer_id ORDER BY ts, event_id) AS s FROM g),
    c AS (SELECT buyer_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTES AS b, count(*) AS events FROM s GROUP BY buyer_id, s)
    SELECT buyer_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS started_at, strftime(b, '%Y-%m-%d %H:%M:%S') AS ends_at, events FROM c
    WHERE b <= (SELECT max(ts) FROM navigation) - INTERVAL 15 MINUTES""",
)
def _(e):
    out = appended(jobs.navigation_sessions(_live(e).navigation))
    return out.withColumn("started_at", _stamp("started_at")).withColumn("ends_at", _stamp("ends_at"))


@query("st05_ingest_once", "SELECT event_id, event_type FROM events")
def _(e):
    twice = _live(e).activity.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    return appended(jobs.ingest_once(twice)).select("event_id", "event_type")


@query(
    "st06_live_wallet",
    _FOLD
    + """ SELECT buyer_id, CAST(arg_max(balance, n) AS DECIMAL(18,2)) AS balance, count(*) FILTER (accepted) AS accepted,
        count(*) FILTER (NOT accepted) AS refused FROM f GROUP BY 1""",
)
def _(e):
    out = updated(jobs.live_wallet(_live(e).ledger), ["buyer_id"])
    return out.select("buyer_id", as_money(F.col("balance_cents")).alias("balance"), "accepted", "refused")


@query("st07_retained_daily", "SELECT strftime(ts, '%Y-%m-%d 00:00:00') AS day, count(*) AS events FROM events GROUP BY 1")
def _(e):
    return updated(jobs.retained_daily(_live(e).activity), ["day"]).withColumn("day", _stamp("day"))


@query("st08_payment_failure_alert", _alert_sql("decided", "decision <> 'approved'", "1 hour", 0.01, "ALERT"))
def _(e):
    out = updated(jobs.payment_failure_alert(checkout.classify(_live(e).checkouts)), ["window_start"])
    return out.withColumn("window_start", _stamp("window_start"))


@query(
    "st09_live_attribution",
    """SELECT event_id, buyer_id, amount, CAST(epoch_us(bought_at) - epoch_us(last_view) AS BIGINT) // 1000000 AS age_seconds FROM (
        SELECT event_id, user_id AS buyer_id, value AS amount, ts AS bought_at, event_type, max(CASE WHEN event_type = 'view' THEN ts END) OVER (
            PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM activity)
    WHERE event_type = 'purchase' AND last_view >= bought_at - INTERVAL 1 HOUR""",
)
def _(e):
    out = updated(jobs.live_attribution(_live(e).activity, mode="Update"), ["event_id"])
    return out.select("event_id", "buyer_id", as_money(F.col("value_cents")).alias("amount"), "age_seconds")
