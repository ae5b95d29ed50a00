"""Queries for KPIs and documented commerce analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from commercelake.functions.money import as_money, ratio
from commercelake.operators import checkout, dashboard, finance, kpi, sales
from commercelake.plans.registry import query


def _flag(name):
    return F.when(F.col(name), "true").otherwise("false").alias(name)


def _flag_sql(expression: str) -> str:
    return f"CASE WHEN {expression} THEN 'true' ELSE 'false' END"


def _ratio_sql(num: str, den: str, places: int = 4) -> str:
    return f"CAST(round_even(CAST(({num})::DOUBLE / ({den}) AS DECIMAL(28,12)), {places}) AS DECIMAL(18,{places}))"


# --- KPIs -----------------------------------------------------------------------


@query(
    "m01_cycle_success",
    f"""WITH c AS (SELECT cycle, arg_max(ok, (ts, event_id)) AS done FROM traces GROUP BY 1)
    SELECT count(*) AS started, count(*) FILTER (done) AS done, {_ratio_sql('count(*) FILTER (done)', 'count(*)')} AS rate,
        {_flag_sql(_ratio_sql('count(*) FILTER (done)', 'count(*)') + ' > 0.80')} AS on_target FROM c""",
)
def _(e):
    return kpi.cycle_success(e.traces).select("started", "done", "rate", _flag("on_target"))


_OK_RATE = _ratio_sql("count(*) FILTER (ok)", "count(*)")


@query(
    "m02_phase_success",
    f"""SELECT phase, count(*) AS tried, count(*) FILTER (ok) AS succeeded, {_OK_RATE} AS rate, {_flag_sql(_OK_RATE + ' > 0.85')} AS on_target,
        {_flag_sql(_OK_RATE + ' > 0.80')} AS on_tracing_target FROM traces GROUP BY 1""",
)
def _(e):
    out = kpi.phase_success(e.traces)
    return out.withColumn("on_tracing_target", F.col("rate") > kpi.PHASE_TARGET_TRACING).select(
        "phase", "tried", "succeeded", "rate", _flag("on_target"), _flag("on_tracing_target")
    )


@query(
    "m03_cycle_duration",
    f"""WITH c AS (SELECT cycle, CAST(floor(epoch(max(ts))) - floor(epoch(min(ts))) AS BIGINT) AS seconds FROM traces GROUP BY 1)
    SELECT cycle, seconds, {_flag_sql('seconds < 14400')} AS on_target FROM c""",
)
def _(e):
    return kpi.cycle_duration(e.traces).select("cycle", "seconds", _flag("on_target"))


@query("m04_tokens_per_cycle", "SELECT cycle, CAST(sum(latency) AS DECIMAL(18,2)) AS tokens FROM traces GROUP BY 1")
def _(e):
    return kpi.tokens_per_cycle(e.traces)


_REWORK = _ratio_sql("count(*) FILTER (n > 1)", "count(*)")


@query(
    "m05_rework_rate",
    f"""WITH r AS (SELECT cycle, phase, count(*) AS n FROM traces GROUP BY 1, 2)
    SELECT cycle, count(*) AS phases, count(*) FILTER (n > 1) AS repeated, {_REWORK} AS rate, {_flag_sql(_REWORK + ' < 0.15')} AS on_target FROM r GROUP BY 1""",
)
def _(e):
    return kpi.rework_rate(e.traces).select("cycle", "phases", "repeated", "rate", _flag("on_target"))


_PAID = _ratio_sql("count(*) FILTER (model = 0)", "count(*)")


@query(
    "m06_paid_ratio",
    f"SELECT count(*) AS calls, count(*) FILTER (model = 0) AS paid, {_PAID} AS rate, {_flag_sql(_PAID + ' < 0.10')} AS on_target FROM traces",
)
def _(e):
    return kpi.paid_ratio(e.traces).select("calls", "paid", "rate", _flag("on_target"))


def _quantile(p: float, where: str = "") -> str:
    return f"quantile_cont(CAST(latency * 100 AS BIGINT), {p}){where}"


@query(
    "m07_latency_percentiles",
    "SELECT phase, model, "
    + ", ".join(f"CAST(round({_quantile(p / 100)}, 2) AS DECIMAL(18,2)) AS p{p}" for p in (50, 95, 99))
    + " FROM traces GROUP BY 1, 2",
)
def _(e):
    return kpi.latency_percentiles(e.traces)


@query(
    "m08_error_rate",
    f"SELECT phase, count(*) AS calls, count(*) FILTER (NOT ok) AS errors, {_ratio_sql('count(*) FILTER (NOT ok)', 'count(*)')} AS rate FROM traces GROUP BY 1",
)
def _(e):
    return kpi.error_rate(e.traces)


@query(
    "m09_daily_volume",
    f"""SELECT strftime(ts, '%Y-%m-%d') AS day, model, phase, count(*) AS calls, {_ratio_sql('sum(latency * 100)', 'count(*) * 100')} AS avg_latency
    FROM traces GROUP BY 1, 2, 3""",
)
def _(e):
    return kpi.daily_volume(e.traces)


_DAILY_SQL = f"""daily AS (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (ok) * 100.0 / count(*) AS uptime,
    {_quantile(0.95)} / 100 AS latency_p95, count(*) FILTER (NOT ok) * 100.0 / count(*) AS error_rate FROM traces GROUP BY 1)"""


@query(
    "m10_threshold_status",
    f"""WITH {_DAILY_SQL} SELECT day, 'uptime' AS metric, CASE WHEN uptime < 99 THEN 'ALERT' WHEN uptime > 99.5 THEN 'OK' ELSE 'WARN' END AS status FROM daily
    UNION ALL SELECT day, 'latency_p95', CASE WHEN latency_p95 > 1000 THEN 'ALERT' WHEN latency_p95 < 500 THEN 'OK' ELSE 'WARN' END FROM daily
    UNION ALL SELECT day, 'error_rate', CASE WHEN error_rate > 5 THEN 'ALERT' WHEN error_rate < 1 THEN 'OK' ELSE 'WARN' END FROM daily""",
)
def _(e):
    return kpi.threshold_status(kpi.daily_metrics(e.traces)).select("day", "metric", "status")


HALF = "2024-01-16 00:00:00"


@query(
    "m11_hypothesis_verdict",
    f"""WITH a AS (SELECT phase, sum(latency * 100) FILTER (ts < '{HALF}')::DOUBLE / count(*) FILTER (ts < '{HALF}') AS b,
            sum(latency * 100) FILTER (ts >= '{HALF}')::DOUBLE / count(*) FILTER (ts >= '{HALF}') AS a FROM traces GROUP BY 1),
    d AS (SELECT phase, CAST(round((b - a) / b, 4) AS DECIMAL(18,4)) AS drop FROM a)
    SELECT phase, drop, CASE WHEN drop >= 0.30 THEN 'confirmed' WHEN drop < 0.125 THEN 'refuted' ELSE 'partial' END AS verdict FROM d""",
)
def _(e):
    return kpi.hypothesis_verdict(e.traces, HALF)


_LATER = f" FILTER (ts >= '{HALF}')"
_SUCCESS = _ratio_sql(f"count(*) FILTER (ok AND ts >= '{HALF}')", f"count(*){_LATER}")


@query(
    "m12_baseline_trigger",
    f"""SELECT phase, model, {_SUCCESS} AS success, {_flag_sql(f"{_quantile(0.95, _LATER)} > 1.05 * {_quantile(0.95, f" FILTER (ts < '{HALF}')")}")} AS slow,
        {_flag_sql(_SUCCESS + ' < 0.89')} AS failing FROM traces GROUP BY 1, 2""",
)
def _(e):
    out = kpi.baseline_trigger(e.traces, HALF, factor=1.05, min_success=0.89)
    return out.select("phase", "model", "success", _flag("slow"), _flag("failing"))


_KIND_SQL = "CASE WHEN item_id % 40 = 0 THEN 'critical_bug' WHEN item_id % 23 = 0 THEN 'security' WHEN item_id % 5 = 0 THEN 'blocking_debt' WHEN item_id % 3 = 0 THEN 'bug' ELSE 'improvement' END"


def _opportunities(e):
    i = F.col("item_id")
    kind = (
        F.when(i % 40 == 0, "critical_bug")
        .when(i % 23 == 0, "security")
        .when(i % 5 == 0, "blocking_debt")
        .when(i % 3 == 0, "bug")
        .otherwise("improvement")
    )
    return e.items.select(
        i.alias("id"),
        "category",
        kind.alias("kind"),
        (i % 10 + 1).alias("impact"),
        (F.col("stock") % 10 + 1).cast("bigint").alias("confidence"),
        (i % 7 + 1).alias("ease"),
    )


@query(
    "m13_ice_score",
    f"""WITH o AS (SELECT item_id AS id, {_KIND_SQL} AS kind, item_id % 10 + 1 AS i, stock % 10 + 1 AS c, item_id % 7 + 1 AS e FROM items),
    s AS (SELECT id, kind, CASE kind WHEN 'critical_bug' THEN 999 WHEN 'security' THEN 998 WHEN 'blocking_debt' THEN greatest(i, 8) * c * e ELSE i * c * e END AS score FROM o)
    SELECT id, kind, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s""",
)
def _(e):
    return kpi.ice_score(_opportunities(e)).select("id", "kind", "score", "rank")


@query(
    "m14_route_opportunity",
    f"""WITH o AS (SELECT item_id AS id, category, {_KIND_SQL} AS kind FROM items)
    SELECT id, CASE WHEN bool_or(kind = 'critical_bug') OVER (PARTITION BY category) OR kind = 'bug' THEN 'spec' ELSE 'discovery' END AS next FROM o""",
)
def _(e):
    return kpi.route_opportunity(_opportunities(e), "category").select("id", "next")


@query(
    "m15_recurring_errors",
    f"""WITH l AS (SELECT 'code_' || (k % 10) AS type FROM activity WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50)
    SELECT type, count(*) AS errors, {_flag_sql('count(*) > 1')} AS recurring FROM l GROUP BY 1""",
)
def _(e):
    errors = e.activity.where("event_type = 'error'").select(
        "ts", "event_id", F.concat(F.lit("code_"), (F.col("k") % 10).cast("string")).alias("type")
    )
    return kpi.recurring_errors(errors).select("type", "errors", _flag("recurring"))


_QUALITY = _ratio_sql("sum(1 + 4 * quality - toxic)", "count(*)")


@query(
    "m16_quality_score",
    f"SELECT source, count(*) AS rated, {_QUALITY} AS average, {_flag_sql(_QUALITY + ' > 3.5')} AS on_target FROM labels JOIN documents USING (doc_id) GROUP BY 1",
)
def _(e):
    scores = e.labels.join(e.documents.select("doc_id", "source"), "doc_id").select(
        "source", (F.lit(1) + F.col("quality") * 4 - F.col("toxic")).alias("score")
    )
    return kpi.quality_score(scores, "source").select("source", "rated", "average", _flag("on_target"))


@query(
    "m17_slow_phases",
    f"SELECT phase, {_ratio_sql('sum(latency * 100)', 'count(*) * 100')} AS avg_latency FROM traces GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
)
def _(e):
    return kpi.slow_phases(e.traces)


@query(
    "w06_percent_change",
    """WITH d AS (SELECT phase, strftime(ts, '%Y-%m-%d') AS day, count(*) AS calls FROM traces GROUP BY 1, 2),
    l AS (SELECT *, lag(calls) OVER (PARTITION BY phase ORDER BY day) AS before FROM d)
    SELECT phase, day, calls, CAST(round((calls - before) * 100.0::DOUBLE / before, 2) AS DECIMAL(18,2)) AS change_pct FROM l WHERE before IS NOT NULL""",
)
def _(e):
    return kpi.percent_change(e.traces)


@query(
    "w07_green_streak",
    """WITH d AS (SELECT CAST(ts AS DATE) AS day FROM traces GROUP BY 1 HAVING count(*) FILTER (NOT ok) * 100 < count(*) * 15),
    i AS (SELECT day, day - CAST(row_number() OVER (ORDER BY day) AS INT) AS island FROM d)
    SELECT strftime(min(day), '%Y-%m-%d') AS first_day, strftime(max(day), '%Y-%m-%d') AS last_day, count(*) AS days FROM i GROUP BY island HAVING count(*) >= 7""",
)
def _(e):
    days = e.traces.groupBy(F.col("ts").cast("date").alias("day")).agg(
        (F.count_if(~F.col("ok")) * 100 < F.count("*") * 15).alias("green")
    )
    out = kpi.green_streak(days)
    return out.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in ("first_day", "last_day")], "days")


@query(
    "w08_stable_cycles",
    f"""WITH r AS (SELECT cycle, strftime(ts, '%Y-%m-%d') AS day, {_OK_RATE} AS rate FROM traces GROUP BY 1, 2)
    SELECT cycle, day, rate, {_flag_sql('count(*) OVER w = 3 AND min(rate) OVER w > 0.85')} AS stable FROM r
    WINDOW w AS (PARTITION BY cycle ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def _(e):
    rates = e.traces.groupBy("cycle", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        ratio(F.count_if("ok"), F.count("*")).alias("rate")
    )
    return kpi.stable_cycles(rates, "cycle", "day").select("cycle", "day", "rate", _flag("stable"))


@query(
    "g18_cost_per_feature",
    """WITH p AS (SELECT phase, CASE WHEN model = 0 THEN 'paid' ELSE 'local' END AS route, CASE WHEN model = 0 THEN 0.02 ELSE 0 END AS c FROM traces)
    SELECT CASE WHEN grouping(phase) = 1 THEN 'TOTAL' ELSE phase END AS phase, CASE WHEN grouping(route) = 1 THEN 'TOTAL' ELSE route END AS route,
        count(*) AS calls, CAST(sum(c) AS DECIMAL(18,2)) AS cost FROM p GROUP BY ROLLUP (phase, route)""",
)
def _(e):
    return kpi.cost_per_feature(e.traces, {0: 2})


# --- commerce -------------------------------------------------------------------

_DEMAND_SQL = """demand AS (SELECT i.item_id, coalesce(a.n, 0) AS searches, coalesce(b.n, 0) AS sold, coalesce(c.n, 0) AS liked,
        4 * coalesce(a.n, 0) + 3 * coalesce(b.n, 0) + 3 * coalesce(c.n, 0) AS score FROM items i
    LEFT JOIN (SELECT item_id, count(*) AS n FROM navigation WHERE ts > (SELECT max(ts) FROM navigation) - INTERVAL 24 HOURS GROUP BY 1) a USING (item_id)
    LEFT JOIN (SELECT item_id, count(*) AS n FROM sales GROUP BY 1) b USING (item_id)
    LEFT JOIN (SELECT item_id, count(*) AS n FROM reviews WHERE stars >= 4 GROUP BY 1) c USING (item_id))"""


@query("c01_demand_score", f"WITH {_DEMAND_SQL} SELECT * FROM demand")
def _(e):
    return finance.demand_score(e.items, e.navigation, e.sales, e.reviews)


@query("k06_feed_by_demand", f"WITH {_DEMAND_SQL} SELECT item_id, score FROM demand ORDER BY score DESC, item_id LIMIT 50")
def _(e):
    return finance.feed_by_demand(finance.demand_score(e.items, e.navigation, e.sales, e.reviews), 50).select("item_id", "score")


_STAGES = ["view", "click", "signup", "purchase"]


@query(
    "c02_funnel",
    "WITH f AS (SELECT "
    + ", ".join(f"count(*) FILTER (event_type = '{s}') AS {s}s" for s in _STAGES)
    + " FROM activity) SELECT *, "
    + ", ".join(f"{_ratio_sql(b + 's', a + 's')} AS {b}_rate" for a, b in zip(_STAGES, _STAGES[1:]))
    + " FROM f",
)
def _(e):
    return finance.funnel(e.activity, _STAGES)


@query(
    "c03_seller_finance",
    f"""SELECT seller_id, CAST(sum(amount) AS DECIMAL(18,2)) AS gross, CAST(sum(amount - commission) AS DECIMAL(18,2)) AS net,
        count(DISTINCT order_id) AS orders, {_ratio_sql('sum(amount) * 100', 'count(DISTINCT order_id) * 100', 2)} AS average_ticket FROM splits GROUP BY 1""",
)
def _(e):
    return finance.seller_finance(e.sales, e.sellers)


@query(
    "c04_escrow_status",
    """WITH o AS (SELECT *, (SELECT max(delivered_on) FROM orders_placed) AS today FROM orders_placed),
    e AS (SELECT s.seller_id, s.amount - s.commission AS net, CASE WHEN s.order_id IN (SELECT order_id FROM returns) THEN 'frozen'
        WHEN today - delivered_on < 8 THEN 'held' ELSE 'available' END AS escrow FROM splits s JOIN o USING (order_id))
    SELECT seller_id, escrow, count(*) AS sales, CAST(sum(net) AS DECIMAL(18,2)) AS net FROM e GROUP BY 1, 2""",
)
def _(e):
    today = e.orders_placed.agg(F.max("delivered_on")).scalar()
    out = finance.escrow_totals(e.sales, e.sellers, e.orders_placed, e.returns, today)
    return out.select("seller_id", "escrow", "sales", as_money(F.col("net_cents")).alias("net"))


_STARS = _ratio_sql("sum(stars) * 4 + count(*) FILTER (NOT returned AND NOT complaint) * 30", "count(*) * 10")


@query(
    "c05_reputation_stars",
    f"SELECT seller_id, {_STARS} AS score, {_flag_sql(_STARS + ' < 3.5')} AS penalised FROM reviews GROUP BY 1",
)
def _(e):
    return dashboard.reputation_stars(e.reviews).select("seller_id", "score", _flag("penalised"))


@query(
    "c06_monthly_tier",
    f"""WITH r AS (SELECT seller_id, {_STARS} AS score FROM reviews GROUP BY 1),
    m AS (SELECT seller_id, strftime(sold_on, '%Y-%m') AS month, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue FROM sales GROUP BY 1, 2)
    SELECT seller_id, month, revenue, CASE WHEN revenue >= 600000 AND score >= 3 THEN 5 WHEN revenue >= 400000 AND score >= 2.5 THEN 4
        WHEN revenue >= 250000 AND score >= 2 THEN 3 WHEN revenue >= 100000 AND score >= 1 THEN 2 ELSE 1 END AS tier FROM m LEFT JOIN r USING (seller_id)""",
)
def _(e):
    tiers = [(5, 60_000_000, 3.0), (4, 40_000_000, 2.5), (3, 25_000_000, 2.0), (2, 10_000_000, 1.0), (1, 0, 0.0)]
    return finance.monthly_tier(e.sales, dashboard.reputation_stars(e.reviews), tiers)


@query(
    "c07_sponsored_feed",
    f"""WITH o AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM items WHERE active),
    a AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS n FROM items WHERE NOT active)
    SELECT n + (n - 1) // 4 AS slot, item_id, 'false' AS sponsored FROM o
    UNION ALL SELECT n * 5, item_id, 'true' FROM a WHERE n <= (SELECT count(*) // 4 FROM o)""",
)
def _(e):
    rows = e.items.select("item_id", "active", F.col("item_id").alias("place"))
    out = finance.sponsored_feed(rows.where("active"), rows.where("NOT active"), "place")
    return out.select("slot", "item_id", _flag("sponsored"))


@query(
    "c08_cashback_release",
    f"""SELECT order_id, buyer_id, CAST(round_even(total * 0.01, 2) AS DECIMAL(18,2)) AS cashback, strftime(delivered_on + 7, '%Y-%m-%d') AS release_on,
        {_flag_sql("delivered_on + 7 <= DATE '2000-01-01'")} AS released FROM orders_placed JOIN buyers USING (buyer_id) WHERE is_prime""",
)
def _(e):
    out = finance.cashback_release(e.orders_placed, e.buyers, F.lit("2000-01-01").cast("date"))
    return out.select("order_id", "buyer_id", "cashback", F.date_format("release_on", "yyyy-MM-dd").alias("release_on"), _flag("released"))


@query(
    "c09_subscription_charges",
    """WITH m AS (SELECT buyer_id, DATE '2024-01-01' + CAST(buyer_id % 365 AS INT) AS starts_on FROM buyers WHERE is_prime)
    SELECT buyer_id, strftime(unnest(generate_series(date_trunc('month', starts_on), TIMESTAMP '2024-12-31', INTERVAL 1 MONTH)), '%Y-%m-%d') AS month,
        CAST(5 AS DECIMAL(18,2)) AS charge FROM m""",
)
def _(e):
    start = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("buyer_id") % 365).cast("int"))
    members = e.buyers.where("is_prime").select("buyer_id", start.alias("starts_on"), F.lit("2024-12-31").cast("date").alias("ends_on"))
    return finance.subscription_charges(members).withColumn("month", F.date_format("month", "yyyy-MM-dd"))


@query(
    "c12_float_yield",
    """WITH d AS (SELECT CAST(unnest(generate_series(delivered_on, delivered_on + 7, INTERVAL 1 DAY)) AS DATE) AS day, total FROM orders_placed)
    SELECT strftime(day, '%Y-%m-%d') AS day, CAST(sum(total) AS DECIMAL(18,2)) AS held, CAST(sum(total) * 0.0001 AS DECIMAL(18,4)) AS yield FROM d GROUP BY 1""",
)
def _(e):
    return finance.float_yield(e.orders_placed, rate_per_million=100).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "c13_money_timeline",
    """WITH p AS (SELECT seller_id, 0 AS day, 'commission' AS posting, commission AS amount FROM splits
        UNION ALL SELECT seller_id, 0, 'escrow_hold', amount - commission FROM splits
        UNION ALL SELECT seller_id, 8, 'seller_release', amount - commission FROM splits
        UNION ALL SELECT seller_id, 8, 'buyer_cashback', round_even(amount * 0.01, 2) FROM splits)
    SELECT seller_id, day, posting, CAST(sum(amount) AS DECIMAL(18,2)) AS amount FROM p GROUP BY 1, 2, 3""",
)
def _(e):
    postings = sales.money_timeline_totals(e.sales, e.sellers)
    return postings.groupBy("seller_id", "day", "posting").agg(as_money(F.sum("cents")).alias("amount"))


@query(
    "c14_recommendations",
    """WITH b AS (SELECT buyer_id, category, count(*) AS views FROM navigation JOIN items USING (item_id) GROUP BY 1, 2)
    SELECT buyer_id, row_number() OVER (PARTITION BY buyer_id ORDER BY views DESC, category, i.item_id) AS position, i.item_id, category
    FROM b JOIN (SELECT * FROM items WHERE active) i USING (category) QUALIFY position <= 5""",
)
def _(e):
    return finance.recommendations(e.navigation, e.items)


@query(
    "c14_visited_recommendations",
    "SELECT buyer_id, CASE WHEN buyer_id IN (SELECT buyer_id FROM navigation) THEN 'all_items' ELSE 'starter' END AS product_list FROM buyers",
)
def _(e):
    return finance.visited_recommendations(e.navigation, e.buyers)


@query(
    "c15_savings",
    """SELECT buyer_id, count(*) AS free_shipments, CAST(sum(round_even(7.25 * CASE WHEN total > 100 THEN 1.10 ELSE 1.00 END, 2)) AS DECIMAL(18,2)) AS saved
    FROM orders_placed JOIN buyers USING (buyer_id) WHERE is_prime AND total > 21 GROUP BY 1""",
)
def _(e):
    return checkout.savings(e.orders_placed, e.buyers)


_PROGRESS = _ratio_sql("sum(amount)", "500000")


@query(
    "c16_goal_progress",
    f"""SELECT 'month' AS unit, seller_id, strftime(date_trunc('month', sold_on), '%Y-%m-%d') AS period, CAST(sum(amount) AS DECIMAL(18,2)) AS revenue,
        least({_PROGRESS}, 1.0000) AS progress FROM sales GROUP BY ALL
    UNION ALL SELECT 'week', seller_id, strftime(date_trunc('week', sold_on), '%Y-%m-%d'), CAST(sum(amount) AS DECIMAL(18,2)),
        least({_PROGRESS}, 1.0000) FROM sales GROUP BY ALL""",
)
def _(e):
    parts = [finance.goal_progress(e.sales, 50_000_000, unit).withColumn("unit", F.lit(unit)) for unit in ("month", "week")]
    return parts[0].unionByName(parts[1])


@query(
    "j16_view_to_purchase",
    """SELECT event_id, buyer_id, amount, CAST(epoch_us(bought_at) - epoch_us(last_view) AS BIGINT) // 1000000 AS age_seconds FROM (
        SELECT event_id, user_id AS buyer_id, value AS amount, ts AS bought_at, event_type, max(CASE WHEN event_type = 'view' THEN ts END) OVER (
            PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_view FROM activity)
    WHERE event_type = 'purchase' AND last_view >= bought_at - INTERVAL 1 HOUR""",
)
def _(e):
    return finance.attributed_purchases(e.activity)
