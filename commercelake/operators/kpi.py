"""KPIs over call traces, with the documented targets and alert rules.

Traces: event_id, ts, phase, cycle, latency_cents, ok, model.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercelake.functions.money import as_money, ratio
from commercelake.operators.ordered import numbered, with_range
from commercelake.operators.skew import salted_join

# Documented targets.
CYCLE_TARGET = 0.80
PHASE_TARGET = 0.85
PHASE_TARGET_TRACING = 0.80
REWORK_TARGET = 0.15
PAID_TARGET = 0.10
CYCLE_SECONDS = 4 * 3600
GREEN_DAYS = 7
STABLE_RATE = 0.85
STABLE_CYCLES = 3
QUALITY_TARGET = 3.5
CONFIRMED_DROP = 0.30
REFUTED_DROP = 0.125
ICE_CRITICAL = 999
ICE_SECURITY = 998
BLOCKING_IMPACT = 8

# Metric -> (target, alert, higher is better).
THRESHOLDS = {
    "uptime": (99.5, 99.0, True),
    "latency_p95": (500.0, 1000.0, False),
    "error_rate": (1.0, 5.0, False),
    "gpu_memory": (90.0, 95.0, False),
    "memory": (80.0, 90.0, False),
    "disk": (80.0, 90.0, False),
}


def cycle_success(traces: DataFrame) -> DataFrame:
    """Cycles started and done (last call ok), and the share against its target."""
    cycles = traces.groupBy("cycle").agg(F.max_by("ok", F.struct("ts", "event_id")).alias("done"))
    out = cycles.agg(F.count("*").alias("started"), F.count_if("done").alias("done"))
    rate = ratio(F.col("done"), F.col("started"))
    return out.withColumn("rate", rate).withColumn("on_target", F.col("rate") > CYCLE_TARGET)


def phase_success(traces: DataFrame, target: float = PHASE_TARGET) -> DataFrame:
    out = traces.groupBy("phase").agg(F.count("*").alias("tried"), F.count_if("ok").alias("succeeded"))
    return out.withColumn("rate", ratio(F.col("succeeded"), F.col("tried"))).withColumn("on_target", F.col("rate") > target)


def cycle_duration(traces: DataFrame) -> DataFrame:
    seconds = F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))
    return traces.groupBy("cycle").agg(seconds.alias("seconds")).withColumn("on_target", F.col("seconds") < CYCLE_SECONDS)


def tokens_per_cycle(traces: DataFrame) -> DataFrame:
    return traces.groupBy("cycle").agg(as_money(F.sum("latency_cents")).alias("tokens"))


def rework_rate(traces: DataFrame) -> DataFrame:
    """Share of a cycle's phases that ran more than once."""
    runs = traces.groupBy("cycle", "phase").agg(F.count("*").alias("runs"))
    out = runs.groupBy("cycle").agg(F.count("*").alias("phases"), F.count_if(F.col("runs") > 1).alias("repeated"))
    return out.withColumn("rate", ratio(F.col("repeated"), F.col("phases"))).withColumn("on_target", F.col("rate") < REWORK_TARGET)


def paid_ratio(traces: DataFrame, paid_model: int = 0) -> DataFrame:
    out = traces.agg(F.count("*").alias("calls"), F.count_if(F.col("model") == paid_model).alias("paid"))
    return out.withColumn("rate", ratio(F.col("paid"), F.col("calls"))).withColumn("on_target", F.col("rate") < PAID_TARGET)


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys, NULLs equal; a semi or anti join, or an inner or left one without the right side's keys."""
    renamed = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = reduce(and_, [left[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys])
    return left.join(renamed, same, how).drop(*[f"_k_{k}" for k in keys])


def values_by_range(df: DataFrame, keys: list[str], value: str, sums: dict[str, Column] | None = None) -> DataFrame:
    """keys, _v (a value), _n (its rows), the sums and _range: values of all groups cut into ranges of about equal numbers."""
    counts = [F.count(value).alias("_n"), *[F.sum(c).alias(n) for n, c in (sums or {}).items()]]
    by_value = df.groupBy(*keys, F.col(value).alias("_v")).agg(*counts)
    ranges = 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return with_range(by_value, ["_v"], ranges, draw=by_value.columns)


def percentiles(df: DataFrame, keys: list[str], value: str, levels: dict[str, float], sums: dict[str, Column] | None = None) -> DataFrame:
    """Exact interpolated percentiles per group, one column per level, from one read of df.

    Rows are counted per value, and values are cut into ranges, which are put in order each by
    itself. Of the ranges of a group only their counts meet: they show which range holds each wanted
    place, and the value is picked there. So no task takes a whole group. With `sums`, columns to be
    summed per group, groups without a value stay, with NULL percentiles; else they are left out.
    """
    sums = sums or {}
    # Rows without a value keep their group, at a count of 0.
    cut = values_by_range(df, keys, value, sums)
    group = Window.partitionBy(*keys)
    before = group.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, "_range").agg(F.sum("_n").alias("_here"), *[F.sum(n).alias(n) for n in sums])
    totals = totals.select(
        *keys, "_range", "_here", F.sum("_here").over(group).alias("_all"), F.coalesce(F.sum("_here").over(before), F.lit(0)).alias("_ahead"),
        *[F.sum(n).over(group).alias(n) for n in sums],
    )

    def place(p: float) -> Column:
        return (F.col("_all") - 1) * F.lit(p)

    ends = {f"_{end}_{n}": f(place(p)) for n, p in levels.items() for end, f in (("low", F.floor), ("high", F.ceil))}
    holds = [(F.col("_ahead") <= at) & (at < F.col("_ahead") + F.col("_here")) for at in ends.values()]
    wanted = totals.where(reduce(or_, holds) | (F.col("_all") == 0) if sums else reduce(or_, holds)).drop("_here")
    within = Window.partitionBy(*keys, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = _same(cut.select(*keys, "_range", "_v", "_n"), wanted, [*keys, "_range"], "inner")
    placed = placed.withColumn("_upto", F.col("_ahead") + F.sum("_n").over(within))
    # The least value past a place is in the range that holds the place; ranges after it have larger ones.
    picked = placed.groupBy(*keys, "_all", *sums).agg(*[F.min(F.when(F.col("_upto") > at, F.col("_v"))).alias(n) for n, at in ends.items()])

    def between(n: str, p: float) -> Column:
        low, high, part = F.col(f"_low_{n}"), F.col(f"_high_{n}"), place(p) - F.floor(place(p))
        return F.when(low == high, low.cast("double")).otherwise((1 - part) * low + part * high).alias(n)

    return picked.select(*keys, *sums, *[between(n, p) for n, p in levels.items()])


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of two reduced tables; NULL keys are equal."""
    return _same(left, right, keys, "left")


def latency_percentiles(traces: DataFrame, exact: bool = True) -> DataFrame:
    """p50, p95 and p99 per phase and model; exact=False keeps a sketch of fixed size."""
    levels = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    keys = ["phase", "model"]
    if exact:
        found = percentiles(traces, keys, "latency_cents", levels, {"_calls": F.lit(1)})
    else:
        found = traces.groupBy(*keys).agg(*[F.percentile_approx("latency_cents", p).alias(n) for n, p in levels.items()])
    return found.select(*keys, *[F.round(n, 2).cast("decimal(18,2)").alias(n) for n in levels])


def error_rate(traces: DataFrame) -> DataFrame:
    out = traces.groupBy("phase").agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("errors"))
    return out.withColumn("rate", ratio(F.col("errors"), F.col("calls")))


def daily_volume(traces: DataFrame) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    return traces.groupBy(day, "model", "phase").agg(
        F.count("*").alias("calls"), ratio(F.sum("latency_cents"), F.count("*") * 100).alias("avg_latency")
    )


def daily_metrics(traces: DataFrame) -> DataFrame:
    """(day, metric, value): uptime and error rate in percent, p95 latency."""
    dated = traces.select(F.date_format("ts", "yyyy-MM-dd").alias("day"), "ok", "latency_cents")
    sums = {"_calls": F.lit(1), "_ok": F.when(F.col("ok"), 1).otherwise(0), "_failed": F.when(~F.col("ok"), 1).otherwise(0)}
    wide = percentiles(dated, ["day"], "latency_cents", {"_p": 0.95}, sums)
    wide = wide.withColumns({"uptime": F.col("_ok") * 100.0 / F.col("_calls"), "error_rate": F.col("_failed") * 100.0 / F.col("_calls")})
    wide = wide.withColumn("latency_p95", F.col("_p") / 100)
    return wide.unpivot("day", ["uptime", "latency_p95", "error_rate"], "metric", "value")


def threshold_status(metrics: DataFrame, thresholds: dict = THRESHOLDS) -> DataFrame:
    """Add status OK, WARN or ALERT by the metric's target and alert level.

    Thresholds are a few constants, so they become one expression and not a join.
    """
    status = F.lit(None).cast("string")
    for name, (target, alert, higher) in thresholds.items():
        value = F.col("value")
        bad, good = (value < alert, value > target) if higher else (value > alert, value < target)
        level = F.when(bad, "ALERT").when(good, "OK").otherwise("WARN")
        status = F.when(F.col("metric") == name, level).otherwise(status)
    return metrics.withColumn("status", status)


def hypothesis_verdict(traces: DataFrame, split_at: str) -> DataFrame:
    """Per phase, the drop of the average latency after a moment, and the verdict on it."""
    later = F.col("ts") >= F.lit(split_at).cast("timestamp")
    sums = traces.groupBy("phase").agg(
        F.sum(F.when(~later, F.col("latency_cents"))).alias("b"),
        F.count_if(~later).alias("nb"),
        F.sum(F.when(later, F.col("latency_cents"))).alias("a"),
        F.count_if(later).alias("na"),
    )
    before, after = F.col("b").cast("double") / F.col("nb"), F.col("a").cast("double") / F.col("na")
    drop = F.round((before - after) / before, 4).cast("decimal(18,4)")
    verdict = F.when(F.col("drop") >= CONFIRMED_DROP, "confirmed").when(F.col("drop") < REFUTED_DROP, "refuted").otherwise("partial")
    return sums.where("nb > 0 AND na > 0").select("phase", drop.alias("drop")).withColumn("verdict", verdict)


def baseline_trigger(traces: DataFrame, split_at: str, factor: float = 2.0, min_success: float = 0.60) -> DataFrame:
    """Per phase and model: is p95 above `factor` times its baseline, or success too low?"""
    later = F.col("ts") >= F.lit(split_at).cast("timestamp")
    keys = ["phase", "model"]
    sums = {"_calls": F.lit(1), "_ok": F.when(F.col("ok"), 1).otherwise(0)}
    halves = percentiles(traces.withColumn("_later", later), [*keys, "_later"], "latency_cents", {"_p": 0.95}, sums)

    def side(name: str, which: Column) -> Column:
        return F.max(F.when(which, F.col(name)))

    out = halves.groupBy(*keys).agg(
        side("_p", ~F.col("_later")).alias("_before"), side("_p", F.col("_later")).alias("_after"),
        ratio(F.coalesce(side("_ok", F.col("_later")), F.lit(0)), F.coalesce(side("_calls", F.col("_later")), F.lit(0))).alias("success"),
    )
    return out.select(
        "phase",
        "model",
        "success",
        F.coalesce(F.col("_after") > F.col("_before") * factor, F.lit(False)).alias("slow"),
        (F.col("success") < min_success).alias("failing"),
    )


def ice_score(opportunities: DataFrame) -> DataFrame:
    """Add score and rank. opportunities: id, kind, impact, confidence, ease."""
    impact = F.when(F.col("kind") == "blocking_debt", F.greatest("impact", F.lit(BLOCKING_IMPACT).cast("bigint"))).otherwise(F.col("impact"))
    score = (
        F.when(F.col("kind") == "critical_bug", ICE_CRITICAL)
        .when(F.col("kind") == "security", ICE_SECURITY)
        .otherwise(impact * F.col("confidence") * F.col("ease"))
        .cast("bigint")
    )
    scored = opportunities.withColumn("score", score).withColumn("_down", -score)
    return numbered(scored, ["_down", "id"], name="rank").drop("_down")


def route_opportunity(opportunities: DataFrame, group: str) -> DataFrame:
    """Add next: a critical bug sends its whole group to the spec phase at once."""
    critical = opportunities.where("kind = 'critical_bug'").select(group, F.lit(True).alias("_critical")).distinct()
    target = (
        F.when(F.col("_critical"), "spec")
        .when(F.col("kind").isin("critical_bug", "bug"), "spec")
        .otherwise("discovery")
    )
    return salted_join(opportunities, critical, [group], "left").withColumn("next", target).drop("_critical")


def recurring_errors(errors: DataFrame, last: int = 50) -> DataFrame:
    """The last errors counted by type."""
    recent = errors.orderBy(F.desc("ts"), F.desc("event_id")).limit(last)
    return recent.groupBy("type").agg(F.count("*").alias("errors")).withColumn("recurring", F.col("errors") > 1)


def quality_score(scores: DataFrame, by: str) -> DataFrame:
    """Average manual score against its target. scores: by, score."""
    out = scores.groupBy(by).agg(F.count("*").alias("rated"), F.sum("score").alias("_sum"))
    return out.withColumn("average", ratio(F.col("_sum"), F.col("rated"))).withColumn("on_target", F.col("average") > QUALITY_TARGET).drop("_sum")


def slow_phases(traces: DataFrame, n: int = 3) -> DataFrame:
    out = traces.groupBy("phase").agg(ratio(F.sum("latency_cents"), F.count("*") * 100).alias("avg_latency"))
    return out.orderBy(F.desc("avg_latency"), "phase").limit(n)


def percent_change(traces: DataFrame) -> DataFrame:
    """Calls per phase and day, and the change from the day before."""
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    daily = traces.groupBy("phase", day).agg(F.count("*").alias("calls"))
    before = F.lag("calls").over(Window.partitionBy("phase").orderBy("day"))
    change = F.round((F.col("calls") - F.col("_before")) * 100.0 / F.col("_before"), 2).cast("decimal(18,2)")
    return daily.withColumn("_before", before).where("_before IS NOT NULL").select("phase", "day", "calls", change.alias("change_pct"))


def green_streak(days: DataFrame, days_needed: int = GREEN_DAYS) -> DataFrame:
    """Runs of consecutive green days that are long enough. days: day DATE, green (one row a day)."""
    green = days.where("green").select("day", F.row_number().over(Window.orderBy("day")).alias("_n"))
    runs = green.groupBy(F.expr("date_sub(day, _n)").alias("_island")).agg(
        F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.count("*").alias("days")
    )
    return runs.where(F.col("days") >= days_needed).drop("_island")


def stable_cycles(rates: DataFrame, by: str, order: str) -> DataFrame:
    """Add stable: the success rate of this and the two cycles before it is above 85 %."""
    last = Window.partitionBy(by).orderBy(order).rowsBetween(1 - STABLE_CYCLES, 0)
    stable = (F.count("*").over(last) == STABLE_CYCLES) & (F.min("rate").over(last) > STABLE_RATE)
    return rates.withColumn("stable", stable)


def cost_per_feature(traces: DataFrame, price_cents: dict[int, int]) -> DataFrame:
    """Calls and cost by phase and route, with a total per phase and over all.

    price_cents: paid models only; a local model costs nothing.
    """
    price = F.lit(0)
    for model, amount in price_cents.items():
        price = F.when(F.col("model") == model, amount).otherwise(price)
    route = F.when(F.col("model").isin(*price_cents), "paid").otherwise("local")
    priced = traces.select("phase", route.alias("route"), price.cast("bigint").alias("_cents"))
    return priced.rollup("phase", "route").agg(
        F.count("*").alias("calls"), as_money(F.sum("_cents")).alias("cost"), F.grouping_id().alias("_level")
    ).select(
        F.when(F.col("_level") >= 2, "TOTAL").otherwise(F.col("phase")).alias("phase"),
        F.when(F.col("_level") >= 1, "TOTAL").otherwise(F.col("route")).alias("route"),
        "calls",
        "cost",
    )
