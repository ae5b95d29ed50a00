"""Roll-ups over logs of many runs: readiness, health, criteria, timings, retries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commercelake.operators.checkout import eligible

MIN_CARRIERS = 2
MAX_RETRIES = 3


def _all_of(kind: str) -> Column:
    """AND of a kind's flags; a kind without any flag is not fulfilled."""
    return F.coalesce(F.bool_and(F.when(F.col("kind") == kind, F.coalesce("flag", F.lit(False)))), F.lit(False))


def _eligible_count(kind: str) -> Column:
    return F.count_if((F.col("kind") == kind) & eligible(F.col("enabled"), F.col("healthy")))


def readiness(status: DataFrame, by: list[str]) -> DataFrame:
    """Per environment: all flags set, a gateway, two carriers and a notifier usable.

    status: kind (environment, security, finance, gateway, carrier, notifier), flag, enabled, healthy.
    """
    return status.groupBy(*by).agg(
        (_all_of("environment") & _all_of("security") & _all_of("finance")).alias("_flags"),
        (_eligible_count("gateway") >= 1).alias("payments"),
        (_eligible_count("carrier") >= MIN_CARRIERS).alias("carriers"),
        (_eligible_count("notifier") >= 1).alias("notifications"),
    ).withColumn("ready", F.expr("_flags AND payments AND carriers AND notifications")).drop("_flags")


def smoke_checks(status: DataFrame, by: list[str]) -> DataFrame:
    """Per run a map of check to outcome, and whether all of them hold."""
    checks = {"persistence": F.lit(True), "payments": F.col("payments"), "carriers": F.col("carriers"),
              "notifications": F.col("notifications"), "launch": F.col("ready")}
    table = F.map_from_arrays(F.array(*map(F.lit, checks)), F.array(*checks.values()))
    out = readiness(status, by).withColumn("checks", table)
    return out.select(*by, "checks", F.forall(F.map_values("checks"), lambda ok: ok).alias("passed"))


def integration_status(changes: DataFrame) -> DataFrame:
    """Current settings per provider from a change log; a field a change leaves out (NULL)
    keeps its last value. Aggregates only, so a provider with many changes is no problem."""
    at = F.struct("at", "event_id")

    def latest(field: str, default: Column) -> Column:
        known = F.col(field).isNotNull()
        return F.coalesce(F.max_by(F.when(known, F.col(field)), F.when(known, at)), default).alias(field)

    return changes.groupBy("provider").agg(
        latest("enabled", F.lit(False)), latest("healthy", F.lit(False)), latest("mode", F.lit("sandbox"))
    )


def health_rollup(checks: DataFrame, by: list[str]) -> DataFrame:
    """Mandatory failures, optional skips and overall status."""
    bad = F.col("status") == "FAIL"
    return checks.groupBy(*by).agg(
        F.count_if(bad & F.col("mandatory")).alias("failures"), F.count_if(bad & ~F.col("mandatory")).alias("skipped")
    ).withColumn("overall", F.when(F.col("failures") > 0, "failed").otherwise("passed"))


def scorecard(runs: DataFrame, run: str, criteria: dict[str, Column]) -> DataFrame:
    """Per run and criterion PASS or FAIL, with the run's 'x/y criteria passed'."""
    met = F.array(*[F.struct(F.lit(label).alias("label"), F.coalesce(ok, F.lit(False)).alias("ok")) for label, ok in criteria.items()])
    passed = F.size(F.filter("_met", lambda c: c["ok"]))
    score = F.concat(passed.cast("string"), F.lit("/"), F.size("_met").cast("string"), F.lit(" criteria passed"))
    return (
        runs.select(run, met.alias("_met"))
        .select(run, score.alias("score"), F.inline("_met"))
        .select(run, "label", F.when(F.col("ok"), "PASS").otherwise("FAIL").alias("result"), "score")
    )


def stage_timings(events: DataFrame, run: str, stage: str) -> DataFrame:
    """Seconds per stage (last event less first), their total and its whole minutes."""
    seconds = (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("seconds")
    per_stage = events.groupBy(run, stage).agg(seconds)
    total = F.sum("seconds").over(Window.partitionBy(run))
    return per_stage.withColumn("total_seconds", total).withColumn(
        "total_minutes", F.call_function("div", F.col("total_seconds"), F.lit(60))
    )


def retry_summary(attempts: DataFrame, run: str) -> DataFrame:
    """Per run: attempts made (at most three), fixes applied between them, exhausted or not.

    Only a run's first three attempts count; they are picked per task before the shuffle.
    """
    order = Window.partitionBy(run).orderBy("ts", "event_id")
    first = attempts.select(run, "ok", F.row_number().over(order).alias("n")).where(F.col("n") <= MAX_RETRIES)
    per_run = first.groupBy(run).agg(F.min(F.when(F.col("ok"), F.col("n"))).alias("_won"), F.max("n").alias("_made"))
    won, made = F.col("_won"), F.col("_made")
    exhausted = won.isNull() & (made >= MAX_RETRIES)
    return per_run.select(
        run,
        F.coalesce(won, made).cast("bigint").alias("attempts"),
        F.when(won.isNotNull(), won - 1).when(exhausted, made - 1).otherwise(made).cast("bigint").alias("fixes"),
        exhausted.alias("exhausted"),
    )


def artifact_sizes(files: DataFrame, run: str, text: str) -> DataFrame:
    """Files, lines and characters per run."""
    lines = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit(""))) + 1
    return files.groupBy(run).agg(
        F.count("*").alias("files"), F.sum(lines).alias("lines"), F.sum(F.length(text)).alias("chars")
    )
