"""Query registry shared by the entry point, the tests and the bench."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from commercelake.plans.views import with_views
from commercelake.sources.entities import Entities

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(key: str, sql: str | None = None):
    """Register build(entities) under key, with SQL that must return the same rows."""

    def register(build: Callable[[Entities], DataFrame]):
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")

        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return build(Entities(spark, folder))

        QUERIES[key] = run
        if sql is not None:
            ORACLES[key] = with_views(sql)
        return build

    return register
