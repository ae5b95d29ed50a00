"""Values beyond what the check data holds."""

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from commercelake.functions.money import percent_of
from commercelake.operators import kpi, sales, texts


def test_negative_amounts_round_half_even(spark):
    df = spark.createDataFrame([(-155,), (155,), (-145,), (145,), (0,)], "c bigint")
    assert [r[0] for r in df.select(percent_of(F.col("c"), 10)).collect()] == [-16, 16, -14, 14, 0]


def test_counts_of_ten_digits(spark):
    found = texts.parse_test_log(spark.createDataFrame([("1234567890 passed",)], "log string")).first().asDict()
    assert 1234567890 in found.values()


def test_large_ids_keep_the_order_of_scores(spark):
    rows = [(10**15, "bug", 10, 10, 9), (1, "bug", 10, 10, 6)]
    found = kpi.ice_score(spark.createDataFrame(rows, "id bigint, kind string, impact bigint, confidence bigint, ease bigint"))
    assert {r["id"]: r["rank"] for r in found.collect()} == {10**15: 1, 1: 2}


def test_campaigns_end(spark):
    campaigns = spark.createDataFrame(
        [(1, date(2024, 1, 1), 8, date(2024, 2, 1)), (1, date(2024, 6, 1), 7, None)], "seller_id bigint, starts_on date, rate_pct int, ends_on date"
    )
    days = [date(2024, 1, 31), date(2024, 2, 1), date(2024, 7, 1), date(2101, 5, 1)]
    rows = spark.createDataFrame([(1, d) for d in days], "seller_id bigint, sold_on date")
    found = {r["sold_on"]: r["rate_pct"] for r in sales.with_rate_in_force(rows, campaigns).collect()}
    assert [found[d] for d in days] == [8, 10, 7, 7]


def test_rates_in_force_against_a_loop(spark):
    rng = random.Random(4)
    day = date(2020, 1, 1).toordinal()
    campaigns = {(s, date.fromordinal(day + rng.randrange(2000))): (rng.randrange(20), rng.choice([None, rng.randrange(1, 900)])) for s in range(4) for _ in range(6)}
    campaigns = [(s, d, pct, d + timedelta(n) if n else None) for (s, d), (pct, n) in campaigns.items()]
    sold = [(s, date.fromordinal(day - 200 + rng.randrange(4000))) for s in range(5) for _ in range(200)]
    table = spark.createDataFrame(campaigns, "seller_id bigint, starts_on date, rate_pct int, ends_on date")
    found = sales.with_rate_in_force(spark.createDataFrame(sold, "seller_id bigint, sold_on date"), table).collect()

    def rate(seller, on):
        begun = max([c for c in campaigns if c[0] == seller and c[1] <= on], key=lambda c: c[1], default=None)
        return begun[2] if begun and (begun[3] is None or on < begun[3]) else 10

    assert sorted((r["seller_id"], r["sold_on"], r["rate_pct"]) for r in found) == sorted((s, d, rate(s, d)) for s, d in sold)


def test_percentiles_of_a_hot_day_are_cut_into_ranges(spark):
    """All values of the day differ; NULL values and a NULL day are there too."""
    rng = random.Random(9)
    data = [("hot", v) for v in rng.sample(range(10**9), 4000)] + [("b", v % 7) for v in range(40)] + [(None, 3), (None, 4), ("none", None), ("hot", None)]
    df = spark.createDataFrame(data, "day string, v bigint").repartition(3)
    sizes = kpi.values_by_range(df, ["day"], "v").groupBy("day", "_range").count()
    assert sizes.agg(F.max("count")).first()[0] < 1500
    levels = {"p50": 0.5, "p95": 0.95}
    found = {r["day"]: tuple(r)[1:] for r in kpi.percentiles(df, ["day"], "v", levels).collect()}
    kept = {r["day"]: tuple(r)[1:] for r in kpi.percentiles(df, ["day"], "v", levels, {"rows": F.lit(1)}).collect()}
    assert kept["none"] == (1, None, None) and set(kept) == set(found) | {"none"}
    for day in ("hot", "b", None):
        values = [v for d, v in data if d == day and v is not None]
        assert found[day] == pytest.approx([float(np.percentile(values, 100 * p)) for p in levels.values()], rel=1e-12)
        assert kept[day] == (sum(d == day for d, _ in data), *found[day])
