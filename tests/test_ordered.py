"""Running totals, numbering and salted joins under hot keys and ties."""

import random

import pytest
from pyspark.sql import functions as F

from commercelake.operators.ordered import dense_rank_by, numbered, running, with_range
from commercelake.operators.skew import salted_join


def rows(seed, n, keys, times):
    rng = random.Random(seed)
    hot = keys[0]
    return [(hot if rng.random() < 0.4 else rng.choice(keys), rng.choice(times), i, rng.randint(-50, 50)) for i in range(n)]


def expected(data):
    out, state = {}, {}
    for k, at, i, v in sorted(data, key=lambda r: (r[1], r[2])):
        total, count, peak = state.get(k, (0, 0, None))
        state[k] = (total + v, count + 1, v if peak is None else max(peak, v))
        out[i] = state[k]
    return out


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
@pytest.mark.parametrize("times", [list(range(1000)), [5], [1, 1, 1, 2, 9], [3] * 20 + list(range(30))])
def test_running_matches_a_plain_loop(spark, ranges, times):
    data = rows(ranges, 600, ["a", "b", "c"], times)
    df = spark.createDataFrame(data, "k string, at bigint, id bigint, v bigint").repartition(5)
    out = running(
        df, ["k"], ["at", "id"], {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "m": ("max", F.col("v"))}, ranges
    )
    assert {r["id"]: (r["s"], r["n"], r["m"]) for r in out.collect()} == expected(data)


@pytest.mark.parametrize("parts", [1, 2, 4, 4096])
def test_only_large_keys_are_cut(spark, parts):
    data = rows(parts, 600, ["a", "b", None], list(range(1000)))
    df = spark.createDataFrame(data, "k string, at bigint, id bigint, v bigint").repartition(5)
    out = running(df, ["k"], ["at", "id"], {"s": ("sum", F.col("v")), "n": ("count", F.lit(1)), "m": ("max", F.col("v"))}, parts=parts)
    assert {r["id"]: (r["s"], r["n"], r["m"]) for r in out.collect()} == expected(data)


def test_running_keeps_null_keys_and_skips_null_values(spark):
    data = [(None, 1, 1, None), (None, 2, 2, 4), (None, 3, 3, None), ("x", 1, 4, 7)]
    df = spark.createDataFrame(data, "k string, at bigint, id bigint, v bigint")
    out = running(df, ["k"], ["at", "id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, 3)
    assert {r["id"]: (r["s"], r["m"]) for r in out.collect()} == {1: (None, None), 2: (4, 4), 3: (4, 4), 4: (7, 7)}


def test_one_tied_value_is_still_cut(spark):
    df = spark.range(2000).select(F.lit(7).cast("bigint").alias("at"), F.col("id"))
    cut = with_range(df, ["at", "id"], 20, "r")
    sizes = [r["count"] for r in cut.groupBy("r").count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 400
    bounds = cut.groupBy("r").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("r").collect()
    assert all(x["b"] < y["a"] for x, y in zip(bounds, bounds[1:]))


def test_numbered_is_dense_over_all_rows(spark):
    df = spark.range(500).select((F.col("id") * 37 % 500).alias("id"))
    out = numbered(df, ["id"], ranges=9).collect()
    assert sorted((r["id"], r["position"]) for r in out) == [(i, i + 1) for i in range(500)]


def test_dense_rank(spark):
    df = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", 1)], "k string, n bigint")
    assert {r["k"]: r["rank"] for r in dense_rank_by(df, "n").collect()} == {"b": 1, "a": 2, "c": 2, "d": 3}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("parts", [1, 5, 4096])
def test_salted_join_equals_join(spark, how, parts):
    large = spark.range(300).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 11)).alias("k"), "id").repartition(6)
    small = spark.createDataFrame([(0, "z"), (4, "f"), (99, "n")], "k int, name string")
    got = sorted(map(tuple, salted_join(large, small, ["k"], how, parts).collect()), key=str)
    want = sorted(map(tuple, large.join(small, "k", how).collect()), key=str)
    assert got == want


def test_text_and_several_order_columns(spark):
    data = [(f"n{i % 7}", f"f{i * 37 % 400:03d}", i) for i in range(400)]
    df = spark.createDataFrame(data, "a string, b string, v int").repartition(4)
    out = numbered(df, ["a", "b"], ranges=8).collect()
    assert [r["v"] for r in sorted(out, key=lambda r: r["position"])] == [v for _, _, v in sorted(data)]
    assert running(df.limit(0), [], ["a"], {"n": ("count", F.lit(1))}).collect() == []


def test_building_runs_no_job(spark):
    spark.sparkContext.setJobGroup("build", "build")
    df = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    running(df, ["k"], ["id"], {"s": ("sum", F.col("id"))})
    numbered(df, ["id"])
    salted_join(df, df.groupBy("k").count(), ["k"])
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("build")
