"""Inequality and as-of joins against nested loops."""

import random

import pytest
from pyspark.sql import functions as F

from evidora.operators import inequality


@pytest.fixture
def slices(spark):
    """Small tables in as many slices as partitions."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def numbers(seed, n):
    rng = random.Random(seed)
    return [rng.choice([None, float("nan"), float("inf"), 0.0, -3.5, 7.0]) if rng.random() < 0.2 else round(rng.uniform(-50, 50), 1) for _ in range(n)]


@pytest.mark.parametrize("low, high, salts", [(-5, 5, 1), (0, 3.5, 4), (-60, -20, 2), (0, 0, 1), (2, 2, 3)])
def test_band(spark, low, high, salts):
    a, b = list(enumerate(numbers(1, 120))), list(enumerate(numbers(2, 90)))
    left, right = spark.createDataFrame(a, "i long, x double"), spark.createDataFrame(b, "j long, y double")
    out = inequality.band(left, right, F.col("x"), F.col("y"), low, high, salts)
    got = sorted((r["i"], r["j"]) for r in out.collect())
    fine = lambda v: v is not None and abs(v) < float("inf")
    assert got == sorted((i, j) for i, x in a for j, y in b if fine(x) and fine(y) and x + low <= y <= x + high)
    plan = out._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    with pytest.raises(ValueError):
        inequality.band(left, right, F.col("x"), F.col("y"), 2, 1)


def test_counted_above(spark, slices):
    rng = random.Random(3)
    a = [(i, rng.choice([None, 1.0, 2.0, 2.0, 5.5])) for i in range(200)] + [(3, 2.0)] * 5
    b = [(rng.choice([None, 1.0, 2.0, 2.0, 2.0, 9.0]),) for _ in range(300)]
    left, right = spark.createDataFrame(a, "_side long, x double"), spark.createDataFrame(b, "y double")
    got = sorted(((r["_side"], r["x"], r["n_above"]) for r in inequality.counted_above(left, right, "x", "y").collect()), key=str)
    assert got == sorted(((i, x, None if x is None else sum(y is not None and y > x for (y,) in b)) for i, x in a), key=str)
    assert {r["n_above"] for r in inequality.counted_above(left.where("x is not null"), right.limit(0), "x", "y").collect()} == {0}
    assert inequality.counted_above(left.limit(0), right, "x", "y").count() == 0


def test_asof_with_a_hot_key(spark, slices):
    """Most rows have one key; it goes through many slices, some without a right row."""
    rng = random.Random(4)
    key = lambda: rng.choice(["hot"] * 8 + ["a", "b", None])
    left = [(i, key(), rng.choice([None, *range(100)])) for i in range(400)]
    right = [(key(), rng.choice([None, *range(0, 30), *range(80, 90)]), rng.choice([None, 1.0, 2.0, 3.0])) for _ in range(150)]
    l, r = spark.createDataFrame(left, "id long, k string, t long"), spark.createDataFrame(right, "k string, t long, v double")  # noqa: E741
    out = inequality.asof(l, r, "k", "t", "v")
    got = sorted((x["id"], x["v"]) for x in out.collect())

    def last(k, t):
        found = [(u, v) for j, u, v in right if j == k and None not in (k, t, u, v) and u <= t]
        return max(found)[1] if found else None

    assert got == [(i, last(k, t)) for i, k, t in left]
    assert inequality._sliced(l, [F.col("k"), F.col("t")], "pid").where("k = 'hot'").groupBy("pid").count().count() >= 5
    assert {x["v"] for x in inequality.asof(l, r.limit(0), "k", "t", "v").collect()} == {None} and inequality.asof(l.limit(0), r, "k", "t", "v").count() == 0
