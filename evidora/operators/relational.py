"""Joins that Spark has no operator of its own for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left (by, at, ...) with the last value of right (by, at, value) at or before its time.

    Union and last(ignore nulls): one shuffle by key and one sort, whatever the number of matches.
    Of right rows at one time, the largest value counts."""
    l = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})  # noqa: E741
    r = right.select(by, at, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def interval(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points within spans [start, end): an equi-join on buckets of `width` seconds, then the exact bounds. A span is
    repeated for each bucket that it touches."""
    bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (width * 1_000_000))
    p = points.withColumn("_b", bucket(at))
    s = spans.withColumn("_b", F.explode(F.sequence(bucket(start), bucket(end))))
    return p.join(s, "_b").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")
