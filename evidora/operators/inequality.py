"""Inequality joins and as-of joins without a hot task: range buckets, slices, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.operators.links import cut


def _named(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it one that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = "_" + n
        out.append(n)
    return out


def band(left: DataFrame, right: DataFrame, at: Column, on: Column, low: float, high: float, salts: int = 1) -> DataFrame:
    """All pairs with left.at + low <= right.on <= left.at + high, exactly: an equi-join on buckets as wide as the band, into one or two of which each left row overflows, then
    the bounds. at, on: numbers of the left and the right. salts: a bucket's right rows are dealt to so many parts, each of which gets the bucket's left rows.

    Columns of both sides are returned; names must differ. Null, NaN and infinite numbers join nothing. A row meets the rows of its band's buckets only, so the join makes
    at most about twice the pairs that it returns, however far the numbers reach."""
    if high < low:
        raise ValueError("the band is empty")
    width = float(high - low) or 1.0
    left = left.select("*", at.cast("double").alias("_at"))
    right = right.select("*", on.cast("double").alias("_on"))
    far = float(2**62) * width
    fine = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c)) < far)  # noqa: E731  false for NaN, which is larger
    bucket = lambda c: F.floor(c / width).cast("long")
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in right.columns]), F.lit(salts))
    r = right.where(fine("_on")).select("*", bucket(F.col("_on")).alias("_bucket"), salt.alias("_salt"))
    each = left.where(fine("_at")).select("*", F.explode(F.sequence(bucket(F.col("_at") + low), bucket(F.col("_at") + high))).alias("_bucket"))
    each = each.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    met = each.join(r, ["_bucket", "_salt"])
    return met.where((F.col("_on") >= F.col("_at") + low) & (F.col("_on") <= F.col("_at") + high)).drop("_bucket", "_salt", "_at", "_on")


def _sliced(rows: DataFrame, order: list[Column], pid: str) -> DataFrame:
    """rows range-partitioned by order and written down, with their slice (pid): the slices follow each other in that order. A key with many rows is many slices."""
    return cut(rows.repartitionByRange(*order).withColumn(pid, F.spark_partition_id()), "sliced")


def counted_above(left: DataFrame, right: DataFrame, at: str, on: str, name: str = "n_above") -> DataFrame:
    """left with the number of right rows of which `on` is larger than its `at`: the inequality join, counted without being made.

    Both sides are sorted into slices together; a slice counts within itself, and what lies in earlier slices is a sum over slices, of which there are as many as
    partitions. Null values on the left have null counts; on the right they count nowhere."""
    side, value, pid, n, before, within = _named(left, "_side", "_value", "_pid", "_n", "_before", "_within")
    lefts = left.select("*", F.lit(1).alias(side), F.col(at).cast("double").alias(value))
    rights = right.where(F.col(on).isNotNull()).select(F.lit(0).alias(side), F.col(on).cast("double").alias(value))
    tie = F.xxhash64(*[F.col(c) for c in left.columns])  # equal values may be several slices
    ranged = _sliced(lefts.unionByName(rights, allowMissingColumns=True), [F.col(value), F.col(side), tie], pid)
    per = ranged.groupBy(pid).agg(F.count(F.when(F.col(side) == 0, 1)).alias(n))  # a row for each partition
    starts = per.select(pid, F.coalesce(F.sum(n).over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before)).crossJoin(per.agg(F.sum(n).alias(n)))
    upto = F.sum(1 - F.col(side)).over(Window.partitionBy(pid).orderBy(value, side))
    out = ranged.withColumn(within, upto).where(F.col(side) == 1).join(F.broadcast(starts), pid)
    return out.select(*left.columns, F.when(F.col(at).isNotNull(), F.col(n) - F.col(before) - F.col(within)).cast("long").alias(name))


def asof(left: DataFrame, right: DataFrame, by: str, at: str, value: str) -> DataFrame:
    """left (by, at, ...) with the last value of right (by, at, value) at or before its time, as relational.asof, for keys that may hold any share of the rows.

    Both sides are range-sorted by key and time into slices, so a hot key is many slices. Within a slice the last value is a window; what a slice takes over from
    earlier ones of its key is the last of their last values. Only a key that goes on past a slice's end needs that: at most one for each partition. Rows without a key or a
    time get null; right rows without key, time or value are none. Of right rows at one time the largest value counts."""
    side, v, pid, carry, place = _named(left, "_side", "_v", "_pid", "_carry", "_place")
    kind = right.schema[value].dataType
    lefts = left.select("*", F.lit(1).alias(side), F.lit(None).cast(kind).alias(v))
    rights = right.where(F.col(by).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).select(by, at, F.lit(0).alias(side), F.col(value).alias(v))
    tie = F.xxhash64(*[F.col(c) for c in left.columns])
    ranged = _sliced(lefts.unionByName(rights, allowMissingColumns=True), [F.col(by), F.col(at), F.col(side), F.col(v), tie], pid)
    last = F.max_by(v, F.struct(at, v)).alias(v)
    ends = ranged.where((F.col(side) == 0)).groupBy(by, pid).agg(last)
    spans = ranged.where(F.col(by).isNotNull()).groupBy(by).agg(F.min(pid).alias("_low"), F.max(pid).alias("_high")).where("_low < _high")
    each = spans.select(by, F.explode(F.sequence("_low", "_high")).alias(pid)).join(ends, [by, pid], "left")
    earlier = Window.partitionBy(by).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(by, pid, F.last(v, ignorenulls=True).over(earlier).alias(carry)).where(F.col(carry).isNotNull())
    within = F.last(v, ignorenulls=True).over(Window.partitionBy(pid, by).orderBy(at, side, F.col(v).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    out = ranged.withColumn(place, within).where(F.col(side) == 1).join(F.broadcast(carried), [by, pid], "left")  # fewer rows than partitions, twice
    known = F.col(by).isNotNull() & F.col(at).isNotNull()
    return out.select(*left.columns, F.when(known, F.coalesce(place, carry)).alias(value))
