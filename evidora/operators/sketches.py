"""Stored sketches that merge: quantiles and distinct counts by hour, added up to days and totals without the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Sizes: KLL with k = 200 errs by about 1.7 % in rank, HyperLogLog with 2**12 registers by about 1.6 % in count (standard error).
KLL_K, HLL_BITS = 200, 12


def hourly(calls: DataFrame, at: str = "ts", by: str = "event_type", value: str = "value", who: str = "user_id") -> DataFrame:
    """hour, by, n, least, most, and two sketches of bounded size: quantiles of value, distinct who. Null values and users are in no sketch. Tasks sketch before the shuffle."""
    quantiles = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(KLL_K)).alias("quantiles")
    users = F.hll_sketch_agg(F.col(who), F.lit(HLL_BITS)).alias("users")
    return calls.groupBy(F.date_trunc("hour", at).cast("timestamp_ntz").alias("hour"), F.col(by)).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), quantiles, users)


def merged(sketches: DataFrame, *by) -> DataFrame:
    """The sketches of hourly() (or of merged() itself) added up by other columns: no row is read again."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("quantiles").alias("quantiles"), F.hll_union_agg("users").alias("users"))


def read(sketches: DataFrame, *columns: str) -> DataFrame:
    """The columns, n, least, most, p50, p95, n_users of stored sketches; groups without a value have null quantiles."""
    q = lambda p: F.when(F.kll_sketch_get_n_double("quantiles") > 0, F.kll_sketch_get_quantile_double("quantiles", F.lit(p)))
    return sketches.select(*columns, "n", "least", "most", q(0.5).alias("p50"), q(0.95).alias("p95"), F.hll_sketch_estimate("users").alias("n_users"))
