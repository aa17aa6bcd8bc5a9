"""Analytics of calls, caches, copies and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rates(calls: DataFrame, failed: Column, refused: Column, by: str) -> DataFrame:
    """Per group: calls, share that succeeded, share of the successful ones that refused, mean of a seventh of the latency."""
    ok = F.coalesce(~failed, F.lit(False))
    return calls.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(ok.cast("int")), 6).alias("success_rate"), F.round(F.avg(F.when(ok, F.coalesce(refused, F.lit(False)).cast("int"))), 6).alias("refusal_rate"), F.round(F.avg(F.col("value") / 7), 6).alias("mean"))


def latencies(calls: DataFrame, exact: bool = False) -> DataFrame:
    """p50 and p95 of each type: a sketch of bounded size, or exact percentiles, which hold a type's distinct values in one task."""
    p = (lambda q: F.percentile("value", F.lit(q))) if exact else (lambda q: F.percentile_approx("value", q, 10000))
    return calls.groupBy("event_type").agg(p(0.5).alias("p50"), p(0.95).alias("p95"))


def error_families(errors: DataFrame, families: DataFrame) -> DataFrame:
    """errors: code; families: code, family. Per family its errors and codes; codes of no family count as `unknown`."""
    out = errors.join(families, "code", "left").withColumn("family", F.coalesce("family", F.lit("unknown")))
    return out.groupBy("family").agg(F.count("*").alias("n"), F.countDistinct("code").alias("n_codes"))


def cache_hits(questions: DataFrame) -> DataFrame:
    """A question hits if one with a smaller id has the same normalised text. Firsts are aggregated, not windowed: a hot key needs no task of its own."""
    key = F.md5(F.trim(F.regexp_replace(F.lower("text"), r"\s+", " ")).cast("binary"))
    per = questions.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    out = per.agg(F.sum("n").alias("n"), F.sum(F.col("n") - 1).alias("n_hits"))
    return out.select("n", "n_hits", F.round(F.col("n_hits") / F.col("n"), 6).alias("rate"))


def sync_state(originals: DataFrame, copies: DataFrame) -> DataFrame:
    a = originals.select("doc_id", F.md5(F.col("text").cast("binary")).alias("a"))
    b = copies.select("doc_id", F.md5(F.col("text").cast("binary")).alias("b"))
    state = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "orphan").when(F.col("a") != F.col("b"), "stale").otherwise("same")
    return a.join(b, "doc_id", "fullouter").select("doc_id", state.alias("state"))


def export_lines(calls: DataFrame) -> DataFrame:
    return calls.select("event_id", F.concat_ws("|", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), "event_type", "user_id").alias("line"))


def upsert(base: DataFrame, changes: DataFrame, deletes: DataFrame, key: str) -> DataFrame:
    """A new version of a Parquet table: rows neither deleted nor changed, and the changes."""
    return base.join(deletes, key, "left_anti").join(changes.select(key), key, "left_anti").unionByName(changes)


def fresh_or_frozen(fresh: DataFrame, frozen: DataFrame) -> DataFrame:
    out = frozen.join(fresh, "doc_id", "left")
    return out.select("doc_id", F.coalesce("fresh_source", "source").alias("source"), F.col("fresh_source").isNotNull().alias("fresh"))
