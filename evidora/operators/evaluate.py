"""Evaluation of runs against relevance judgements, and of answers against rules.

A run ranks documents or blocks; truth is per document, so a run counts by the best rank of any target. Tiers are
reported one by one and never merged into a total."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.text import tokens


def passages(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, doc_id: documents that hold a query's text verbatim.

    A document that holds a passage has its longest inner token, so candidates come from an
    equi-join on that token before texts are compared; passages of under three tokens are compared with all."""
    toks = tokens(F.col("text"))
    inner = F.slice(toks, F.lit(2), F.greatest(F.size(toks) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda x: F.struct(F.length(x).alias("n"), x.alias("t"))))["t"]
    q = queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("passage"), longest.alias("key"))
    d = docs.select("doc_id", "text")
    met = d.select("doc_id", F.explode(F.array_distinct(toks)).alias("key")).join(q.where("key is not null").select("query_id", "key"), "key").select("query_id", "doc_id")
    found = met.join(q.select("query_id", "passage"), "query_id").join(d, "doc_id").where(F.contains("text", "passage")).select("query_id", "doc_id")
    short = q.where("key is null")
    return found.unionByName(d.join(short, F.contains("text", "passage")).select("query_id", "doc_id"))


def best_ranks(queries: DataFrame, qrels: DataFrame, run: DataFrame) -> DataFrame:
    """query_id, tier, n_targets, best: the best rank of any target (null: none was found). Tiers are synthetic: item_id % 3."""
    hits = qrels.join(run.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"], "left")
    best = hits.groupBy("query_id").agg(F.count("*").alias("n_targets"), F.min("rank").alias("best"))
    out = queries.select(F.col("item_id").alias("query_id"), F.concat(F.lit("T"), (F.col("item_id") % 3 + 1).cast("string")).alias("tier")).join(best, "query_id", "left")
    return out.withColumn("n_targets", F.coalesce("n_targets", F.lit(0).cast("long")))


def recall(best: DataFrame, at: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """Per tier, the share of judged queries with a target in the first k."""
    judged = best.where("n_targets > 0")
    return judged.groupBy("tier").agg(F.count("*").alias("n"), *[F.round(F.avg((F.coalesce("best", F.lit(2**31)) <= k).cast("double")), 6).alias(f"r{k}") for k in at])


def mrr(best: DataFrame) -> DataFrame:
    return best.where("n_targets > 0").groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg(F.coalesce(1.0 / F.col("best"), F.lit(0.0))), 6).alias("mrr"))


def by_tier(best: DataFrame) -> DataFrame:
    """Everything by tier; queries without a target are counted on their own, not dropped in silence."""
    some = F.col("n_targets") > 0
    hit = (F.coalesce("best", F.lit(2**31)) <= 10).cast("double")
    return best.groupBy("tier").agg(F.count("*").alias("n_queries"), F.count(F.when(~some, 1)).alias("n_without_target"), F.round(F.avg(F.when(some, hit)), 6).alias("r10"), F.round(F.avg(F.when(some, F.coalesce(1.0 / F.col("best"), F.lit(0.0)))), 6).alias("mrr"))


def rank_bin(rank: Column) -> Column:
    return F.when(rank.isNull(), "missed").when(rank <= 1, "1").when(rank <= 5, "2-5").when(rank <= 10, "6-10").when(rank <= 20, "11-20").otherwise("over 20")


def rank_histogram(best: DataFrame) -> DataFrame:
    return best.where("n_targets > 0").groupBy("tier", rank_bin(F.col("best")).alias("bin")).agg(F.count("*").alias("n"))


def compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per query the best ranks of two arms side by side, and whether they agree (nulls equal)."""
    left, right = a.select("query_id", F.col("best").alias("best_a")), b.select("query_id", F.col("best").alias("best_b"))
    return left.join(right, "query_id", "fullouter").select("query_id", "best_a", "best_b", F.col("best_a").eqNullSafe(F.col("best_b")).alias("same"))


def regression(now: DataFrame, frozen: DataFrame) -> DataFrame:
    """Rows that only one of two runs has; empty if they are equal bit for bit."""
    columns = ["query_id", "doc_id", "rank", "score"]
    new, lost = now.select(*columns).exceptAll(frozen.select(*columns)), frozen.select(*columns).exceptAll(now.select(*columns))
    return new.withColumn("side", F.lit("new")).unionByName(lost.withColumn("side", F.lit("lost")))


def dropouts(old: DataFrame, new: DataFrame, k: int = 10) -> DataFrame:
    both = old.select("query_id", F.col("best").alias("old")).join(new.select("query_id", F.col("best").alias("new")), "query_id")
    return both.where(F.col("old") <= k).agg(F.count("*").alias("n_in"), F.count(F.when(F.col("new").isNull() | (F.col("new") > k), 1)).alias("n_dropped"))


def rouge1(pairs: DataFrame) -> DataFrame:
    """query_id, precision, recall, f1 of the token multisets of (query_id, answer, reference)."""
    def counts(column: str) -> DataFrame:
        return pairs.select("query_id", F.explode(tokens(F.col(column))).alias("t")).groupBy("query_id", "t").agg(F.count("*").alias(column))

    both = counts("answer").join(counts("reference"), ["query_id", "t"], "fullouter").groupBy("query_id").agg(F.sum(F.least(F.coalesce("answer", F.lit(0)), F.coalesce("reference", F.lit(0)))).alias("o"), F.sum("answer").alias("a"), F.sum("reference").alias("r"))
    p, r = F.col("o") / F.col("a"), F.col("o") / F.col("r")
    f1 = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
    return both.select("query_id", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"))


def rouge_l(pairs: DataFrame) -> DataFrame:
    """query_id, f1 of the longest common subsequence: a quadratic recurrence, so an Arrow function."""
    @F.pandas_udf("double")
    def lcs(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y) -> float:
            if len(x) == 0 or len(y) == 0:
                return 0.0
            names = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
            x, y = np.array([names[t] for t in x]), np.array([names[t] for t in y])
            row = np.zeros(len(y) + 1, int)
            for t in x:
                row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(y == t, row[:-1] + 1, 0)))
            n = row[-1]
            return 0.0 if not n else 2 * n / (len(x) + len(y))

        return pd.Series([one(x, y) for x, y in zip(a, b)])

    return pairs.select("query_id", F.round(lcs(tokens(F.col("answer")), tokens(F.col("reference"))), 6).alias("f1"))


def best_run(runs: DataFrame) -> DataFrame:
    """Per suite the run that stays: one with live items beats one without however many passed, then more passes, then the later."""
    key = F.struct((F.col("n_live") > 0).alias("live"), "n_pass", "run_id")
    return runs.groupBy("suite").agg(F.max(key).alias("k")).select("suite", F.col("k.run_id").alias("run_id"), F.col("k.live").alias("live"), F.col("k.n_pass").alias("n_pass"))


def report_diff(old: DataFrame, new: DataFrame, ignore: str = "^generated at") -> DataFrame:
    """Lines that only one of two reports (line) has, time lines aside."""
    a, b = old.where(~F.col("line").rlike(ignore)).select("line"), new.where(~F.col("line").rlike(ignore)).select("line")
    return a.exceptAll(b).withColumn("side", F.lit("old")).unionByName(b.exceptAll(a).withColumn("side", F.lit("new")))
