"""Reranking of pooled candidates (query_id, doc_id, ...): relevance first, recency only between equals."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.text import tokens
from evidora.operators.retrieve import inverse_frequencies, query_terms


def with_year(df: DataFrame) -> DataFrame:
    """The tables hold no publication year; this one is synthetic."""
    return df.withColumn("year", (2000 + F.col("doc_id") % 25).cast("long"))


class Reranker(Protocol):
    """Scores (question, text) pairs; a cross-encoder plugs in here."""

    def score(self, questions: list[str], texts: list[str]) -> list[float]: ...


class LengthRatio:
    """Deterministic stand-in: how near a text's length is to the question's, 0 to 1."""

    def score(self, questions: list[str], texts: list[str]) -> list[float]:
        sizes = [(len(q), len(t)) for q, t in zip(questions, texts)]
        return [min(a, b) * 10**6 // max(a, b) / 10**6 if max(a, b) else 0.0 for a, b in sizes]


def reranked(pool: DataFrame, docs: DataFrame, queries: DataFrame, reranker: Reranker) -> DataFrame:
    """The pool with rel, the reranker's score, in Arrow batches; only the texts of pooled documents go to it."""
    pairs = pool.join(docs.select("doc_id", "text"), "doc_id").join(queries.select(F.col("item_id").alias("query_id"), F.col("text").alias("question")), "query_id")

    @F.pandas_udf("double")
    def score(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(reranker.score(questions.fillna("").tolist(), texts.fillna("").tolist()), dtype="float64")

    return pairs.withColumn("rel", score("question", "text")).drop("question", "text")


def overlap(pool: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """rel: the idf-weighted share of the query's terms that the document has. The stand-in for a
    cross-encoder that needs no Python (see Reranker). Only the texts of pooled documents are split into terms."""
    idf = inverse_frequencies(docs, queries)
    terms = query_terms(queries).select("query_id", F.xxhash64("term").alias("term")).join(idf, "term")
    weights = terms.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("m"), F.sum("idf").alias("w"))
    out = pool.join(docs.select("doc_id", "text"), "doc_id").join(weights, "query_id")
    has = F.transform(tokens(F.col("text")), lambda x: F.xxhash64(x))
    both = F.aggregate(F.array_intersect(F.map_keys("m"), has), F.lit(0.0), lambda a, x: a + F.element_at("m", x))
    return out.withColumn("rel", F.round(F.coalesce(both, F.lit(0.0)) / F.col("w"), 6)).drop("m", "w", "text")


def _rank(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("long"))


def lexicographic(df: DataFrame) -> DataFrame:
    """Relevance, then year, then id. Recency is never added to relevance."""
    return _rank(df, F.desc("rel"), F.desc("year"), F.asc("doc_id"))


def relevance_only(df: DataFrame) -> DataFrame:
    return _rank(df, F.desc("rel"), F.asc("doc_id"))


def weighted(df: DataFrame, rel: float = 0.7, recency: float = 0.3) -> DataFrame:
    """The older sum of criteria, kept so that old baselines can be computed again."""
    score = F.round(rel * F.col("rel") + recency * (F.col("year") - 2000) / 24.0, 8)  # no decimal halves at the eighth digit
    return _rank(df.withColumn("score", score), F.desc("score"), F.asc("doc_id"))


def landmark_floor(run: DataFrame, place: int, least: float) -> DataFrame:
    """Landmark documents of relevance `least` or more that rank below `place` come right after it."""
    moved = F.when(F.col("landmark") & (F.col("rel") >= least) & (F.col("rank") > place), place + 0.5).otherwise(F.col("rank"))
    out = run.withColumn("place", moved).withColumnRenamed("rank", "old_rank")
    return _rank(out, "place", "old_rank").drop("place")


def sort_contract(run: DataFrame) -> DataFrame:
    """Per query, how often a row is out of the order that lexicographic() promises."""
    w = Window.partitionBy("query_id").orderBy("rank")
    before, year = F.lag("rel").over(w), F.lag("year").over(w)
    bad = (before < F.col("rel")) | ((before == F.col("rel")) & (year < F.col("year")))
    return run.withColumn("bad", bad).groupBy("query_id").agg(F.count("*").alias("n"), F.count(F.when(F.col("bad"), 1)).alias("n_violations"))
