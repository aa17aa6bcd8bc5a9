"""Answers: generation stand-ins, citation checks, refusals, repair."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.text import numbers


def cited(answer: Column) -> Column:
    """The numbers of the [S#] markers of an answer, in order."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[S(\d+)\]"), F.lit(1)), lambda x: x.cast("long"))


def first_sentence(text: Column) -> Column:
    return F.regexp_extract(text, r"^([^.!?\n]*[.!?]?)", 1)


class Generator(Protocol):
    """Writes an answer from numbered evidence; a language model plugs in here."""

    def answer(self, question: str, context: str) -> str: ...


class FirstWords:
    """Deterministic stand-in: the first words of the context, as every stage of the chain."""

    def answer(self, question: str, context: str) -> str:
        return " ".join(context.split()[:40])


def chain(questions: DataFrame, generator: Generator) -> DataFrame:
    """query_id, stage, output: evidence assessment, answer, critique and final version of each question with context."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for q, text, ctx in pdf[["query_id", "text", "context"]].itertuples(index=False):
                draft = ctx or ""
                for stage in ("assess", "answer", "critique", "final"):
                    draft = generator.answer(text or "", draft)
                    rows.append((q, stage, draft))
            yield pd.DataFrame(rows, columns=["query_id", "stage", "output"])

    return questions.select("query_id", "text", "context").mapInPandas(run, "query_id long, stage string, output string")


def extractive(ctx: DataFrame) -> DataFrame:
    """query_id, n_sources, answer: the first sentence of each context item with its marker."""
    items = F.array_sort(F.collect_list(F.struct("s_no", "cite", first_sentence(F.col("text")).alias("s"))))
    return ctx.groupBy("query_id").agg(F.count("*").alias("n_sources"), F.array_join(F.transform(items, lambda x: F.concat(x["s"], F.lit(" "), x["cite"])), " ").alias("answer"))


def out_of_range(answers: DataFrame) -> DataFrame:
    bad = F.filter(cited(F.col("answer")), lambda x: (x < 1) | (x > F.col("n_sources")))
    return answers.select("query_id", "n_sources", F.size(cited(F.col("answer"))).cast("long").alias("n_cited"), F.size(bad).cast("long").alias("n_bad"))


def fabricated(refs: DataFrame, catalog: DataFrame) -> DataFrame:
    """References (query_id, doc_id) that the catalogue doesn't have."""
    return refs.join(catalog.select("doc_id"), "doc_id", "left_anti").select("query_id", "doc_id")


def beyond_boundary(queries: DataFrame, run: DataFrame, least: float) -> DataFrame:
    """A question whose best evidence scores under `least`, or that has none, is to be refused."""
    best = run.groupBy("query_id").agg(F.max("score").alias("best"))
    out = queries.select(F.col("item_id").alias("query_id")).join(best, "query_id", "left")
    return out.select("query_id", "best", (F.coalesce("best", F.lit(0.0)) < least).alias("refused"))


def too_late(evidence: DataFrame, asked: DataFrame) -> DataFrame:
    """Evidence (query_id, doc_id, year) later than the year asked about (query_id, asked_year)."""
    return evidence.join(asked, "query_id").where(F.col("year") > F.col("asked_year")).select("query_id", "doc_id", "year", "asked_year")


def tristate(evidence: DataFrame, asked: DataFrame) -> DataFrame:
    """refused if no evidence is early enough, partial if some isn't, else normal."""
    late = F.count(F.when(F.col("year") > F.col("asked_year"), 1))
    out = asked.join(evidence, "query_id", "left").groupBy("query_id").agg(F.count("doc_id").alias("n"), late.alias("n_late"))
    return out.select("query_id", "n", "n_late", F.when(F.col("n") == F.col("n_late"), "refused").when(F.col("n_late") > 0, "partial").otherwise("normal").alias("status"))


def missing_sections(answers: DataFrame, required: list[str]) -> DataFrame:
    lacking = F.filter(F.array(*[F.lit(x) for x in required]), lambda x: ~F.contains(F.col("answer"), x))
    return answers.select("query_id", F.array_join(lacking, ",").alias("missing"), (F.size(lacking) == 0).alias("complete"))


def reference_balance(answers: DataFrame) -> DataFrame:
    """What is cited but not listed (1..n_sources), and the other way round."""
    listed = F.when(F.col("n_sources") > 0, F.sequence(F.lit(1).cast("long"), F.col("n_sources"))).otherwise(F.array().cast("array<bigint>"))
    c = F.array_distinct(cited(F.col("answer")))
    join = lambda a: F.array_join(F.transform(F.array_sort(a), lambda x: x.cast("string")), ",")
    return answers.select("query_id", join(F.array_except(c, listed)).alias("unlisted"), join(F.array_except(listed, c)).alias("uncited"))


def repair(answers: DataFrame) -> DataFrame:
    """Takes markers out of range away and appends those that are missing."""
    listed = F.when(F.col("n_sources") > 0, F.sequence(F.lit(1).cast("long"), F.col("n_sources"))).otherwise(F.array().cast("array<bigint>"))
    bad = F.array_distinct(F.filter(cited(F.col("answer")), lambda x: (x < 1) | (x > F.col("n_sources"))))
    cleaned = F.aggregate(bad, F.col("answer"), lambda a, x: F.replace(a, F.concat(F.lit(" [S"), x.cast("string"), F.lit("]")), F.lit("")))
    missing = F.array_sort(F.array_except(listed, cited(F.col("answer"))))
    tail = F.array_join(F.transform(missing, lambda x: F.concat(F.lit(" [S"), x.cast("string"), F.lit("]"))), "")
    return answers.select("query_id", F.concat(cleaned, tail).alias("answer"))


def unsupported_numbers(answers: DataFrame, rendered: DataFrame) -> DataFrame:
    """Numbers of an answer, its markers aside, that its evidence doesn't have."""
    plain = F.regexp_replace("answer", r"\[S\d+\]", "")
    out = answers.join(rendered.select("query_id", "context"), "query_id")
    lone = F.array_except(numbers(plain), numbers(F.regexp_replace("context", r"\[S\d+\]", "")))
    return out.select("query_id", F.array_join(F.array_sort(lone), ",").alias("unsupported"), F.size(lone).cast("long").alias("n_unsupported"))
