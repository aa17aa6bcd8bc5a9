"""Query understanding by dictionaries: translation, dropped terms, entities, synonyms, filters, classes."""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.functions.text import tokens


def translate(queries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """item_id, retrieval_query, dropped: words outside the dictionary (src, dst) are dropped whole, and the
    effective query and what it lost are returned so that the loss can be seen."""
    words = queries.select("item_id", F.posexplode(tokens(F.col("text"))).alias("pos", "src"))
    kept = words.join(dictionary, "src").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("pos", "src", "dst"))).alias("kept"))
    out = queries.join(kept, "item_id", "left")
    have = F.coalesce(F.col("kept"), F.array().cast("array<struct<pos:int,src:string,dst:string>>"))
    dropped = F.array_sort(F.array_except(tokens(F.col("text")), F.transform(have, lambda x: x["src"])))
    return out.select("item_id", F.array_join(F.transform(have, lambda x: x["dst"]), " ").alias("retrieval_query"), dropped.alias("dropped"))


def entities(queries: DataFrame, names: DataFrame, most: int = 3) -> DataFrame:
    """item_id, pos, entity: the longest name (of up to `most` words) of the dictionary at each position."""
    toks = tokens(F.col("text"))
    words = queries.select("item_id", toks.alias("t")).select("item_id", "t", F.posexplode("t").alias("pos", "w"))
    grams = words.select("item_id", "pos", F.explode(F.expr(f"transform(sequence(1, least({most}, size(t) - pos)), n -> struct(n as n, array_join(slice(t, pos + 1, n), ' ') as name))")).alias("g"))
    found = grams.select("item_id", F.col("pos").cast("long").alias("pos"), "g.n", "g.name").join(names, "name")
    return found.groupBy("item_id", "pos").agg(F.max_by("name", "n").alias("entity"))


def expand(queries: DataFrame, synonyms: DataFrame) -> DataFrame:
    """item_id, term: the distinct terms of each query with their synonyms (term, synonym)."""
    terms = queries.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    both = terms.join(synonyms, "term", "left")
    return both.select("item_id", F.explode(F.array_compact(F.array("term", "synonym"))).alias("term")).distinct()


def filters(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The year and the language that a question or address names, empty where it names none."""
    return texts.select(id_col, F.regexp_extract(text_col, r"((?:19|20)\d\d)", 1).alias("year"), F.regexp_extract(text_col, "/(en|fr|de|es)/", 1).alias("lang"))


def tag(queries: DataFrame) -> DataFrame:
    """Evaluation stratum of a query: T3 anchored on an identifier, T1 in another script, else T2."""
    c = F.when(F.col("text").rlike("[0-9]"), "T3").when(F.col("text").rlike("[^\\x00-\\x7F]"), "T1").otherwise("T2")
    return queries.select("item_id", c.alias("class"))


def cached_translation(queries: DataFrame, cache: DataFrame, computed: DataFrame) -> DataFrame:
    """The frozen translation of a query's text where the cache (text, translation) has it, else the computed one."""
    out = queries.join(cache, "text", "left").join(computed, "item_id")
    return out.select("item_id", F.coalesce("translation", "retrieval_query").alias("translation"), F.col("translation").isNotNull().alias("hit"))


class Translator(Protocol):
    """Turns questions into the corpus's language; a model plugs in here."""

    def translate(self, texts: list[str]) -> list[str]: ...


class Unchanged:
    """Deterministic stand-in: the questions as they are, white space collapsed."""

    def translate(self, texts: list[str]) -> list[str]:
        return [" ".join(t.split()) for t in texts]


def translated(queries: DataFrame, translator: Translator) -> DataFrame:
    """item_id, retrieval_query: each question through a translator, in Arrow batches."""
    @F.pandas_udf("string")
    def turn(texts: pd.Series) -> pd.Series:
        return pd.Series(translator.translate(texts.fillna("").tolist()), dtype="object")

    return queries.select("item_id", turn("text").alias("retrieval_query"))
