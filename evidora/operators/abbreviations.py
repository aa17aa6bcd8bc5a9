"""Abbreviations and their full forms, aligned letter by letter (A. Schwartz and M. Hearst, 2003)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BRACKET = re.compile(r"\(([^()]{2,60})\)")
_WORD = re.compile(r"\S+")


def fits(short: str) -> bool:
    """Two to ten characters in at most two words, with a letter, the first one a letter or digit."""
    return 2 <= len(short) <= 10 and len(short.split()) <= 2 and any(c.isalpha() for c in short) and short[0].isalnum()


def aligned(short: str, before: str) -> str | None:
    """The shortest end of `before` that short abbreviates: its letters and digits occur there in order, whatever their case, and the first one begins a word. None if there
    is none, or if it is no longer than short or has short as a word."""
    at = len(before)
    for i in range(len(short) - 1, -1, -1):
        c = short[i].lower()
        if not c.isalnum():
            continue
        at -= 1
        while at >= 0 and (before[at].lower() != c or i == 0 and at > 0 and before[at - 1].isalnum()):
            at -= 1
        if at < 0:
            return None
    start = before.rfind(" ", 0, at + 1) + 1
    long = before[start:].strip()
    return None if len(long) <= len(short) or short in long.split() else long


def definitions(text: str) -> Iterator[tuple[int, str, str]]:
    """place of the bracket, abbreviation, full form, for each `full form (ABC)` of a text. The full form is sought in the words before the bracket, min(n + 5, 2 n) of them for n
    letters, back to the last bracket or end of a sentence."""
    for m in _BRACKET.finditer(text):
        short = re.split(r"[,;]", m[1])[0].strip()
        if not fits(short):
            continue
        before = re.split(r"[()\n]|[.!?]\s", text[max(0, m.start() - 1000) : m.start()])[-1]
        words = _WORD.findall(before)[-min(len(short) + 5, 2 * len(short)) :]
        if found := aligned(short, " ".join(words)):
            yield m.start(), short, found


def defined(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, pos, short, long: every definition in whole texts; pos counts characters from 0. Null and empty texts have none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, found = [], []
            for i, text in enumerate(batch.column(1)):
                for one in definitions(text.as_py()):
                    row.append(i)
                    found.append(one)
            pos, short, long = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int64()), pa.array(short, pa.string()), pa.array(long, pa.string())], names=["id", "pos", "short", "long"])

    kind = texts.schema[id_col].dataType.simpleString()
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.contains("text", F.lit("(")))
    return rows.mapInArrow(run, f"id {kind}, pos long, short string, long string")


def introduced(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, abbr, first_pos, introduced: for each abbreviation of a text (two to five capitals that are a whole word), where it first stands (from 1), and whether that is in
    brackets after a full form that it abbreviates. Words that merely contain the letters count for nothing."""
    words = F.array_distinct(F.regexp_extract_all(F.col(text_col), F.lit(r"(?<![\p{L}\p{N}])([A-Z]{2,5})(?![\p{L}\p{N}])"), F.lit(1)))
    each = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.explode(words).alias("abbr"))
    first = F.expr(r"length(split(text, concat('(?<![\\p{L}\\p{N}])', abbr, '(?![\\p{L}\\p{N}])'), 2)[0])")
    placed = each.select("id", "abbr", (first + 1).cast("long").alias("first_pos"))
    known = defined(texts, id_col, text_col).groupBy("id", F.col("short").alias("abbr")).agg(F.min("pos").alias("pos"))
    out = placed.join(known, ["id", "abbr"], "left")
    return out.select(F.col("id").alias(id_col), "abbr", "first_pos", F.coalesce(F.col("pos") + 2 == F.col("first_pos"), F.lit(False)).alias("introduced"))
