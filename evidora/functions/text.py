"""Text expressions: tokens, stems, markup. All JVM-side columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def words(text: Column) -> Column:
    """White-space separated words, in order."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def stem(token: Column) -> Column:
    """A light suffix stemmer: strips one of a few English endings from tokens of six letters or more."""
    return F.when(F.length(token) >= 6, F.regexp_replace(token, "(ations|ation|ings|ing|edly|ed|ers|er|ly|es|s)$", "")).otherwise(token)


def strip_markup(html: Column) -> Column:
    """Text of an HTML page: comments, scripts and styles go first, then tags, then runs of white space."""
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?si)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
