"""The Porter stemmer (M. F. Porter, 1980) as column expressions: measure-based rules in steps, each step one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A consonant is a letter other than a, e, i, o, u, and y where it follows a vowel or begins the word; a y that begins a word is written Y meanwhile.
_C, _V = "[^aeiou]", "[aeiouy]"
_CS, _VS = f"{_C}[^aeiouy]*", f"{_V}[aeiou]*"
#: Stems of measure over 0, of 1, over 1; with a vowel; that end in consonant, vowel, consonant other than w, x, y.
OVER_0, EXACTLY_1, OVER_1 = f"^({_CS})?{_VS}{_CS}", f"^({_CS})?{_VS}{_CS}({_VS})?$", f"^({_CS})?{_VS}{_CS}{_VS}{_CS}"
VOWEL, CVC = f"^({_CS})?{_V}", f"^{_CS}{_V}[^aeiouwxy]$"

# The published suffix tables of steps 2, 3 and 4.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = "al ance ence er ic able ible ant ement ment ent ou ism ate iti ous ive ize".split()


def _any(suffixes) -> str:
    return "|".join(sorted(suffixes, key=lambda s: (-len(s), s)))


def _replaced(w: Column, table: dict[str, str]) -> Column:
    """The longest suffix of the table goes to its replacement, if its stem's measure is over 0."""
    pattern = f"^(.+?)({_any(table)})$"
    stem, suffix = F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)
    new = F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), suffix)
    return F.when((suffix != "") & stem.rlike(OVER_0), F.concat(stem, new)).otherwise(w)


def _steps() -> list:
    """Column -> Column, in order. Every step reads the last one's word a few times, so each is a projection of its own."""
    def first(w: Column) -> Column:
        w = F.when(w.startswith("y"), F.concat(F.lit("Y"), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)
        return F.when(w.rlike("(ss|i)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("[^s]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)

    def step_1b(w: Column) -> Column:
        stem = F.regexp_replace(w, "(ed|ing)$", "")
        doubled = stem.rlike(r"(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$")
        fixed = F.when(stem.rlike("(at|bl|iz)$"), F.concat(stem, F.lit("e"))).when(doubled, F.substring(stem, F.lit(1), F.length(stem) - 1)).when(stem.rlike(CVC), F.concat(stem, F.lit("e"))).otherwise(stem)
        less = F.regexp_replace(w, "eed$", "ee")
        return F.when(w.endswith("eed"), F.when(F.regexp_replace(w, "eed$", "").rlike(OVER_0), less).otherwise(w)).when(w.rlike("(ed|ing)$") & stem.rlike(VOWEL), fixed).otherwise(w)

    def step_1c(w: Column) -> Column:
        stem = F.regexp_replace(w, "y$", "")
        return F.when(w.endswith("y") & stem.rlike(VOWEL), F.concat(stem, F.lit("i"))).otherwise(w)

    def step_4(w: Column) -> Column:
        pattern = f"^(.+?)({_any([*STEP_4, 'ion'])})$"
        stem, suffix = F.regexp_extract(w, pattern, 1), F.regexp_extract(w, pattern, 2)
        return F.when((suffix != "") & stem.rlike(OVER_1) & ((suffix != "ion") | stem.rlike("[st]$")), stem).otherwise(w)

    def step_5a(w: Column) -> Column:
        stem = F.regexp_replace(w, "e$", "")
        return F.when(w.endswith("e") & (stem.rlike(OVER_1) | stem.rlike(EXACTLY_1) & ~stem.rlike(CVC)), stem).otherwise(w)

    def step_5b(w: Column) -> Column:
        w = F.when(w.endswith("ll") & w.rlike(OVER_1), F.regexp_replace(w, "l$", "")).otherwise(w)
        return F.when(w.startswith("Y"), F.concat(F.lit("y"), F.substring(w, F.lit(2), F.length(w)))).otherwise(w)

    return [first, step_1b, step_1c, lambda w: _replaced(w, STEP_2), lambda w: _replaced(w, STEP_3), step_4, step_5a, step_5b]


def stemmed(words: DataFrame, word: str, stem: str) -> DataFrame:
    """words with a column more: the stem of each lower-case word. Words of under three letters, and those with other characters than a-z, are their own stems; null stays
    null. Stem distinct words: a vocabulary has few of them."""
    plain = F.col(word).rlike("^[a-z]{3,}$")
    out = words.withColumn(stem, F.col(word))
    for step in _steps():
        out = out.withColumn(stem, F.when(plain, step(F.col(stem))).otherwise(F.col(stem)))
    return out


def _sql_steps() -> list[str]:
    """The same rules in DuckDB's SQL, w being the word."""
    def table(t: dict[str, str]) -> str:
        p = f"'^(.+?)({_any(t)})$'"
        new = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.items())
        return f"CASE WHEN regexp_extract(w, {p}, 2) <> '' AND regexp_matches(regexp_extract(w, {p}, 1), '{OVER_0}') THEN regexp_extract(w, {p}, 1) || CASE regexp_extract(w, {p}, 2) {new} END ELSE w END"

    y = "CASE WHEN starts_with(w, 'y') THEN 'Y' || substr(w, 2) ELSE w END"
    b = "regexp_replace(w, '(ed|ing)$', '')"
    p4 = f"'^(.+?)({_any([*STEP_4, 'ion'])})$'"
    s4, x4, e = f"regexp_extract(w, {p4}, 1)", f"regexp_extract(w, {p4}, 2)", "regexp_replace(w, 'e$', '')"
    return [
        y,
        "CASE WHEN regexp_matches(w, '(ss|i)es$') THEN substr(w, 1, length(w) - 2) WHEN regexp_matches(w, '[^s]s$') THEN substr(w, 1, length(w) - 1) ELSE w END",
        f"CASE WHEN ends_with(w, 'eed') THEN CASE WHEN regexp_matches(substr(w, 1, length(w) - 3), '{OVER_0}') THEN substr(w, 1, length(w) - 1) ELSE w END "
        f"WHEN regexp_matches(w, '(ed|ing)$') AND regexp_matches({b}, '{VOWEL}') THEN CASE WHEN regexp_matches({b}, '(at|bl|iz)$') THEN {b} || 'e' "
        f"WHEN regexp_matches({b}, '(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$') THEN substr({b}, 1, length({b}) - 1) WHEN regexp_matches({b}, '{CVC}') THEN {b} || 'e' ELSE {b} END ELSE w END",
        f"CASE WHEN ends_with(w, 'y') AND regexp_matches(substr(w, 1, length(w) - 1), '{VOWEL}') THEN substr(w, 1, length(w) - 1) || 'i' ELSE w END",
        table(STEP_2),
        table(STEP_3),
        f"CASE WHEN {x4} <> '' AND regexp_matches({s4}, '{OVER_1}') AND ({x4} <> 'ion' OR regexp_matches({s4}, '[st]$')) THEN {s4} ELSE w END",
        f"CASE WHEN ends_with(w, 'e') AND (regexp_matches({e}, '{OVER_1}') OR regexp_matches({e}, '{EXACTLY_1}') AND NOT regexp_matches({e}, '{CVC}')) THEN {e} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND regexp_matches(w, '{OVER_1}') THEN substr(w, 1, length(w) - 1) ELSE w END",
        "CASE WHEN starts_with(w, 'Y') THEN 'y' || substr(w, 2) ELSE w END",
    ]


def stem_sql(words: str) -> str:
    """A SELECT of word, stem from the DuckDB relation `words` (word)."""
    out = f"SELECT word, word AS w FROM {words}"
    for step in _sql_steps():
        out = f"SELECT word, CASE WHEN regexp_matches(word, '^[a-z]{{3,}}$') THEN {step} ELSE w END AS w FROM ({out})"
    return f"SELECT word, w AS stem FROM ({out})"
