"""Stems and entities against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from evidora.functions import porter
from evidora.functions.text import tokens
from evidora.operators import entities


class Plain:
    """The published algorithm, letter by letter."""

    def consonant(self, w, i):
        return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not self.consonant(w, i - 1))

    def measure(self, w):
        kinds = "".join("c" if self.consonant(w, i) else "v" for i in range(len(w)))
        return sum(a + b == "vc" for a, b in zip(kinds, kinds[1:]))

    def vowel(self, w):
        return any(not self.consonant(w, i) for i in range(len(w)))

    def cvc(self, w):
        n = len(w)
        return n >= 3 and self.consonant(w, n - 3) and not self.consonant(w, n - 2) and self.consonant(w, n - 1) and w[-1] not in "wxy"

    def table(self, w, t, least):
        for s in sorted(t, key=len, reverse=True):
            if w.endswith(s) and len(w) > len(s):
                return w[: -len(s)] + t[s] if least(w[: -len(s)], s) else w
        return w

    def stem(self, w):
        if len(w) < 3:
            return w
        if w.endswith("sses") or w.endswith("ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed"):
            w = w[:-1] if self.measure(w[:-3]) > 0 else w
        else:
            for s in ("ed", "ing"):
                if w.endswith(s):
                    if self.vowel(w[: -len(s)]):
                        w = w[: -len(s)]
                        if w.endswith(("at", "bl", "iz")):
                            w += "e"
                        elif len(w) > 1 and w[-1] == w[-2] and self.consonant(w, len(w) - 1):
                            w = w if w[-1] in "lsz" else w[:-1]
                        elif self.measure(w) == 1 and self.cvc(w):
                            w += "e"
                    break
        if w.endswith("y") and self.vowel(w[:-1]):
            w = w[:-1] + "i"
        w = self.table(w, porter.STEP_2, lambda x, s: self.measure(x) > 0)
        w = self.table(w, porter.STEP_3, lambda x, s: self.measure(x) > 0)
        w = self.table(w, dict.fromkeys([*porter.STEP_4, "ion"], ""), lambda x, s: self.measure(x) > 1 and (s != "ion" or x[-1] in "st"))
        if w.endswith("e"):
            m = self.measure(w[:-1])
            if m > 1 or m == 1 and not self.cvc(w[:-1]):
                w = w[:-1]
        if w.endswith("ll") and self.measure(w) > 1:
            w = w[:-1]
        return w


KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing",
    "conflated": "conflat", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
    "digitizer": "digit", "vietnamization": "vietnam", "hopefulness": "hope", "formalize": "formal", "electrical": "electr", "adoption": "adopt", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil", "yesterday": "yesterdai", "syzygy": "syzygi",
}


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    return {r["word"]: r["stem"] for r in porter.stemmed(df, "word", "stem").collect()}


def test_known_stems(spark):
    assert stems(spark, KNOWN) == KNOWN == {w: Plain().stem(w) for w in KNOWN}


def test_stems_by_brute_force(spark):
    rng = random.Random(5)
    parts = ["b", "at", "y", "ee", "s", "tion", "ing", "ed", "al", "ll", "iz", "e", "ous", "ly", "cr", "u", "ness", *porter.STEP_2, *porter.STEP_3, *porter.STEP_4]
    words = {"".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(4000)}
    vocabulary = {r["w"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.explode(tokens(F.col("text"))).alias("w")).distinct().collect()}
    got = stems(spark, words | vocabulary)
    plain = lambda w: Plain().stem(w) if w.isascii() and w.isalpha() else w
    assert got == {w: plain(w) for w in words | vocabulary} and len(vocabulary) > 1000


def test_stems_of_odd_words(spark):
    df = spark.createDataFrame([(None, 1), ("", 2), ("as", 3), ("été", 4), ("running2", 5)], "word string, stem int")
    assert [r["s"] for r in porter.stemmed(df, "word", "s").orderBy("stem").collect()] == [None, "", "as", "été", "running2"]


def plain_entities(text, names):
    words = __import__("re").findall(r"[^\W_]+", (text or "").lower())
    known, out, i = {tuple(n.lower().split()) for n in names if n and n.split()}, [], 0
    while i < len(words):
        n = max((n for n in range(1, len(words) - i + 1) if tuple(words[i : i + n]) in known), default=0)
        if n:
            out.append((i, " ".join(words[i : i + n])))
        i += n or 1
    return out


@pytest.mark.parametrize("most", [1 << 22, 30])
def test_entities(spark, most):
    """Names within names, side by side and overlapping; one automaton or many."""
    rng = random.Random(2)
    names = [" ".join(rng.choices("abcde", k=rng.randint(1, 4))) for _ in range(25)] + ["x", "x", None, "", "A  B"]
    texts = [(i, " ".join(rng.choices(["a", "b", "c", "d", "e", "ab", "x!", "x-a"], k=rng.randint(0, 30)))) for i in range(40)] + [(41, None), (42, ""), (7, "a b c"), (7, "a b c")]
    df, dictionary = spark.createDataFrame(texts, "item_id long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    got = sorted((r["item_id"], r["pos"], r["entity"]) for r in entities.recognised(df, dictionary, most=most).collect())
    assert got == sorted((i, p, e) for i, t in texts for p, e in plain_entities(t, names))
    assert entities.recognised(df, dictionary.limit(0)).count() == 0 and entities.recognised(df.limit(0), dictionary).count() == 0


def test_a_large_dictionary(spark):
    names = spark.range(100_000).select(F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
    texts = spark.createDataFrame([(1, "a Name 99999 and name 5 6, name 100000")], "item_id long, text string")
    got = [(r["pos"], r["entity"]) for r in entities.recognised(texts, names).orderBy("pos").collect()]
    assert got == [(1, "name 99999"), (4, "name 5")]
