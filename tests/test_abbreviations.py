"""Abbreviations against all ways to align them."""

import itertools
import random

import pytest

from evidora.operators import abbreviations

KNOWN = [
    ("We saw heat shock transcription factor (HSF) here.", [("HSF", "heat shock transcription factor")]),
    ("Patients with chronic obstructive pulmonary disease (COPD) and heart failure (HF; see below).", [("COPD", "chronic obstructive pulmonary disease"), ("HF", "heart failure")]),
    ("the number of cases (n = 30) was high (see below)", []),
    ("a randomised controlled trial (RCT), not a TRIAL (XYZ)", [("RCT", "randomised controlled trial")]),
    ("In Germany. Tumor necrosis factor-alpha (TNF-a) is", [("TNF-a", "Tumor necrosis factor-alpha")]),
    ("low density lipoprotein (LDL) and LDL (LDL)", [("LDL", "low density lipoprotein")]),
    ("(AB) nothing before", []),
]


@pytest.mark.parametrize("text, expected", KNOWN)
def test_known(text, expected):
    assert [(s, x) for _, s, x in abbreviations.definitions(text)] == expected


def brute(short, before):
    """The shortest end of whole words whose first letter begins short and that has the rest of its letters in order after it, tried out."""
    letters = [c.lower() for c in short if c.isalnum()]
    starts = [i for i in range(len(before)) if before[i] != " " and (i == 0 or before[i - 1] == " ")]
    for start in reversed(starts):
        end = before[start:]
        inside = [i for i, c in enumerate(end) if c.lower() == letters[0] and (i == 0 or not end[i - 1].isalnum())]
        word = end.split(" ")[0]
        for i in inside:
            if i < len(word) and any(True for places in itertools.combinations(range(i + 1, len(end)), len(letters) - 1) if all(end[p].lower() == c for p, c in zip(places, letters[1:]))):
                return None if len(end) <= len(short) or short in end.split() else end
    return None


def test_alignment_by_brute_force():
    rng = random.Random(6)
    found = 0
    for _ in range(3000):
        before = " ".join("".join(rng.choice("abc-") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4)))
        short = rng.choice("abc") + "".join(rng.choice("abc") for _ in range(rng.randint(1, 2)))
        assert abbreviations.aligned(short, before) == brute(short, before), (short, before)
        found += abbreviations.aligned(short, before) is not None
    assert found > 300


def test_first_use(spark):
    rows = [(1, "Low density lipoprotein (LDL) rose; LDL fell."), (2, "LDL rose. Low density lipoprotein (LDL) fell."), (3, "The ALDLX of low density lipoprotein (LDL)."), (4, "An XYZ (LDL) is no full form"), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["abbr"]): (r["first_pos"], r["introduced"]) for r in abbreviations.introduced(df).collect()}
    assert got == {(1, "LDL"): (26, True), (2, "LDL"): (1, False), (3, "ALDLX"): (5, False), (3, "LDL"): (39, True), (4, "XYZ"): (4, False), (4, "LDL"): (9, False)}
    assert abbreviations.defined(df.limit(0)).count() == 0
