import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, k string, h string, tag int, size string, sig string, grp int, rank int, class string, _id int"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every oddity: nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    rng = random.Random(4)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(200)
    shared = prose(60)
    rows = [(1, base), (2, base), (3, base + " tail"), (4, ""), (5, None), (6, "x"), (7, " \t\n\x0b "), (8, prose(30) + " " + shared + " " + prose(30))]
    rows += [(9, prose(50) + "\n" + shared), (10, prose(6000)), (10, prose(80)), (11, "one"), (11, "one"), (None, base), (None, "no id"), (None, None)]
    rows += [(12, "line a is here now\nline a is here now\n\n\nline b is there"), (13, "a b   c " + prose(60)), (14, "é" * 3000), (15, shared + " " + shared)]
    rows += [(16, " ".join([prose(40)] * 6)), (17, "the the " * 200)]
    out = [(i, t, None if i == 6 else "en", [None, "a", "b", "c"][(i or 0) % 4], None, "z", "z", 1, "z", "z", 1, 1, "z", 3) for i, t in rows]
    return spark.createDataFrame(out, SCHEMA)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
