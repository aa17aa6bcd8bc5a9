"""Connected components: in one task, and by rounds."""

import random

import pytest

from evidora.operators import links


@pytest.mark.parametrize("few", [links.FEW, 0])
@pytest.mark.parametrize("kind", [int, "k{:05d}".format])
def test_few_edges_and_many(spark, few, kind):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 300, 2)] + [(i, i + 7) for i in range(1000, 1200)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(250)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    rows = [(kind(a), kind(b)) for a, b in edges] + [(None, kind(1)), (kind(2), None)]
    df = spark.createDataFrame(rows, "a long, b long" if kind is int else "a string, b string").repartition(4)
    got = sorted(map(tuple, links.components(df, few=few).collect()))
    assert got == sorted((kind(x), kind(find(x))) for x in root if find(x) != x)
    assert links.components(df.limit(0), few=few).collect() == []


def test_few_edges_take_two_jobs_of_writing(spark):
    """A chain that would take many rounds."""
    cuts = []
    links.components(spark.range(500).selectExpr("id as a", "id + 1 as b"), cut=lambda df, name: cuts.append(name) or links.cut(df, name)).count()
    assert len(cuts) == 2
