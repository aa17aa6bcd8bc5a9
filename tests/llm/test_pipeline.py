"""The pipeline against a version of its stages in plain Python."""

import collections

import pytest
from brute import WORD, check_pieces, kept_lines, near, pairs, water
from pyspark.sql import functions as F

import corpus_pipeline
from evidora.llm import toxicity


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """The input and output of each stage, as the check tool runs them: written and read again."""
    from evidora.llm.common import cut

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, sf_dir), name)
        out.append((name, docs, after))
        docs = after
    return out


def test_columns_and_order(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "line_dedup", "minhash_near_dedup", "mixing", "best_fit_packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == stages[0][1].columns and after.dtypes == stages[0][1].dtypes


def test_toxicity(spark, sf_dir, stages):
    _, before, after = stages[0]
    machine = toxicity.fit(before, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    expected = [(i, t) for i, t in pairs(before) if max((machine.score(v) for v in machine.decide(sorted(toxicity.strings(t or "")))), default=0.0) < 0.7]
    assert sorted(pairs(after)) == sorted(expected)


def test_lines(stages):
    _, before, after = stages[1]
    expected = kept_lines(pairs(before))
    assert sorted(pairs(after)) == sorted((i, expected[i, t]) for i, t in pairs(before))
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near(stages):
    _, before, after = stages[2]
    comp = near(pairs(before))
    assert sorted(pairs(after)) == sorted((i, t) for (i, t), c in comp.items() if i == c)


def test_mixing(stages):
    _, before, after = stages[3]
    n = lambda t: len(WORD.findall(t or ""))
    source = {r["doc_id"]: r["source"] for r in before.collect()}
    sizes, taken = collections.Counter(), collections.Counter()
    for i, t in pairs(before):
        sizes[source[i]] += n(t)
    texts = dict(pairs(before))
    for i, t in pairs(after):
        taken[source[i]] += n(t)
        assert texts[i].startswith(t)
    target = water(sizes)
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)


def test_packing(stages):
    _, before, after = stages[4]
    check_pieces(before, after.collect())


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == stages[-1][2].columns
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(*key).collect())) == sorted(map(tuple, stages[-1][2].select(*key).collect()))
