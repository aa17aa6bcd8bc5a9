"""Versions of documents: postings kept up equal a rebuild, at every version."""

import random

import pytest

from evidora.operators import retrieve, versions

SCHEMA = "doc_id long, text string, lang string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_postings_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(1)
    store = versions.Versions(spark, str(tmp_path / "store"), SCHEMA)
    assert store.latest() == 0 and rows(store.documents()) == rows(store.postings()) == []
    truth, history = {}, {}
    for step in range(6):
        changes = {i: " ".join(rng.choices("abcdef", k=rng.randint(0, 6))) for i in rng.sample(range(12), 5)}
        deletes = [] if step == 0 else rng.sample(range(14), 3)
        if step == 3:
            number = store.compact()
        else:
            df = spark.createDataFrame([(i, t or None, "en") for i, t in changes.items()], SCHEMA)
            number = store.upsert(df if step != 4 else None, spark.createDataFrame([(i,) for i in deletes], "doc_id long") if deletes else None)
            for i in deletes:
                truth.pop(i, None)
            if step != 4:
                truth.update({i: t or None for i, t in changes.items()})
        history[number] = dict(truth)
    assert sorted(history) == list(range(1, 7)) and store.latest() == 6
    for number, expected in history.items():
        docs = spark.createDataFrame([(i, t, "en") for i, t in expected.items()], SCHEMA)
        assert rows(store.documents(number)) == rows(docs)
        assert rows(store.postings(number).select("term", "doc_id", "tf")) == rows(retrieve.postings(docs).select("term", "doc_id", "tf"))
    assert len(store.manifest(4)) == 1 and len(store.manifest(3)) > 3


def test_a_failed_commit_is_none(spark, tmp_path):
    store = versions.Versions(spark, str(tmp_path / "store"), SCHEMA)
    store.upsert(spark.createDataFrame([(1, "a", "en")], SCHEMA))
    for bad in ([(2, "b", "en"), (2, "c", "en")], [(None, "b", "en")]):
        with pytest.raises(ValueError):
            store.upsert(spark.createDataFrame(bad, SCHEMA))
    assert store.latest() == 1 and rows(store.documents()) == [(1, "a", "en")]
    store._commit(2, store.manifest(1))
    with pytest.raises(Exception):
        store._commit(2, store.manifest(1))  # someone else was first


def test_postings_are_counted_without_a_shuffle(spark):
    docs = spark.createDataFrame([(3, "B b a"), (1, ""), (2, None), (4, "é ü1 b é"), (None, "z z")] + [(i, f"w{i % 7} b") for i in range(10, 700)], "doc_id long, text string")
    out = retrieve.distinct_postings(docs)
    assert rows(out.select("term", "doc_id", "tf")) == rows(retrieve.postings(docs).select("term", "doc_id", "tf"))
    assert "Exchange" not in out._jdf.queryExecution().toString()
