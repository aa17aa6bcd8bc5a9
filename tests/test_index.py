"""The stored index: its search against a plain one, and what it leaves unread."""

import random

import pytest
from pyspark.sql import functions as F

from evidora.operators import index, retrieve


def zipf(n, seed=1, words=400):
    """Documents of words that fall off in frequency; a few are copies."""
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(words)]
    rows = [(i * 7, " ".join(rng.choices([f"w{j}" for j in range(words)], weights, k=rng.randint(5, 60)))) for i in range(n)]
    return rows + [(i * 7 + 1, rows[i][1]) for i in range(0, n, 50)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(zipf(1500), "doc_id long, text string")


@pytest.fixture(scope="module")
def store(spark, docs, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index"))
    index.build(docs, path, window=16, buckets=8)
    return index.Index(spark, path)


def rows(df):
    return sorted(map(tuple, df.select("query_id", "doc_id", "score", "rank").collect()))


QUERIES = [(1, "w1 w2 w300"), (2, "w0"), (3, "w350 w399 w1 w0 w2"), (4, "nothing known"), (5, " ".join(f"w{i}" for i in range(0, 400, 9))), (6, ""), (7, None), (8, "w390 nothing")]


@pytest.mark.parametrize("k, first", [(10, 0.6), (1, 0.3), (5000, 0.6)])
def test_search_is_exact(spark, docs, store, k, first):
    q = spark.createDataFrame(QUERIES, "item_id long, text string")
    assert rows(index.search(store, q, k, first, most_terms=16)) == rows(index.search(store, q, k, first, most_terms=1000)) == rows(retrieve.bm25(docs, q, k))


def test_blocks_are_skipped(spark, docs, store):
    q = spark.createDataFrame([(3, "w350 w399 w1 w0 w2"), (1, "w1 w2 w300"), (2, "w0")], "item_id long, text string")
    found = index.Search(store, index.known_terms(store, q), 5)
    read = {r["query_id"]: (r["n_blocks"], r["n_read"]) for r in found.plan().collect()}
    assert read[3][1] < 0.4 * read[3][0] and read[1][1] < 0.6 * read[1][0] and read[2][0] == read[2][1] > 50
    assert rows(found.run()) == rows(retrieve.bm25(docs, q, 5))


def test_long_queries_in_groups(spark, docs, store):
    """However few numbers a pass may hold."""
    q = spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i, 400, 11))) for i in range(12)], "item_id long, text string")
    terms = index.known_terms(store, q)
    for most in (1, 200, 1 << 23):
        assert rows(retrieve.ranked(index.whole(store, terms, 7, most), 7)) == rows(retrieve.bm25(docs, q, 7))


def test_store(spark, docs, store):
    """Blocks hold each posting once, in the order of impact under their bound, no more than the window's documents, and are read by bucket."""
    blocks = store.blocks
    assert blocks.agg(F.sum("n")).first()[0] == retrieve.postings(docs).count()
    k1, b, avgdl = store.factors
    weights = blocks.withColumn("weights", F.expr(f"zip_with(tfs, dls, (t, d) -> t * ({k1} + 1D) / (t + {k1}D * (1 - {b}D + {b}D * d / {avgdl}D)))"))
    bad = weights.where("size(ids) <> n or size(weights) <> n or abs(weights[0] - most) > 1e-12 or exists(zip_with(slice(weights, 1, n - 1), slice(weights, 2, n), (a, b) -> a < b - 1e-12), x -> x)")
    assert bad.count() == 0 and blocks.groupBy("window").agg(F.countDistinct("bucket")).count() == store.windows
    plan = blocks.where("bucket = 3 and term = 'w1'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters: [IsNotNull(term)" in plan


def test_empty_and_missing(spark, docs, tmp_path):
    q = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    with pytest.raises(Exception):
        index.Index(spark, str(tmp_path / "none"))
    odd = spark.createDataFrame([(1, None), (None, "w1"), (2, ""), (3, "w1 w1")], "doc_id long, text string")
    index.build(odd, str(tmp_path / "odd"))
    assert [r["doc_id"] for r in index.search(index.Index(spark, str(tmp_path / "odd")), q).collect()] == [3]
    index.build(docs.limit(0), str(tmp_path / "empty"))
    assert index.search(index.Index(spark, str(tmp_path / "empty")), q).count() == 0


def test_built_once(spark, docs):
    assert index.stored(docs, "a", window=64).path == index.stored(docs, "a", window=64).path != index.stored(docs, "b", window=64).path


def test_postings_move_packed(spark, docs, tmp_path):
    """A bucket is written by one task for each PART windows, whatever the number of shuffle partitions, and what is shuffled is a row for each window and bucket."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        index.build(docs, str(tmp_path / "store"), window=16, buckets=8)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    store = index.Index(spark, str(tmp_path / "store"))
    assert len(store.blocks.inputFiles()) == 8
    packed = store.blocks.select(*[x.split()[0] for x in index.BLOCKS.split(", ")]).mapInArrow(index._repacked, index.PACKED)
    assert packed.count() == store.blocks.select("bucket", "window").distinct().count() < store.blocks.count() / 4
    again = packed.mapInArrow(index._unpacked, index.BLOCKS)
    assert again.exceptAll(store.blocks).count() == store.blocks.exceptAll(again).count() == 0
