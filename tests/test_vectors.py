"""The inverted file with product codes: recall against exact search, and what it keeps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidora.operators import retrieve, vectors


def frame(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")


def recall(found, exact):
    a, b = ({(r["query_id"], r["doc_id"]) for r in df.collect()} for df in (found, exact))
    return len(a & b) / len(b)


def test_recall_on_the_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        v = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
        q = v.where("vec_id % 20 = 0")
        exact, found = retrieve.knn(v, q), vectors.knn(v, q).cache()
        assert recall(found, exact) >= 0.9
        scores = {(r["query_id"], r["doc_id"]): r["score"] for r in retrieve.knn(v, q, 100).collect()}
        assert all(abs(scores.get((r["query_id"], r["doc_id"]), r["score"]) - r["score"]) < 2e-6 for r in found.collect())


def test_every_vector_is_in_one_list(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.tile(rng.standard_normal(16), (300, 1)), rng.standard_normal((300, 16))])  # half of them equal: a hot list
    v = frame(spark, x)
    model = vectors.fit(v, 8, 4, 16, 3)
    codes = vectors.encoded(v, model, 50)
    assert sorted(r[0] for r in codes.select(F.explode("ids")).collect()) == list(range(600))
    assert codes.agg(F.max(F.size("ids")), F.sum(F.length("codes"))).first() == (50, 600 * 4)
    q = v.where("vec_id in (0, 400, 500)")
    everything = vectors.search(v, codes, model, q, 5, probes=8, rescore=600)
    assert sorted(map(tuple, everything.collect())) == sorted(map(tuple, retrieve.knn(v, q, 5).select("query_id", "doc_id", "score", "rank").collect()))


def test_tasks_hold_bounded_blocks(spark):
    """Distances to many centers are worked out in blocks, and what a task holds of its queries' candidates is cut down without losing any."""
    import tracemalloc

    rng = np.random.default_rng(4)
    x, centers = rng.standard_normal((4096, 8)), rng.standard_normal((8192, 8))
    tracemalloc.start()
    at = vectors.nearest(x, centers)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    assert (at[:50] == ((x[:50, None] - centers) ** 2).sum(axis=2).argmin(axis=1)).all()
    v = frame(spark, rng.standard_normal((900, 16))).coalesce(1)
    model = vectors.fit(v, 8, 8, 64, 2)
    found = vectors.search(v, vectors.encoded(v, model, 50).coalesce(1), model, v, 5, probes=8, rescore=300)  # one task meets 810,000 pairs
    exact = retrieve.knn(v, v, 5).select("query_id", "doc_id", "score", "rank")
    assert found.count() == 4500 and recall(found, exact) >= 0.999


def test_odd_vectors(spark):
    rows = [(i, [float(i % 5 + 1), 1.0, float(i % 3), 2.0]) for i in range(40)] + [(50, None), (51, [0.0] * 4), (52, [float("nan")] * 4), (53, [float("inf"), 1.0, 1.0, 1.0]), (None, [1.0] * 4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    model = vectors.fit(v, parts=2, codes=8)
    found = vectors.search(v, vectors.encoded(v, model), model, v, 3).collect()
    assert {r["query_id"] for r in found} == set(range(40)) and all(r["doc_id"] < 50 and r["rank"] <= 3 for r in found)
    with pytest.raises(ValueError):
        vectors.fit(v.limit(0))
    with pytest.raises(ValueError):
        vectors.fit(v, parts=3)


def test_lsh_hands_on_pairs_not_buckets(spark):
    """Every pair within the distance that shares a bucket, once, though a bucket has most of the vectors; the plan joins blocks, not vectors."""
    from evidora.operators import ingest

    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[200:] = x[:200] + 0.05 * rng.standard_normal((200, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = frame(spark, x).unionByName(spark.createDataFrame([(900, None), (901, [float("nan")] * 16), (None, [1.0] + [0.0] * 15)], "vec_id long, embedding array<float>"))
    q = v.where("vec_id % 20 = 0")
    got = [(r["query_id"], r["doc_id"]) for r in ingest.knn_lsh(v, q, 0.8, block=32, slices=3).collect()]
    near = {(a, b) for a in range(0, 400, 20) for b in range(400) if a != b and np.linalg.norm(x[a] - x[b]) < 0.8}
    assert len(got) == len(set(got)) and set(got) <= near and len(got) >= 0.9 * len(near) > 0
    plan = ingest.knn_lsh(v, q, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "hashValue" not in plan  # no row for each table that a pair of vectors shares


def test_exact_search_with_ties_and_small_blocks(spark):
    """The best k of a block are picked without a full sort; ties at the k-th place go by id, whatever the order of rows."""
    rng = np.random.default_rng(9)
    x = rng.integers(-1, 2, (90, 3)).astype(float)  # many equal cosines, some zero vectors
    v = frame(spark, x).orderBy(F.xxhash64("vec_id"))
    got = sorted((r["query_id"], r["doc_id"], r["score"], r["rank"]) for r in retrieve.knn(v, v.where("vec_id < 20"), 7, block=16).collect())
    n = np.linalg.norm(x, axis=1)
    with np.errstate(all="ignore"):
        s = np.round(x @ x.T / (n[:, None] * n), 6)
    order = {q: sorted((d for d in range(90) if d != q and not np.isnan(s[q, d])), key=lambda d: (-s[q, d], d))[:7] for q in range(20)}
    assert got == sorted((q, d, s[q, d], i + 1) for q in order for i, d in enumerate(order[q]))
    at, place = retrieve._best(np.array([[0.5, 0.9, 0.5, -2.0]]), np.array([7, 1, 3, 0]), 2)
    assert at.tolist() == [0, 0] and place.tolist() == [1, 2]
