"""Retrieval: inverted index, BM25, exact and approximate vector search, fusion of legs.

Runs are relations (query_id, doc_id, leg, rank, score). Scores are rounded to six digits before
they rank, and ties go by document id, so a run is the same wherever it is computed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidora.functions.text import tokens

def guarded(run: DataFrame, store: DataFrame, what: str) -> DataFrame:
    """run, which fails loudly when it is read and the store that it comes from has no rows: an empty table or index would look like a lack of
    evidence. No job runs before; the check reads one row."""
    n = store.limit(1).agg(F.count("*").alias("n")).where(F.assert_true(F.col("n") > 0, f"{what} is empty").isNotNull())
    return run.unionByName(n.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in run.schema.fields]))


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """term, doc_id, tf."""
    return docs.select(F.col(id_col).alias("doc_id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def distinct_postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What postings() gives, for documents whose ids are distinct: a document's words are in one row, so nothing is shuffled to count them."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                ids, lists = batch.slice(i, 256).columns
                words = lists.flatten().dictionary_encode()
                size = max(1, len(words.dictionary))
                sizes = lists.value_lengths().fill_null(0).to_numpy()
                seen, tf = np.unique(np.repeat(np.arange(len(sizes)), sizes) * size + words.indices.to_numpy(), return_counts=True)
                yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(seen % size)), ids.take(pa.array(seen // size)), pa.array(tf)], names=["term", "doc_id", "tf"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), tokens(F.col(text_col)).alias("t")).mapInArrow(count, "term string, doc_id long, tf long")


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def query_terms(queries: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("term"))


def ranked(scored: DataFrame, k: int | None, *more) -> DataFrame:
    """rank per query by score, then id; the best k only (Spark limits each group before it shuffles)."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), *more, F.asc("doc_id"))
    out = scored.withColumn("rank", F.row_number().over(w).cast("long"))
    return out if k is None else out.where(F.col("rank") <= k)


def inverse_frequencies(docs: DataFrame, queries: DataFrame, text_col: str = "text") -> DataFrame:
    """term (a hash), idf, avgdl: of each term that a query has and a document too, and the documents' mean length. Terms are counted once a
    document within each task before the shuffle."""
    toks = docs.select(_hashed(F.col(text_col)).alias("t"))
    stats = docs.agg(F.count("*").cast("double").alias("n"), F.avg(F.size(_hashed(F.coalesce(F.col(text_col), F.lit(""))))).alias("avgdl"))
    wanted = queries.select(F.explode(_hashed(F.col("text"))).alias("term")).distinct()
    df = toks.select(F.explode(F.array_distinct("t")).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(stats)).select("term", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), "avgdl")  # stats: one row


def _hashed(text: Column) -> Column:
    return F.transform(tokens(text), lambda x: F.xxhash64(x))


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, k1: float = 1.5, b: float = 0.75, id_col: str = "doc_id", text_col: str = "text", block: int = 256) -> DataFrame:
    """query_id, doc_id, score, rank of the best k documents of each query (none: of all that share a term with it).

    Two passes over the texts: one counts document frequencies of the queries' terms, one scores. Blocks of documents
    meet blocks of queries, the stated set, each pair in one product of term weights; a pair of blocks hands on its best k for each query only.
    Terms are compared by 64-bit hashes."""
    idf = inverse_frequencies(docs, queries, text_col)
    terms = queries.select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(_hashed(F.col("text")))).alias("term")).join(idf, "term")
    wanted = terms.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("term", "idf"))).alias("t"), F.first("avgdl").alias("avgdl"))
    # a block of queries: one row, so that it meets a block of documents as a whole
    dealt = wanted.groupBy(F.floor(F.col("query_id") / block).alias("q")).agg(F.sort_array(F.collect_list(F.struct("query_id", "t"))).alias("queries"), F.first("avgdl").alias("avgdl"))
    toks = docs.select(F.col(id_col).cast("long").alias("id"), _hashed(F.col(text_col)).alias("t")).where("id is not null and t is not null")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                some = batch.slice(i, block)
                lists = some.column(1)
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([lists.value_lengths().to_pylist()], pa.list_(pa.int32())), pa.array([lists.flatten().to_numpy().tobytes()], pa.binary())], names=["ids", "sizes", "terms"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                ids, sizes = (row.column(c).flatten().to_numpy() for c in (0, 1))
                flat = np.frombuffer(row.column(2)[0].as_py(), np.int64)
                q = row.column(3).flatten()
                q_ids, lists = q.field(0).to_numpy(), q.field(1)
                owner = np.repeat(np.arange(len(q_ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
                vocabulary, first, place = np.unique(lists.flatten().field(0).to_numpy(), return_index=True, return_inverse=True)
                idf_ = lists.flatten().field(1).to_numpy()[first]
                has = np.zeros((len(q_ids), len(vocabulary)))
                has[owner, place] = 1
                at = np.minimum(np.searchsorted(vocabulary, flat), len(vocabulary) - 1)
                known = np.flatnonzero(vocabulary[at] == flat)
                doc = np.repeat(np.arange(len(ids)), sizes)
                tf = np.bincount(doc[known] * len(vocabulary) + at[known], minlength=len(ids) * len(vocabulary)).reshape(len(ids), -1)
                d, t = np.nonzero(tf)
                n = tf[d, t]
                weight = np.zeros(tf.shape)
                weight[d, t] = idf_[t] * n * (k1 + 1) / (n + k1 * (1 - b + b * sizes[d] / row.column(4)[0].as_py()))
                scores = np.round(has @ weight.T, 6)
                by_id = np.argsort(ids, kind="stable")
                best = by_id[np.argsort(-scores[:, by_id], axis=1, kind="stable")[:, :k]]
                value = np.take_along_axis(scores, best, axis=1)
                some, place = np.nonzero(value > 0)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[some]), pa.array(ids[best[some, place]]), pa.array(value[some, place])], names=["query_id", "doc_id", "score"])

    pairs = toks.mapInArrow(pack, "ids array<long>, sizes array<int>, terms binary").crossJoin(dealt.select("queries", "avgdl"))
    return ranked(pairs.mapInArrow(score, "query_id long, doc_id long, score double"), k)


def _packed(df: DataFrame, id_col: str, vector_col: str, block: int) -> DataFrame:
    """Rows of up to `block` vectors: ids and their matrix, as doubles."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, block):
                some = batch.slice(i, block)
                if len(some.column(1).value_lengths().unique()) > 1:
                    raise ValueError("vectors of several lengths")
                m = some.column(1).flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([some.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([m.tobytes()], pa.binary())], names=["ids", "matrix"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null and v is not null and size(v) > 0")
    return rows.select("id", F.transform("v", lambda x: F.coalesce(x, F.lit(float("nan")))).alias("v")).mapInArrow(pack, "ids array<long>, matrix binary")


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and place of the k largest values above -2 of each row, ties at the k-th by id."""
    if s.shape[1] > k:
        at, place = np.nonzero((s >= np.partition(s, s.shape[1] - k, axis=1)[:, -k, None]) & (s > -2))
    else:
        at, place = np.nonzero(s > -2)
    order = np.lexsort((ids[place], -s[at, place], at))
    at, place = at[order], place[order]
    first = np.searchsorted(at, at)
    keep = np.arange(len(at)) - first < k
    return at[keep], place[keep]


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 1024) -> DataFrame:
    """query_id, doc_id, score, rank: the k nearest vectors by cosine, exactly, without the query itself.

    Both sides are packed into blocks, and every pair of blocks is one matrix product; a pair
    hands on its best k for each query only. Memory is that of two blocks and of one Arrow batch (spark.sql.execution.arrow.maxBytesPerBatch), which isn't copied."""
    q = _packed(queries, id_col, vector_col, block).select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
    pairs = _packed(vectors, id_col, vector_col, block).crossJoin(q)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, m, q_ids, qm in zip(*(batch.column(i) for i in range(4))):
                ids, q_ids = ids.values.to_numpy(zero_copy_only=False), q_ids.values.to_numpy(zero_copy_only=False)
                a, b = np.frombuffer(m.as_buffer()).reshape(len(ids), -1), np.frombuffer(qm.as_buffer()).reshape(len(q_ids), -1)
                with np.errstate(all="ignore"):
                    s = (b @ a.T) / (np.linalg.norm(b, axis=1)[:, None] * np.linalg.norm(a, axis=1)[None, :])
                s = np.round(s, 6)
                s[(q_ids[:, None] == ids[None, :]) | np.isnan(s)] = -2
                at, place = _best(s, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[place]), pa.array(s[at, place])], names=["query_id", "doc_id", "score"])

    return ranked(pairs.select("ids", "matrix", "q_ids", "q_matrix").mapInArrow(nearest, "query_id long, doc_id long, score double"), k)


def union_legs(**legs: DataFrame) -> DataFrame:
    """One relation (query_id, doc_id, leg, rank, score) of several legs, which should be guarded().

    The legs are dealt out anew: Spark 4.1 takes a union of parts that are each partitioned by query for partitioned by query itself, and
    in plans that use it twice pairs partitions that don't belong together, with wrong rows or an error."""
    parts = [df.select("query_id", "doc_id", F.lit(name).alias("leg"), "rank", "score") for name, df in legs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.repartition("query_id", "doc_id")


def fuse_rrf(legs: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion."""
    return ranked(legs.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 6).alias("score")), None)


def fuse_weighted(legs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scores are scaled to 0..1 within each query and leg (a constant leg: 1), then summed by weight; a leg that
    misses a document gives 0."""
    w = Window.partitionBy("query_id", "leg")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = legs.withColumn("s", F.when(high == low, 1.0).otherwise((F.col("score") - low) / (high - low)))
    weight = F.coalesce(*[F.when(F.col("leg") == name, F.lit(float(x))) for name, x in weights.items()], F.lit(0.0))
    return ranked(scaled.groupBy("query_id", "doc_id").agg(F.round(F.sum(weight * F.col("s")), 6).alias("score")), None)


def fuse_simple(legs: DataFrame, order: tuple[str, ...] = ("vector", "bm25", "landmark")) -> DataFrame:
    """The best rank that any leg gives; ties go by the legs' order, then id."""
    place = F.coalesce(*[F.when(F.col("leg") == name, F.lit(i)) for i, name in enumerate(order)], F.lit(len(order)))
    best = legs.groupBy("query_id", "doc_id").agg(F.min(F.struct(F.col("rank").alias("r"), place.alias("p"))).alias("best"))
    w = Window.partitionBy("query_id").orderBy("best.r", "best.p", "doc_id")
    name = F.element_at(F.array(*[F.lit(x) for x in order], F.lit("other")), (F.col("best.p") + 1).cast("int"))
    return best.select("query_id", "doc_id", F.col("best.r").alias("best_rank"), name.alias("leg"), F.row_number().over(w).cast("long").alias("rank"))
