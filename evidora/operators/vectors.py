"""Approximate vector search: an inverted file of coarse centroids, residuals in product codes, exact rescoring.

Centroids and codebooks are the model, of bounded size; Lloyd rounds run over all vectors, each task hands on sums, and only those come to the driver."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evidora.operators.links import cut
from evidora.operators.retrieve import knn as exact_knn
from evidora.operators.retrieve import ranked

#: Coarse lists at most: with 1,024 dimensions the centroids are 64 MB.
MOST_LISTS = 8192
#: Distances that a task holds at once, and new candidates that it takes before it drops what can't be among the best any more.
DISTANCES, CANDIDATES = 1 << 20, 1 << 18


@dataclass
class Model:
    """centroids: lists x dims; codebooks: parts x codes x dims / parts, of what is left after the nearest centroid."""

    centroids: np.ndarray
    codebooks: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        return nearest(x, self.centroids)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        left = (x - self.centroids[lists]).reshape(len(x), len(self.codebooks), -1)
        return np.stack([nearest(left[:, j], book) for j, book in enumerate(self.codebooks)], axis=1).astype(np.uint8)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """The nearest center of each row (ties: the first), in blocks."""
    half = (centers**2).sum(axis=1) / 2
    at = np.empty(len(x), int)
    for i in _blocks(len(x), len(centers)):
        at[i] = np.argmax(x[i] @ centers.T - half, axis=1)
    return at


def _blocks(n: int, width: int) -> list[slice]:
    """0..n in blocks, of which each has DISTANCES numbers at most, `width` for a row."""
    size = max(1, min(4096, DISTANCES // max(1, width)))
    return [slice(i, i + size) for i in range(0, n, size)]


def unit(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, x: finite vectors other than zero, scaled to length 1, in double precision; others can't be near anything and are left out."""
    v = F.col(vector_col).cast("array<double>")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null").withColumn("norm", norm)
    return rows.where("norm > 0 and norm < double('infinity')").select("id", F.transform("v", lambda x: x / F.col("norm")).alias("x"))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lloyd(rows: DataFrame, centers: np.ndarray, rounds: int, left_after: np.ndarray | None = None) -> np.ndarray:
    """Lloyd rounds over rows (id, x) for parts x k x dims centers at once, of x or of what the nearest of left_after leaves of it. Each task gives counts and sums of its rows
    for each center, which are added up in Spark; parts x k x dims numbers come back. A center that nothing is nearest to stays."""
    for _ in range(rounds):
        def sums(batches: Iterator[pa.RecordBatch], now: np.ndarray = centers) -> Iterator[pa.RecordBatch]:
            n, s = np.zeros(now.shape[:2]), np.zeros(now.shape)
            for batch in batches:
                x = _matrix(batch.column(1))
                if left_after is not None:
                    x = x - left_after[nearest(x, left_after)]
                x = x.reshape(len(x), len(now), -1)
                for j in range(len(now)):
                    at = nearest(x[:, j], now[j])
                    n[j] += np.bincount(at, minlength=now.shape[1])
                    np.add.at(s[j], at, x[:, j])
            part, code = np.nonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(code), pa.array(n[part, code]), pa.array(list(s[part, code]), pa.list_(pa.float64()))], names=["part", "code", "n", "s"])

        each = rows.mapInArrow(sums, "part long, code long, n double, s array<double>").select("part", "code", "n", F.posexplode("s").alias("i", "v"))
        total = each.groupBy("part", "code", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).toPandas()  # the model's size
        centers = centers.copy()
        centers[total["part"], total["code"], total["i"]] = total["v"] / total["n"]
    return centers


def fit(vectors: DataFrame, lists: int | None = None, parts: int = 8, codes: int = 256, rounds: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> Model:
    """Centroids and codebooks. lists: by default the root of the number of vectors, MOST_LISTS at most. They start from the vectors whose ids hash least, and see all vectors in
    each round. Vectors have one length, a multiple of `parts`."""
    rows = unit(vectors, id_col, vector_col)
    n = rows.count()
    if not n:
        raise ValueError("no vectors to fit")
    lists = min(lists or isqrt(n) + 1, n, MOST_LISTS)
    take = max(lists, codes)
    first = rows.orderBy(F.xxhash64("id"), "id").limit(take).collect()  # centroids to start with
    x = np.array([r["x"] for r in first])
    if x.shape[1] % parts:
        raise ValueError(f"{x.shape[1]} dimensions can't be cut into {parts} parts")
    centroids = _lloyd(rows, x[None, :lists], rounds)[0]
    left = (x - centroids[nearest(x, centroids)]).reshape(len(x), parts, -1)[:codes].transpose(1, 0, 2)
    return Model(centroids, _lloyd(rows, np.ascontiguousarray(left), rounds, centroids))


def encoded(vectors: DataFrame, model: Model, block: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """list, ids, codes: every vector in the list of its nearest centroid, in blocks of up to `block` of them, a byte for each part. The hot list is many blocks."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def of(all_: bool) -> Iterator[pa.RecordBatch]:
            """Whole blocks, and with all_ the rest, too: what isn't given stays held."""
            at, ids, codes = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(at, kind="stable")
            rest = []
            for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                for i in range(0, len(some), block):
                    r = some[i : i + block]
                    if len(r) < block and not all_:
                        rest.append(r)
                        continue
                    yield pa.RecordBatch.from_arrays([pa.array([at[r[0]]], pa.int32()), pa.array([ids[r]], pa.list_(pa.int64())), pa.array([codes[r].tobytes()], pa.binary())], names=["list", "ids", "codes"])
            r = np.concatenate(rest) if rest else order[:0]
            held[:] = [(at[r], ids[r], codes[r])]

        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                some = batch.slice(i, 4096)
                x = _matrix(some.column(1))
                at = shared.value.assign(x)
                held.append((at, some.column(0).to_numpy(), shared.value.encode(x, at)))
                size += len(at)
                if size > max(CANDIDATES, 16 * len(shared.value.centroids)):
                    yield from of(False)
                    size = len(held[0][0])
                    if size > CANDIDATES:  # many lists, each with part of a block
                        yield from of(True)
                        held, size = [], 0
        if size:
            yield from of(True)

    return unit(vectors, id_col, vector_col).mapInArrow(run, "list int, ids array<long>, codes binary")


def probes_for(vectors: DataFrame, model: Model, queries: DataFrame, k: int = 10, target: float = 0.97, most: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> int:
    """How many lists a query has to probe: the fewest that hold `target` of the true neighbours of a sample of `most` queries (those whose ids hash least), found by exact
    search. Vectors that form groups need few lists, spread out ones many: that is measured here, not assumed."""
    sample = queries.where(F.col(id_col).isNotNull()).orderBy(F.xxhash64(id_col), id_col).limit(most)
    near = exact_knn(vectors, sample, k, id_col, vector_col).select("query_id", "doc_id")
    x = unit(vectors, id_col, vector_col)
    pairs = near.join(x.withColumnRenamed("id", "doc_id"), "doc_id").join(unit(sample, id_col, vector_col).select(F.col("id").alias("query_id"), F.col("x").alias("q")), "query_id").select("x", "q").collect()  # most x k rows
    if not pairs:
        return len(model.centroids)
    doc, query = (np.array([r[c] for r in pairs]) for c in ("x", "q"))
    far = (model.centroids**2).sum(axis=1) / 2 - query @ model.centroids.T
    own = far[np.arange(len(far)), model.assign(doc)]
    return int(np.quantile((far < own[:, None]).sum(axis=1) + 1, target, method="higher"))


def search(vectors: DataFrame, codes: DataFrame, model: Model, queries: DataFrame, k: int = 10, probes: int = 8, rescore: int = 200, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, doc_id, score, rank: the k vectors of largest cosine found for each query, without itself.

    A query probes its `probes` nearest lists (see probes_for). Queries of a list go in blocks, and meet its blocks of codes: an equi-join, which Spark splits where a list is
    hot. A block's codes are turned back into approximate vectors, so that a pair of blocks is one matrix product; a task hands on the best `rescore` of each of its queries,
    and the best of these over all tasks are scored exactly from their vectors."""
    shared = vectors.sparkSession.sparkContext.broadcast(model)
    probes = min(probes, len(model.centroids))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(i, 1024) for batch in batches for i in range(0, batch.num_rows, 1024)):
            x, ids = _matrix(part.column(1)), part.column(0).to_numpy()
            c = shared.value.centroids
            half = (c**2).sum(axis=1) / 2
            best = np.concatenate([np.argsort(half - x[i] @ c.T, axis=1, kind="stable")[:, :probes].astype(np.int32) for i in _blocks(len(x), len(c))])
            row, at = np.repeat(np.arange(len(x)), best.shape[1]), best.ravel()
            order = np.argsort(at, kind="stable")
            for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                for i in range(0, len(some), 256):
                    r = row[some[i : i + 256]]
                    yield pa.RecordBatch.from_arrays([pa.array([at[some[0]]], pa.int32()), pa.array([ids[r].tolist()], pa.list_(pa.int64())), pa.array([x[r].tobytes()], pa.binary())], names=["list", "asked", "x"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, size, kept = shared.value, [], 0, 0
        known, limit = np.empty(0, np.int64), np.empty(0)  # of queries that have `rescore` candidates, the last one's value: less is of no use

        def least(q: np.ndarray) -> np.ndarray:
            at = np.searchsorted(known, q)
            at[at == len(known)] = 0
            return np.where(known[at] == q, limit[at], -np.inf) if len(known) else np.full(len(q), -np.inf)

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            q, d, s = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((d, -s, q))
            q, d, s = q[order], d[order], s[order]
            starts = np.flatnonzero(np.concatenate([[True], q[1:] != q[:-1]]))
            keep = np.arange(len(q)) - np.repeat(starts, np.diff(np.append(starts, len(q)))) < rescore
            return q[keep], d[keep], s[keep]

        def out(q: np.ndarray, d: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(d), pa.array(s)], names=["query_id", "doc_id", "near"])

        for batch in batches:
            for a, q, raw, ids, codes in zip(*(batch.column(i) for i in range(5))):
                q, ids = q.values.to_numpy(), ids.values.to_numpy()
                x = np.frombuffer(raw.as_buffer()).reshape(len(q), -1)
                code = np.frombuffer(codes.as_buffer(), np.uint8).reshape(len(ids), -1)
                near = m.codebooks[np.arange(code.shape[1]), code].reshape(len(ids), -1) + m.centroids[a.as_py()]
                s = x @ near.T
                s[q[:, None] == ids[None, :]] = -np.inf
                top = np.argpartition(-s, rescore - 1, axis=1)[:, :rescore] if len(ids) > rescore else np.broadcast_to(np.arange(len(ids)), s.shape)
                value = np.take_along_axis(s, top, axis=1).ravel()
                fine = (value > -np.inf) & (value >= np.repeat(least(q), top.shape[1]))
                held.append((np.repeat(q, top.shape[1])[fine], ids[top].ravel()[fine], value[fine]))
                size += len(held[-1][0])
                if size > kept + CANDIDATES:
                    held = [best()]
                    of, _, near_ = held[0]
                    size = kept = len(of)
                    full = np.flatnonzero(of[rescore - 1 :] == of[: max(0, len(of) - rescore + 1)])
                    known, limit = of[full], near_[full + rescore - 1]
                    if size > 1 << 20:  # many queries: what is found goes on, to be limited with that of other tasks
                        yield out(*held.pop())
                        size = kept = 0
        if held:
            yield out(*best())

    asked = unit(queries, id_col, vector_col)
    pairs = asked.mapInArrow(probe, "list int, asked array<long>, x binary").join(codes, "list").select("list", "asked", "x", "ids", "codes")
    found = pairs.mapInArrow(score, "query_id long, doc_id long, near double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("near"), "doc_id"))
    best = found.withColumn("place", place).where(F.col("place") <= rescore).select("query_id", "doc_id")
    exact = best.join(unit(vectors, id_col, vector_col).withColumnRenamed("id", "doc_id"), "doc_id").join(asked.select(F.col("id").alias("query_id"), F.col("x").alias("q")), "query_id")
    cosine = F.aggregate(F.zip_with("x", "q", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return ranked(exact.select("query_id", "doc_id", F.round(cosine, 6).alias("score")), k)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, target: float = 0.97, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """fit(), encoded(), probes_for() and search() in one, with the codes written down between."""
    model = fit(vectors, id_col=id_col, vector_col=vector_col)
    codes = cut(encoded(vectors, model, id_col=id_col, vector_col=vector_col), "codes")
    probes = probes_for(vectors, model, queries, k, target, id_col=id_col, vector_col=vector_col)
    return search(vectors, codes, model, queries, k, probes, 20 * k, id_col, vector_col)
