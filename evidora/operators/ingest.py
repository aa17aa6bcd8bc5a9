"""Parsing, chunking, sampling and embedding of documents."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.functions.text import strip_markup, words

_PARTS = r"(?s)(<(?:p|h1|h2|h3|li|td|pre)(?: [^>]*)?>[^<]*)"


def page_titles(pages: DataFrame) -> DataFrame:
    title = F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1)
    return pages.select("page_id", title.alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.length("html").cast("long").alias("n_chars"))


def strip_pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", strip_markup(F.col("html")).alias("body"))


def sections(pages: DataFrame) -> DataFrame:
    """One row per block element, with its label and position; the page id stays with it."""
    parts = F.regexp_extract_all(F.col("html"), F.lit(_PARTS), F.lit(1))
    out = pages.select("page_id", F.posexplode(parts).alias("pos", "part"))
    label = F.regexp_extract("part", "<(p|h1|h2|h3|li|td|pre)", 1)
    return out.select("page_id", F.col("pos").cast("long").alias("pos"), label.alias("label"), F.trim(F.regexp_replace("part", "(?s)<[^>]*>", "")).alias("body"))


def articles(spark, path: str, row_tag: str = "article", schema: str = "article_id string, title string, sec array<struct<label:string,p:string>>") -> DataFrame:
    """Article XML with an explicit schema (no inference pass), read by Spark's XML source."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def chunks(docs: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """doc_id, chunk_no, text, n_tokens: windows of `size` words that overlap by `overlap`; at least one a document."""
    stride = size - overlap
    n = F.greatest(F.lit(1).cast("long"), F.ceil((F.size("ws") - overlap) / F.lit(float(stride))))
    out = docs.select("doc_id", words(F.coalesce("text", F.lit(""))).alias("ws")).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    part = F.slice("ws", (F.col("chunk_no") * stride + 1).cast("int"), F.lit(size))
    return out.select("doc_id", "chunk_no", F.array_join(part, " ").alias("text"), F.size(part).cast("long").alias("n_tokens"))


def chunk_stats(ch: DataFrame) -> DataFrame:
    out = ch.agg(F.count("*").alias("n_chunks"), F.countDistinct("doc_id").alias("n_docs"), F.round(F.avg("n_tokens"), 6).alias("avg_tokens"), F.max("n_tokens").alias("max_tokens"))
    return out.withColumn("chunks_per_doc", F.round(F.col("n_chunks") / F.col("n_docs"), 6))


def audit(docs: DataFrame) -> DataFrame:
    n = F.length("text").cast("long")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.countDistinct("text").alias("n_texts"), F.count(F.when(F.col("text").isNull() | (F.col("text") == ""), 1)).alias("n_empty"), F.count(F.when(n != F.col("n_chars"), 1)).alias("n_wrong_length"), F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"))


def rates(docs: DataFrame, base: int = 433) -> DataFrame:
    """Sampling rates in ten-thousandths by stratum (lang, source): 4.33 % of English, twice that of the others."""
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n")).withColumn("rate", F.when(F.col("lang") == "en", base).otherwise(2 * base))


def stratified(docs: DataFrame, by: DataFrame) -> DataFrame:
    """A sample that depends on ids alone: a document's bucket is part of its id's MD5, and its stratum's rate says how many
    of the 10,000 buckets are in."""
    bucket = (F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10000).alias("bucket")
    return docs.select("doc_id", "lang", "source", bucket).join(by.select("lang", "source", "rate"), ["lang", "source"]).where("bucket < rate").select("doc_id", "lang", "source", "bucket")


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


class Encoder(Protocol):
    """Turns texts into unit vectors; real models plug in here."""

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEncoder:
    """Feature hashing of words with signs, scaled to unit length: the stand-in where there is no model."""

    def __init__(self, dims: int):
        self.dims = dims

    def encode(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dims] += 1 if h & 0x80000000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(docs: DataFrame, encoder: Encoder, id_col: str = "doc_id") -> DataFrame:
    """id, embedding: Arrow batches through an encoder."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": list(encoder.encode(pdf["text"].fillna("").tolist()).astype(np.float32))})

    return docs.select(id_col, "text").mapInPandas(run, f"{id_col} long, embedding array<float>")


def knn_lsh(vectors: DataFrame, queries: DataFrame, distance: float = 1.2, tables: int = 12, width: float = 1.0, block: int = 1024, slices: int = 8) -> DataFrame:
    """Pairs within a Euclidean distance that share a bucket of random projections (unit vectors: distance is cosine).

    Vectors and queries of a bucket go in blocks, which meet by an equi-join of table and bucket (a bucket's blocks lie in so many slices): one matrix product a pair of blocks. A pair
    is handed on in the first table whose bucket it shares, so no shuffle looks for repeats. A bucket with half of the vectors costs products, not rows."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))  # noqa: E731  others are within no distance

    def of(df: DataFrame) -> DataFrame:
        x = F.transform("embedding", lambda x: x.cast("double"))
        rows = df.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(F.forall("x", finite)).distinct()
        return rows.withColumn("v", array_to_vector("x"))

    all_, some = of(vectors), of(queries)
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=width, numHashTables=tables, seed=7).fit(all_)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, float], list] = {}
        size = 0

        def blocks() -> Iterator[pa.RecordBatch]:
            for t, bucket in list(held):
                ids, x, h = (np.concatenate(c) for c in zip(*held.pop((t, bucket))))
                for i in range(0, len(ids), block):
                    part = slice(i, i + block)
                    row = [pa.array([t], pa.int32()), pa.array([bucket]), pa.array([ids[part].tolist()], pa.list_(pa.int64())), pa.array([x[part].tobytes()], pa.binary()), pa.array([h[part].tobytes()], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, names=["t", "bucket", "ids", "x", "h"])

        for batch in batches:
            ids, x, h = batch.column(0).to_numpy(), *(batch.column(c).flatten().to_numpy().reshape(batch.num_rows, -1) for c in (1, 2))
            for t in range(tables):
                order = np.argsort(h[:, t], kind="stable")
                for at in np.split(order, np.flatnonzero(np.diff(h[order, t])) + 1):
                    held.setdefault((t, float(h[at[0], t])), []).append((ids[at], x[at], h[at]))
            size += len(ids) * tables
            if size > 1 << 16:
                yield from blocks()
                size = 0
        yield from blocks()

    def packed(df: DataFrame) -> DataFrame:
        buckets = F.array(*[vector_to_array(F.col("h")[i])[0] for i in range(tables)])
        rows = model.transform(df).select(F.col("vec_id").cast("long"), "x", buckets.alias("h")).where("size(x) > 0")
        return rows.mapInArrow(pack, "t int, bucket double, ids array<long>, x binary, h binary")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t, ids, x, h, q_ids, q_x, q_h in zip(*(batch.column(i) for i in range(7))):
                ids, q_ids = ids.values.to_numpy(), q_ids.values.to_numpy()
                x, h = (np.frombuffer(r.as_buffer()).reshape(len(ids), -1) for r in (x, h))
                q_x, q_h = (np.frombuffer(r.as_buffer()).reshape(len(q_ids), -1) for r in (q_x, q_h))
                square = (q_x**2).sum(axis=1)[:, None] + (x**2).sum(axis=1) - 2 * (q_x @ x.T)
                at, to = np.nonzero(square < distance**2 + 1e-9 * (1 + np.abs(square)))
                for i in range(0, len(at), 1 << 14):
                    a, b = at[i : i + (1 << 14)], to[i : i + (1 << 14)]
                    first = np.argmax(q_h[a] == h[b], axis=1) == t.as_py()  # the table's own bucket is shared, so there is one
                    a, b = a[first], b[first]
                    dist = np.sqrt(((q_x[a] - x[b]) ** 2).sum(axis=1))
                    fine = (dist < distance) & (q_ids[a] != ids[b])
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[a[fine]]), pa.array(ids[b[fine]]), pa.array(dist[fine])], names=["query_id", "doc_id", "dist"])

    dealt = packed(all_).withColumn("slice", F.pmod(F.xxhash64("ids"), F.lit(slices)).cast("int"))
    asked = packed(some).select("t", "bucket", F.col("ids").alias("q_ids"), F.col("x").alias("q_x"), F.col("h").alias("q_h"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"))
    pairs = dealt.join(asked, ["t", "bucket", "slice"]).select("t", "ids", "x", "h", "q_ids", "q_x", "q_h")
    return pairs.mapInArrow(near, "query_id long, doc_id long, dist double").select("query_id", "doc_id", F.round("dist", 6).alias("dist"))
