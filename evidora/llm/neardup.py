"""MinHash near-dedup of documents by BagMinHash over five-word shingles."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.llm.bagminhash import signatures
from evidora.llm.common import cut, free
from evidora.llm.graph import components
from evidora.llm.hashing import U, buffers, many_words, mix, runs
from evidora.llm.pairs import band_hashes, linked, overlapping, similar_signatures

WIDTH, ROWS = 64, 4
#: Of WIDTH values, so many must agree before a pair is verified: at similarity 0.8, five standard deviations below the mean.
AGREE = 35
SIGNED = "k long, bands array<long>, sig binary"
#: Into so many parts a text's rows are dealt where they are named.
SALTS = 16


def shingled(texts: Iterable[np.ndarray], n: int = 5) -> Iterator[np.ndarray]:
    """The hashes of the n-word shingles of each text's bytes, in order."""
    for h, bounds in many_words(texts):
        all_ = runs(h, n)
        for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield all_[start : max(start, end - n + 1)]


def multisets(texts: list[str]) -> list[np.ndarray]:
    """The shingles of each text as a set: the i-th time that one comes is an element of its own, so
    that the Jaccard similarity of two sets is sum(min) / sum(max) of their multisets."""
    out = []
    for found in shingled(np.frombuffer(t.encode(), np.uint8) for t in texts):
        found = np.sort(found)
        again = np.flatnonzero(found[1:] == found[:-1]) + 1
        if len(again):
            heads = np.flatnonzero(np.concatenate([[True], found[1:] != found[:-1]]))
            which = np.arange(len(found)) - np.repeat(heads, np.diff(np.append(heads, len(found))))
            with np.errstate(over="ignore"):
                found[again] = mix(found[again] + which[again].astype(U) * U(0x9E3779B97F4A7C15))
            found.sort()
        out.append(found)
    return out


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list = []
    parts: list = []
    held = 0

    def flush():
        doc = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
        sig = signatures(doc, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), len(parts), WIDTH)
        bands = band_hashes(sig, ROWS)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(bands) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel().view(np.int64)))
        short = [r.tobytes() for r in (sig >> U(20)).astype("<u2")]
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists, pa.array(short, pa.binary())], names=["k", "bands", "sig"])

    for batch in batches:
        for key, found in zip(batch.column(0).to_pylist(), shingled(buffers(batch.column(1)))):
            if len(found):
                keys.append(key)
                parts.append(np.unique(found, return_counts=True))
                held += len(found)
                if held > 300_000:
                    yield flush()
                    keys, parts, held = [], [], 0
    if keys:
        yield flush()


def near_classes(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, digest (of the text), class_id (the smallest id with the same text), component_id (the
    smallest id that chains of near-duplicates lead to) and kept (whether the row is the one
    that stays of its component), for every row.

    Two documents are near-duplicates if the weighted Jaccard similarity of their multisets of
    five-word shingles is at least `least`. Equal texts are one class and are compared once. Of 16
    bands of 4 values, a pair at 0.8 shares one with a chance of 0.9998; candidates are verified
    exactly (see pairs). Words are runs of anything but space and U+0009..U+000D.

    Null text counts as empty; documents of under five words are duplicates only of equal texts.
    Rows without an id come last among equals. Of rows equal in id and text, each is returned and one is kept. An empty table gives no rows; other
    columns are ignored."""
    out, no_id = _classes(docs, least, id_col, text_col)
    out = out.withColumn("copy", F.explode(F.expr("sequence(1L, rows)")))
    kept = (F.col("id") == F.col("component_id")) & (F.col("copy") == 1)
    return out.select(F.nullif("id", no_id).alias("doc_id"), "digest", F.nullif("rep", no_id).alias("class_id"), F.nullif("component_id", no_id).alias("component_id"), kept.alias("kept"))


def _classes(docs: DataFrame, least: float, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    """id, digest, rep, component_id and rows (how many are equal in id and text), and what stands for no id."""
    no_id = F.lit(2**63 - 1).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.md5(F.col("text").cast("binary")))
    # a class is named by 64 bits of its text's digest: ids may repeat
    key = F.conv(F.substring("digest", 1, 16), 16, -10).cast("long").alias("k")
    classes = cut(rows.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).select("*", key), "classes")
    signed = cut(rows.select(key, "text").mapInArrow(_sign, SIGNED), "signed")
    banded = signed.select("k", F.explode("bands").alias("band"))
    shared = banded.groupBy("band").agg(F.min("k").alias("a"), F.max("k").alias("b")).where("a < b").select("band")
    members = cut(banded.join(shared, "band").distinct(), "members")
    once = signed.join(members.select("k").distinct(), "k").groupBy("k").agg(F.first("sig").alias("sig"))
    groups = components(linked(members.join(once, "k").withColumnRenamed("k", "id"), "band", similar_signatures(WIDTH, AGREE)))
    groups = cut(groups.select("node", "root").unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "groups")
    first = classes.join(groups, F.col("k") == F.col("node")).select("digest", "k", F.col("rep").alias("id"), "root")
    texts = rows.join(first, ["digest", "id"]).dropDuplicates(["k"]).select("root", F.col("k").alias("id"), "text")
    roots = components(linked(cut(texts, "texts"), "root", overlapping(multisets, least), F.octet_length("text")))
    # a component is named by its smallest document, not its smallest hash
    named = classes.join(roots, F.col("k") == F.col("node"), "left").select("digest", "rep", "copies", F.coalesce("root", "k").alias("comp"))
    named = cut(named, "named")
    least_id = cut(named.groupBy("comp").agg(F.min("rep").alias("component_id")), "least_id")
    # a text that stands alone needs no name; the others' names are salted, for one may have very many rows
    named = named.join(least_id, "comp").where("copies > 1 or component_id < rep").select("digest", "rep", "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = rows.select("id", "digest", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int").alias("salt")).groupBy("id", "digest", "salt").agg(F.count("*").alias("rows"))
    out = out.join(named, ["digest", "salt"], "left")
    return out.select("id", "digest", F.coalesce("rep", "id").alias("rep"), F.coalesce("component_id", "id").alias("component_id"), "rows"), no_id


def keep_one(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_classes() keeps, with the columns of docs: one row per component.

    Kept ids are unique but for rows that repeat an id: of those, the rows with the texts of kept classes stay."""
    i_, digest_, rows_ = free(docs, "_id", "_digest", "_rows")
    out, no_id = _classes(docs, least, id_col, text_col)
    kept = out.where("id = component_id").select(F.col("id").alias(i_), F.col("digest").alias(digest_), F.col("rows").alias(rows_))
    kept = cut(kept, "kept")
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    out = docs.join(kept, (F.coalesce(F.col(id_col).cast("long"), no_id) == F.col(i_)) & (digest == F.col(digest_)))
    if kept.where(F.col(rows_) > 1).limit(1).count():  # rows equal in id and text: one stays
        out = out.dropDuplicates([id_col, text_col])
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    out = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "class_id", "component_id", "kept")


#: All pairs that share a shingle, and the closure of their links.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
c AS (SELECT doc_id, md5(array_to_string(ws[i : i + 4], ' ')) AS s, count(*) AS n FROM i GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS t FROM c GROUP BY doc_id),
k AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS class_id FROM w),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS o FROM c a JOIN c b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN t tx ON tx.doc_id = x JOIN t ty ON ty.doc_id = y WHERE o >= 0.8 * (tx.t + ty.t - o) UNION SELECT class_id, doc_id FROM k WHERE class_id < doc_id),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(d, m) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.d),
q AS (SELECT d AS doc_id, min(m) AS component_id FROM r GROUP BY d)
SELECT doc_id, class_id, component_id, doc_id = component_id AS kept FROM k JOIN q USING (doc_id)
"""
