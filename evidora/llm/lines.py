"""Line dedup: fuzzy lines by MinHash over character shingles, one line kept per component."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import built, cut, free, scratch
from evidora.llm.graph import components
from evidora.llm.hashing import U, mix, string_hashes
from evidora.llm.pairs import linked, overlapping, shared_bands, similar_signatures

SHINGLE, WIDTH, ROWS, AGREE = 8, 64, 4, 35
#: Code points hashed at once.
CHUNK = 500_000
_EMPTY = np.iinfo(U).max
#: Code points of white space, up to U+3000; a larger one counts as the last of the table, which is none.
_BLANK = np.array([chr(i).isspace() for i in range(0x3001)] + [False])


def _shingles(points: np.ndarray) -> np.ndarray:
    """A hash of the SHINGLE code points from each place on (the last places: none): their polynomial, made by doubling."""
    if len(points) < SHINGLE:
        return np.empty(0, U)
    h, size, power = points, 1, 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        while size < SHINGLE:
            h = h[:-size] * U(power) + h[size:]
            size, power = 2 * size, power * power % 2**64
        return mix(h)


def all_shingles(found: list[str]) -> list[np.ndarray]:
    """Of each line, the hashes of its distinct shingles, sorted."""
    h = _shingles(np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4").astype(U))
    ends = np.cumsum([len(t) for t in found])
    out = []
    for start, end in zip((ends - [len(t) for t in found]).tolist(), ends.tolist()):
        x = np.sort(h[start : max(start, end - SHINGLE + 1)])
        out.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x)
    return out


def line_signatures(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One-permutation MinHash of each line points[start:end]: the shingles fall into WIDTH bins, a
    value is its bin's smallest hash. Empty bins take the value of the first full one in an
    order of their own, the same for all lines (densification). Lines shorter than a shingle: all 0."""
    n = len(starts)
    least = np.full(n * WIDTH, _EMPTY, U)
    counts = np.maximum(ends - starts - SHINGLE + 1, 0)
    h = _shingles(points)
    line = np.repeat(np.arange(n), counts)
    at = np.arange(len(line)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    h = h[at] if len(at) else h[:0]
    np.minimum.at(least, line * WIDTH + (h >> U(58)).astype(np.int64), h)
    least = least.reshape(n, WIDTH)
    some = counts > 0
    row, column = np.nonzero((least == _EMPTY) & some[:, None])
    bins = np.arange(WIDTH, dtype=U)
    with np.errstate(over="ignore"):
        first, step = mix(bins + U(1)), mix(bins + U(1001)) | U(1)
    out, t = least.copy(), 0
    while len(row):
        probe = ((first[column] + U(t) * step[column]) % U(WIDTH)).astype(np.int64)
        value = least[row, probe]
        hit = value != _EMPTY
        with np.errstate(over="ignore"):
            out[row[hit], column[hit]] = mix(value[hit] + U(t + 1))
        row, column, t = row[~hit], column[~hit], t + 1
    out[~some] = 0
    return out


SIGNED = "id long, tag long, line int, k long, proof int, sig array<long>"


def _sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each line that isn't blank, named by a 64-bit hash, with 31 bits of another to prove it; its signature only the first time that the line comes in this task. A
    signature's values are kept to 16 bits, ROWS of them to a long: each long is a band."""
    seen: set[int] = set()

    def of(ids: list, tags: list, texts: list[str]) -> pa.RecordBatch:
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
        breaks = np.flatnonzero(points == 10)
        starts, ends = np.append(0, breaks + 1), np.append(breaks, len(points))
        per_doc = np.array([t.count("\n") + 1 for t in texts])
        found = [line for t in texts for line in t.split("\n")]
        keys = string_hashes(found).view(np.int64)
        proofs = (string_hashes(found, "evidora-2nd-key.") >> U(33)).astype(np.int32)
        fresh = np.zeros(len(keys), bool)
        for i, k in enumerate(keys.tolist()):
            if k not in seen:
                seen.add(k)
                fresh[i] = True
        if len(seen) > 2_000_000:
            seen.clear()
        fresh &= ends - starts >= SHINGLE
        at = np.flatnonzero(fresh)
        packed = (line_signatures(points, starts[at], ends[at]) >> U(16)).astype("<u2").view("<i8")
        number = np.arange(len(keys)) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
        ink = np.concatenate([[0], np.cumsum(~_BLANK[np.minimum(points, len(_BLANK) - 1)])])
        keep = ink[ends] > ink[starts]
        fresh &= keep
        packed = packed[keep[at]]
        bounds = np.concatenate([[0], np.cumsum(np.where(fresh[keep], packed.shape[1], 0))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(bounds, mask=np.append(~fresh[keep], False)), pa.array(packed.ravel()))
        columns = [pa.array(np.repeat(np.array(ids, np.int64), per_doc)[keep]), pa.array(np.repeat(np.array(tags, np.int64), per_doc)[keep]), pa.array(number.astype(np.int32)[keep]), pa.array(keys[keep]), pa.array(proofs[keep]), lists]
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SIGNED.split(", ")])

    ids, tags, texts, held = [], [], [], 0
    for batch in batches:
        for i, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            ids.append(i)
            tags.append(tag)
            texts.append(text)
            held += len(text)
            if held > CHUNK:
                yield of(ids, tags, texts)
                ids, tags, texts, held = [], [], [], 0
    if ids:
        yield of(ids, tags, texts)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.coalesce(F.col(id_col).cast("long"), F.lit(2**63 - 1)).alias("id"), F.crc32(text.cast("binary")).alias("tag"), text.alias("text")


def removed_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, tag, lines: for each document (id, CRC of the text) that loses lines, their numbers from 0.

    Lines are what newlines part. Two are linked if they are equal, or if their sets of SHINGLE-character
    shingles have a Jaccard similarity of at least `least`. Of 16 bands of 4 values, a pair at 0.8 shares one with a chance
    of 0.9998; candidates are verified exactly (see pairs). Of each component of links, the line
    of the smallest (id, tag, number) stays. Should different lines ever have the same 64-bit hash, a second hash tells, and they stay. Lines without any character but white space are never
    removed: they only part paragraphs."""
    rows = docs.select(*_keyed(docs, id_col, text_col))
    with scratch():  # signatures take most of the space, and only candidates need them
        signed = cut(rows.mapInArrow(_sign, SIGNED), "signed", **{"parquet.enable.dictionary#sig.list.element": "false"})  # hashes don't repeat
        lines = cut(signed.select("id", "tag", "line", "k"), "lines", True)
        classes = signed.groupBy("k").agg(F.min(F.struct("id", "tag", "line")).alias("first"), F.count("*").alias("copies"), F.min("proof").alias("a"), F.max("proof").alias("b"))
        classes = cut(classes.where("a = b").drop("a", "b"), "classes", True)
        sigs = signed.where("sig is not null").select(F.col("k").alias("id"), "sig")
        members = shared_bands(sigs)
        once = sigs.join(built(members.select("id").distinct()), "id").groupBy("id").agg(F.first("sig").alias("sig"))
        groups = components(linked(cut(members.join(once, "id"), "candidates"), "band", similar_signatures(WIDTH, AGREE)))
        groups = cut(groups.select("node", "root").unionByName(groups.select(F.col("root").alias("node"), "root").distinct()), "groups", True)
    wanted = classes.join(groups, F.col("k") == F.col("node")).select("first.*", "k", "root")
    wanted = wanted.groupBy("id", "tag").agg(F.collect_list(F.struct("line", "k", "root")).alias("wanted"))
    held = rows.join(built(wanted), ["id", "tag"]).select(F.split("text", "\n").alias("split"), F.explode("wanted").alias("w"))
    texts = cut(held.select(F.col("w.k").alias("id"), "w.root", F.expr("split[w.line]").alias("text")), "texts")
    if texts.groupBy("id").count().where("count > 1").limit(1).count():  # rows repeat
        texts = texts.dropDuplicates(["id"])
    roots = components(linked(texts, "root", overlapping(all_shingles, least), F.octet_length("text")))
    roots = cut(roots.select("node", "root").unionByName(roots.select(F.col("root").alias("node"), "root").distinct()), "roots")
    named = classes.join(roots, F.col("k") == F.col("node"), "left").withColumn("comp", F.coalesce("root", "k"))
    kept = cut(named.where("root is not null").groupBy("comp").agg(F.min("first").alias("stays")), "kept")
    named = named.join(kept, "comp", "left").select("k", F.coalesce("stays", "first").alias("stays"), "copies", "root")
    named = named.where("copies > 1 or root is not null").select("k", "stays")
    gone = lines.join(built(named), "k").where(F.struct("id", "tag", "line") != F.col("stays"))
    return gone.groupBy("id", "tag").agg(F.collect_set("line").alias("lines"))


def dedup_lines(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the lines of removed_lines() taken out of the text, and two columns more, the last ones: the number of
    lines and of lines removed (_n_lines and _n_removed, with more underscores if docs has such names).

    Null text stays null, with no lines; rows without an id come last in the order of ids; rows equal in id and text
    are one document, of which each row loses the same lines. A document whose lines all go keeps its row with
    an empty text. An empty table gives no rows. Lines of under SHINGLE characters have no shingles
    and are duplicates only of equal lines."""
    i_, tag_, lines_, n_lines, n_removed = free(docs, "_id", "_tag", "_lines", "_n_lines", "_n_removed")
    gone = removed_lines(docs, least, id_col, text_col).select(F.col("id").alias(i_), F.col("tag").alias(tag_), F.col("lines").alias(lines_))
    i, tag, _ = _keyed(docs, id_col, text_col)
    out = docs.join(built(gone), (i == F.col(i_)) & (tag == F.col(tag_)), "left")
    parts = F.split(F.col(text_col), "\n")
    blank = F.col(text_col).isNull()
    left = F.array_join(F.filter(parts, lambda x, n: ~F.array_contains(lines_, n)), "\n")
    new = F.when(F.col(lines_).isNull() | blank, F.col(text_col)).otherwise(left)
    columns = [new.alias(c) if c == text_col else F.col(c) for c in docs.columns]
    count = F.when(F.col(lines_).isNull() | blank, 0).otherwise(F.size(lines_))
    return out.select(*columns, F.when(blank, 0).otherwise(F.size(parts)).alias(n_lines), count.alias(n_removed))


def query(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
