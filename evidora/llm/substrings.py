"""Substring dedup by relative Lempel-Ziv parsing against content-defined reference blocks.

Every window of `window` words belongs to one block: the smallest hash of the k-word shingles in
it (its anchor) says which. Consecutive windows with the same anchor form one block, so
blocks depend on content alone, and equal passages fall into equal blocks wherever they stand. The blocks of
all documents, each at its first occurrence, are the reference that the index holds.

A document is parsed greedily from left to right into factors (start, length, reference document, reference start): the block at hand, if the
index knows it from an earlier document, begins a factor, and every next one that goes on in
the same place of the reference makes it longer. At a factor's boundary, where a block isn't known as a whole (a
passage begins, ends or was edited within it), its windows are looked up one by one among the
windows of the reference blocks that share the anchor, and lengthen the factor by a word each. What no factor covers are
literals. A factor has at least one window, so all are long enough to be duplicate spans; and a window
found in no earlier document is in none: whoever has it has its anchor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import cut
from evidora.llm.hashing import Runs, U, buffers, many_words, runs, word_bounds


def blocks_of(h: np.ndarray, bounds: np.ndarray, window: int, k: int) -> tuple[np.ndarray, ...]:
    """Of documents with the words' hashes h[bounds[i] : bounds[i + 1]]: document, anchor, content hash, first and last window of each block."""
    least = runs(h, k)
    size, need = 1, window - k + 1  # shingles in a window
    while size < need and len(least):  # minima over twice as many each time
        step = min(size, need - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    doc = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(least)]
    at = np.flatnonzero(np.arange(len(least)) + window <= bounds[1:][doc])  # windows within one document
    if not len(at):
        none = np.empty(0, np.int64)
        return none, none.astype(U), none.astype(U), none, none
    value = least[at]
    heads = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (at[1:] != at[:-1] + 1)]))
    first, last = at[heads], at[np.append(heads[1:], len(at)) - 1]
    of = doc[first]
    return of, value[heads], Runs(h).hashes(first, last + window), first - bounds[of], last - bounds[of]


#: again: the same content comes earlier in the row.
BLOCKS = "id long, tag long, anchor long, content long, first int, last int, again boolean"


def _index(window: int, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy() for i in range(2))
            done = 0
            for h, bounds in many_words(buffers(batch.column(2))):
                of, anchor, content, first, last = blocks_of(h, bounds, window, k)
                if len(of):
                    again = np.ones(len(of), bool)
                    order = np.lexsort((content, of))
                    again[order[np.concatenate([[True], (of[order[1:]] != of[order[:-1]]) | (content[order[1:]] != content[order[:-1]])])]] = False
                    columns = (ids[done + of], tags[done + of], anchor.view(np.int64), content.view(np.int64), first.astype(np.int32), last.astype(np.int32), again)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in BLOCKS.split(", ")])
                done += len(bounds) - 1

    return run


WINDOWS = "id long, tag long, anchor long, content long, at int"


def _windows(window: int):
    """From documents and their boundary blocks, the windows of those blocks."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for h, bounds in many_words(buffers(batch.column(2))):
                n = len(bounds) - 1
                all_, lists = runs(h, window), batch.column(3).slice(done, n)
                block, sizes = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
                first, last = (block.field(i).to_numpy().astype(np.int64) for i in (1, 2))
                of = np.repeat(np.arange(n), sizes)
                many = last - first + 1
                at = np.repeat(first - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                row = np.repeat(of, many)
                columns = (batch.column(0).to_numpy()[done + row], batch.column(1).to_numpy()[done + row], np.repeat(block.field(0).to_numpy(), many), all_[bounds[row] + at].view(np.int64), at.astype(np.int32))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in WINDOWS.split(", ")])
                done += n

    return run


class Factors(NamedTuple):
    """Factors of one document, from left to right; they may overlap by less than a window."""

    start: np.ndarray
    length: np.ndarray
    ref_id: np.ndarray
    ref_tag: np.ndarray
    ref_start: np.ndarray


def parse(first: np.ndarray, last: np.ndarray, ref_id: np.ndarray, ref_tag: np.ndarray, ref_first: np.ndarray, window: int) -> Factors:
    """The greedy parse of a document of which the windows first[i]..last[i] are known to stand in document (ref_id[i], ref_tag[i]) from
    window ref_first[i] on: a factor goes on as long as what is known next follows in the same place there."""
    order = np.lexsort((ref_first, ref_tag, ref_id, first))
    first, last, ref_id, ref_tag, ref_first = (x[order].astype(np.int64) for x in (first, last, ref_id, ref_tag, ref_first))
    place = ref_first - first
    same = (ref_id[1:] == ref_id[:-1]) & (ref_tag[1:] == ref_tag[:-1]) & (place[1:] == place[:-1]) & (first[1:] == last[:-1] + 1)
    heads = np.flatnonzero(np.concatenate([[True], ~same])) if len(first) else np.empty(0, np.int64)
    ends = last[np.append(heads[1:], len(first)) - 1] if len(first) else heads
    return Factors(first[heads], ends + window - first[heads], ref_id[heads], ref_tag[heads], ref_first[heads])


def covered(factors: Factors, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words (flags, of n) that factors cover, and the spans that they form, as starts and ends."""
    edge = np.bincount(factors.start, minlength=n + 1) - np.bincount(factors.start + factors.length, minlength=n + 1)
    gone = np.cumsum(edge)[:n] > 0
    return gone, np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)


RESULT = "id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:int,end:int>>, factors array<struct<start:int,length:int,ref_id:bigint,ref_tag:bigint,ref_start:int>>"
_SPAN = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
_FACTOR = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32()), ("ref_id", pa.int64()), ("ref_tag", pa.int64()), ("ref_start", pa.int32())]))


def _clean(window: int):
    """Documents with what is known of them, to their factors and what is left of them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for i, (doc_id, data) in enumerate(zip(batch.column(0).to_pylist(), buffers(batch.column(1)))):
                found = batch.column(2)[i]
                if found.is_valid:
                    n = len(word_bounds(data)[0])
                    factors = parse(*(c.to_numpy() for c in found.values.flatten()), window)
                    gone, spans = covered(factors, n)
                    words = [w for w, g in zip(data.tobytes().split(), gone.tolist()) if not g]
                    names = _FACTOR.value_type.names
                    more = (int(gone.sum()), [dict(zip(("start", "end"), s)) for s in spans.tolist()], [dict(zip(names, f)) for f in zip(*(c.tolist() for c in factors))])
                else:
                    words = data.tobytes().split()  # bytes.split() splits at just the six characters
                    n, more = len(words), (0, [], [])
                for column, value in zip(rows, (doc_id, n, more[0], hashlib.sha256(b" ".join(words)).hexdigest(), *more[1:])):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), _SPAN, _FACTOR)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], names=["id", "n_words", "n_removed", "kept_sha256", "spans", "factors"])

    return run


def known_windows(rows: DataFrame, window: int, k: int) -> DataFrame:
    """rows: id, tag (the CRC of the text, for rows that share an id), text. Returns id, tag, first, last, ref_id, ref_tag, ref_first:
    ranges of windows that stand in an earlier document too, and where (its first occurrence).

    Hot passages: the index sums by block within each task before it shuffles, of each distinct block
    only the occurrences in its first document go on to the boundary check, and the joins back are ones whose large partitions
    Spark splits."""
    texts = rows.select("id", "tag", "text")
    blocks = cut(texts.where(F.col("id").isNotNull()).mapInArrow(_index(window, k), BLOCKS), "blocks")
    index = blocks.groupBy("anchor", "content").agg(F.min(F.struct("id", "tag", "first", "last")).alias("least"), F.max("id").alias("largest"))
    index = cut(index, "index")
    refs = [F.col("least.id").alias("ref_id"), F.col("least.tag").alias("ref_tag"), F.col("least.first").alias("ref_first")]
    known = index.where(F.col("least.id") < F.col("largest")).select("anchor", "content", *refs)
    found = ["id", "tag", "first", "last", "ref_id", "ref_tag", "ref_first"]
    whole = blocks.join(known, ["anchor", "content"]).where("ref_id < id").select(*found)
    # boundaries: blocks whose anchor stands in other content too, wherever they stand in the first document of each content
    shared = index.groupBy("anchor").agg(F.count("*").alias("n"), F.min("least.id").alias("a"), F.max("least.id").alias("b")).where("n > 1 and a < b").select("anchor")
    edges = cut(index.join(shared, "anchor").select("anchor", "content", "least.*"), "edges")
    repeated = texts.where("id is not null").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id")
    others = blocks.where("again")
    if repeated.limit(1).count():  # another row of the document may have the block
        others = others.unionByName(blocks.join(repeated, "id", "left_semi"))
    others = others.join(edges.select("anchor", "content", "id"), ["anchor", "content", "id"]).select("anchor", "id", "tag", "first", "last")
    lists = edges.drop("content").unionByName(others).groupBy("id", "tag").agg(F.collect_set(F.struct("anchor", "first", "last")).alias("blocks"))
    windows = cut(texts.join(lists, ["id", "tag"]).select("id", "tag", "text", "blocks").mapInArrow(_windows(window), WINDOWS), "windows")
    earliest = windows.groupBy("anchor", "content").agg(F.min(F.struct("id", "tag", F.col("at").alias("first"))).alias("least"), F.max("id").alias("largest")).where("least.id < largest")
    earliest = cut(earliest.select("anchor", "content", *refs), "earliest")  # so that the join's sides come straight from a shuffle, and Spark can split a hot passage
    single = windows.join(earliest, ["anchor", "content"]).where("ref_id < id").select("id", "tag", F.col("at").alias("first"), F.col("at").alias("last"), "ref_id", "ref_tag", "ref_first")
    return cut(whole.unionByName(single), "found")


def remove_repeats(docs: DataFrame, window: int = 50, k: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns id, n_words, n_removed, kept_sha256, the removed spans (in words) and the factors of each row: of each its start and length,
    the earlier document that has it (id and CRC of its text) and where it starts there, all in words.

    Removed is each word covered by a window of `window` words whose word sequence also starts in
    a document with a smaller id; windows are judged on the input. Words are runs of anything but
    space and U+0009..U+000D. Sequences are compared by two 64-bit hashes, of the window and of its anchor.

    Null and empty texts have no words. Rows without an id are returned unchanged: nothing is
    before or after them. Rows that share an id count as one document that no window of itself
    repeats. An empty table gives no rows; other columns are ignored."""
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("tag"), text.alias("text"))
    found = known_windows(rows, window, k)
    lists = found.groupBy(F.col("id").alias("_id"), F.col("tag").alias("_tag")).agg(F.collect_set(F.struct("first", "last", "ref_id", "ref_tag", "ref_first")).alias("found"))
    return rows.join(lists, (F.col("id") == F.col("_id")) & (F.col("tag") == F.col("_tag")), "left").select("id", "text", "found").mapInArrow(_clean(window), RESULT)


def query(spark, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


#: Every window's words, compared as text.
ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50),
win AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM i),
f AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM win JOIN f USING (h), range(0, 50) r(k) WHERE m < doc_id),
g AS (SELECT doc_id, list(p) AS g FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(g), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(CASE WHEN g IS NULL THEN ws ELSE list_filter(ws, lambda x, n: NOT list_contains(g, n)) END, ' '), '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id)
"""
