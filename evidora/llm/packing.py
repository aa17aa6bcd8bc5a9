"""Packing token sequences: best-fit-decreasing with a segment tree (whole id matrices), and
hierarchical residual packing (best-fit in each partition, then a tree of merges)."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import cut
from evidora.llm.tokens import END, SEQUENCE, cuts, token_ids


class Residuals:
    """Open bins by residual capacity: a segment tree over the capacities 0..most whose nodes
    say whether any bin below has that much room; finds the tightest bin that an item fits."""

    def __init__(self, most: int):
        self.leaves = 1
        while self.leaves <= most:
            self.leaves *= 2
        self.tree = bytearray(2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def put(self, room: int, bin_no: int) -> None:
        self.bins[room].append(bin_no)
        i = self.leaves + room
        while i and not self.tree[i]:
            self.tree[i] = 1
            i //= 2

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin with the least room of at least need, as (room, bin); it leaves the tree."""
        tree, i = self.tree, self.leaves + need
        if not tree[i]:
            while i > 1 and (i % 2 or not tree[i + 1]):  # up to the first right neighbour with a bin
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if tree[2 * i] else 2 * i + 1
        room = i - self.leaves
        bin_no = self.bins[room].pop()
        if not self.bins[room]:
            tree[i] = 0
            while i > 1 and not tree[i ^ 1]:
                i //= 2
                tree[i] = 0
        return room, bin_no


def best_fit_decreasing(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The bin and the offset of each item, and the number of bins. Sizes are 1..most; equal sizes go in
    the order given."""
    sizes = np.asarray(sizes, dtype=np.int64)
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    full = int((sizes == most).sum())
    bins[order[:full]], offsets[order[:full]] = np.arange(full), 0
    free, n = Residuals(most), full
    for k, size in zip(order[full:].tolist(), sizes[order[full:]].tolist()):
        if got := free.take(size):
            room, b = got
        else:
            room, b, n = most, n, n + 1
        bins[k], offsets[k] = b, most - room
        if room > size:
            free.put(room - size, b)
    return bins, offsets, n


# ---- whole id matrices -------------------------------------------------------------------

MATRIX = "sequence_id long, n_tokens int, n_segments int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, pieces array<int>, starts array<long>"


def _matrices(batches: Iterable[pa.RecordBatch], most: int, end: int, pad: int, buffer: int, path: str | None) -> Iterator[pa.RecordBatch]:
    """Best-fit-decreasing over at most `buffer` ids at a time, so memory is bounded."""
    number = TaskContext.get().partitionId() << 33
    held: list[tuple] = []
    kept = 0
    steps = np.arange(most, dtype="<u2")

    def flush():
        nonlocal number
        sizes = np.array([len(x[3]) for x in held])
        bins, offsets, n = best_fit_decreasing(sizes, most)
        order = np.lexsort((offsets, bins))
        bounds = np.append(np.flatnonzero(np.diff(bins[order], prepend=-1)), len(order))
        rows: list[list] = [[] for _ in range(9)]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            members = [held[i] for i in order[a:b].tolist()]
            ids = np.concatenate([m[3] for m in members])
            lens = [len(m[3]) for m in members]
            lines = np.full(most, pad, "<u4")
            lines[: len(ids)] = ids
            places = np.concatenate([steps[:k] for k in (*lens, most - len(ids))])
            for column, value in zip(rows, (number, len(ids), len(lens), lines.tobytes(), places.tobytes(), np.cumsum([0, *lens]).tolist(), [m[0] for m in members], [m[1] for m in members], [m[2] for m in members])):
                column.append(value)
            number += 1
            if len(rows[0]) >= 256:
                yield _batch(rows)
                rows = [[] for _ in range(9)]
        if rows[0]:
            yield _batch(rows)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = token_ids(text, path, end)
            for piece, start, length in cuts(len(ids), most):
                held.append((doc_id, piece, start, ids[start : start + length].copy()))
            kept += len(ids)
            if kept >= buffer:
                yield from flush()
                held, kept = [], 0
    if held:
        yield from flush()


_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]


def _batch(rows: list[list]) -> pa.RecordBatch:
    names = [x.split()[0] for x in MATRIX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, _TYPES)], names=names)


def pack_matrices(docs: DataFrame, most: int = SEQUENCE, end: int = END, pad: int = 0, buffer: int = 4_000_000, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence: its ids as `most` little-endian unsigned 32-bit numbers
    (padded with pad), the positions, which start again at 0 with each segment (and with the
    padding), as unsigned 16-bit numbers, the cumulative segment lengths from 0, and each segment's document,
    piece and start in it. Every id of every document is in exactly one place.

    No shuffle: each partition packs `buffer` ids at a time, some thousand sequences, over
    which best-fit-decreasing loses next to nothing. sequence_id numbers a partition's
    sequences. Null and empty texts are the end id alone; null ids are kept as null; equal rows
    are packed as often as they come; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(lambda it: _matrices(it, most, end, pad, buffer, path), MATRIX)


# ---- hierarchical residual packing -------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long"


def _pieces(batches: Iterable[pa.RecordBatch], most: int, end: int, hold: int, path: str | None) -> Iterator[pa.RecordBatch]:
    """Pieces of a partition's documents with their bins after a local best-fit."""
    number = TaskContext.get().partitionId() << 33
    rows: list[tuple] = []

    def flush():
        nonlocal number
        columns = [np.array(c, dtype=np.int64) for c in list(zip(*rows))[1:]]
        bins, places, n = best_fit_decreasing(columns[2], most)
        arrays = [pa.array([r[0] for r in rows], pa.int64()), pa.array(columns[0].astype(np.int32))]
        arrays += [pa.array(c) for c in (*columns[1:], bins + number, places)]
        number += n
        return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = token_ids(text, path, end)
            data = memoryview(ids.tobytes())
            for piece, start, length in cuts(len(ids), most):
                rows.append((doc_id, piece, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
        if len(rows) >= hold:
            yield flush()
            rows = []
    if rows:
        yield flush()


def _merge(most: int):
    def merge(items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values("bin", ignore_index=True)
        bins, places, n = best_fit_decreasing(items["fill"].to_numpy(), most)
        first = np.full(n, -1, np.int64)
        first[bins[::-1]] = items["bin"].to_numpy()[::-1]  # the smallest id of those in it
        return pd.DataFrame({"bin": items["bin"], "parent": first[bins], "shift": places, "grp": items["grp"]})

    return merge


def pack_pieces(docs: DataFrame, most: int = SEQUENCE, end: int = END, slack: int = 8, fan_in: int = 8, hold: int = 500_000, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece.

    Each partition packs its own pieces best-fit-decreasing. Bins with at most `slack` ids of room
    are done; the others go up a tree as items as large as their fill: fan_in groups merge into one,
    which packs them best-fit-decreasing again, emits what is now nearly full and hands on the rest,
    up to one group. A group never takes more than `hold` items in: while more are left, there
    are more groups. Only lengths travel: ids stay where they were made, as a CRC.

    Null and empty texts are the end id alone; null ids are kept as null; equal rows are packed
    as often as they come; an empty table gives no rows; other columns are ignored."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    pieces = cut(rows.mapInArrow(lambda it: _pieces(it, most, end, hold, path), PIECES), "pieces")
    items = pieces.groupBy("bin").agg(F.sum("length").alias("fill")).where(F.col("fill") < most - slack)
    items = cut(items.withColumn("grp", F.shiftright("bin", 33)), "items")
    groups = (items.agg(F.max("grp")).first()[0] or 0) + 1
    placed: DataFrame | None = None
    while True:
        n = items.count()
        now = max(1, -(-n // hold), -(-groups // fan_in))
        items = items.withColumn("grp", F.floor(F.col("grp") * now / groups).cast("long"))
        moved = cut(items.groupBy("grp").applyInPandas(_merge(most), "bin long, parent long, shift long, grp long"), "moved")
        step = moved.select("bin", "parent", "shift")
        if placed is None:
            placed = step
        else:
            up = step.select(F.col("bin").alias("parent"), F.col("parent").alias("_parent"), F.col("shift").alias("_shift"))
            placed = placed.join(up, "parent", "left").select("bin", F.coalesce("_parent", "parent").alias("parent"), (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift"))
        if now == 1 or now >= groups:
            break
        fills = moved.join(items.select("bin", "fill"), "bin").groupBy("parent", "grp").agg(F.sum("fill").alias("fill"))
        items = cut(fills.where(F.col("fill") < most - slack).select(F.col("parent").alias("bin"), "fill", "grp"), "items")
        groups = now
    out = pieces.join(placed, "bin", "left")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("parent", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset"))


def query_matrices(spark, sf_dir: str) -> DataFrame:
    return pack_matrices(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def query_pieces(spark, sf_dir: str) -> DataFrame:
    return pack_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
