"""What the similarity joins share: buckets compared many at a time, and exact overlap of sets.

Candidates are found by signatures: items that share a band meet in its bucket, and there all pairs of
signatures are compared (a matrix of small numbers, no rows). Pairs that agree enough link into candidate
groups; within a group the overlap of all pairs' full sets is counted exactly. Tasks
emit one edge per item towards the smallest item that it reaches, never pairs. How buckets and groups of any
size are compared in blocks of bounded size, see linked()."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import built, cut
from evidora.llm.graph import components
from evidora.llm.hashing import U, mix
from evidora.operators.links import spread

#: Most items, and most bytes of them, of a block; a group of more is dealt into blocks.
BLOCK, BYTES = 512, 8_000_000
#: Of a large group, so large a share of a block is pivots, which are in every block.
PIVOTS = 1 / 8
#: Bands of a bucket, about.
ENTRIES = 1 << 21
EDGES = "a long, b long"


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    """n x bands hashes of `rows` signature values each, different from band to band."""
    n, k = signatures.shape
    bands = k // rows
    part = signatures[:, : bands * rows].reshape(n, bands, rows)
    with np.errstate(over="ignore"):
        out = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U) * U(0x9E3779B97F4A7C15)), (n, bands)).copy()
        for j in range(rows):
            out = mix(out * U(0x2545F4914F6CDD1D) + part[:, :, j])
    return out


def _dealt(bits: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(U)
            if not len(values):
                continue
            width = len(values) // len(ids)
            with np.errstate(over="ignore"):
                h = mix(values.reshape(-1, width) ^ mix(np.arange(1, width + 1, dtype=U) * U(0x9E3779B97F4A7C15))).ravel()
            order = np.argsort(h)
            h, ids = h[order], ids[order // width]
            start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            n = np.diff(np.append(start, len(h)))
            key = h >> U(32 - bits)
            lone, some = start[n == 1], start[n > 1]
            edges = np.arange(1, 1 << bits, dtype=U) << U(32)
            cuts = [np.concatenate([[0], np.searchsorted(key[x], edges), [len(x)]]).tolist() for x in (lone, some)]
            low, own, met = key[lone].astype("<u4").tobytes(), ids[lone].tobytes(), key[some].astype("<u4").tobytes()
            out = [(b, low[4 * p : 4 * q], own[8 * p : 8 * q], met[4 * r : 4 * s]) for b, (p, q, r, s) in enumerate(zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:])) if q > p or s > r]
            if len(some):
                known = np.repeat(n > 1, n)
                out.append((-1 - int(h[0] % U(4096)), key[known].tobytes(), ids[known].tobytes(), b""))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "bands", "ids", "met"])

    return run


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, held = -1, []

    def rows(bands: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(bands.view(np.int64)), pa.array(ids)], names=["band", "id"])

    def done() -> pa.RecordBatch:
        band, ids, met = (np.frombuffer(b"".join(x), t) for x, t in zip(zip(*held), ("<u4", "<i8", "<u4")))
        every = np.concatenate([band, met])
        order = np.argsort(every)
        s = every[order]
        n = np.diff(np.append(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), len(s)))
        order = order[np.repeat(n > 1, n)]
        own, fresh = order < len(band), order >= len(band)
        own_ids = np.where(own, ids[np.minimum(order, len(ids) - 1)] if len(ids) else 0, 0)
        order = order[np.lexsort((own_ids, fresh, every[order]))]  # ids by size, then those met before
        s, i = every[order], np.where(order < len(band), order, -1)
        k = ids[i] if len(ids) else np.zeros(len(i), np.int64)
        keep = np.concatenate([[True], (s[1:] != s[:-1]) | (i[1:] < 0) | (i[:-1] < 0) | (k[1:] != k[:-1])]) if len(s) else np.empty(0, bool)
        s, i = s[keep], i[keep]
        n = np.diff(np.append(np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])), len(s))) if len(s) else np.empty(0, int)
        keep = np.repeat(n > 1, n) & (i >= 0)
        return rows(s[keep].astype(U) | U(at << 32), ids[i[keep]])

    for batch in batches:
        for bucket, bands, ids, met in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket < 0:
                yield rows(np.frombuffer(bands, U), np.frombuffer(ids, np.int64))
                continue
            if bucket != at and held:
                yield done()
                held = []
            at = bucket
            held.append((bands, ids, met))
    if held:
        yield done()


def shared_bands(rows: DataFrame) -> DataFrame:
    """Returns band, id: the bands that several ids have, and those ids. rows has id (long, a repeated one counts once) and sig, a list of longs, all of
    one length, of which each is a band at its place. Of bands that hold the same ids, one is returned.

    Bands are dealt by hash to buckets of some ENTRIES bands, packed: a row for each bucket and Arrow batch, with 32 more bits of each band's hash, and its id. Bands that come
    together within a batch are known there: their bucket gets one of each, without its ids, so that a band of any number of ids fills no task. Where hashes agree by chance, a candidate is more."""
    n, width = rows.agg(F.count("*"), F.max(F.size("sig"))).first()
    bits = min(24, max(6, (n * (width or 1) // ENTRIES).bit_length()))
    dealt = rows.select("id", "sig").mapInArrow(_dealt(bits), "bucket int, bands binary, ids binary, met binary")
    members = cut(dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_met, "band long, id long").distinct(), "members")
    sets = members.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y")).where("n > 1")
    return cut(members.join(built(sets.groupBy("n", "x", "y").agg(F.min("band").alias("band")).select("band")), "band"), "sets")


def by_group(rows: DataFrame, compare: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Runs compare over whole groups (column grp, of bounded size), many at a time: it gets their rows and
    the bounds of the groups in them, and returns edges. Groups are sorted in their partition, so a
    task streams them."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(table: pa.Table):
            g = table.column("grp").to_numpy()
            bounds = np.append(np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])), len(g))
            a, b = compare(table, bounds)
            return pa.RecordBatch.from_arrays([pa.array(np.asarray(a, np.int64)), pa.array(np.asarray(b, np.int64))], names=["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            g = table.column("grp").to_numpy()
            start = int(np.searchsorted(g, g[-1])) if len(g) else 0  # the last group may go on
            if start:
                yield done(table.slice(0, start))
            rest = table.slice(start)
        if rest is not None and rest.num_rows:
            yield done(rest)

    return rows.repartition(F.col("grp")).sortWithinPartitions("grp").mapInArrow(run, EDGES)


def linked(rows: DataFrame, key: str, compare: Callable[[pa.Table, np.ndarray], tuple[np.ndarray, np.ndarray]], weight: Column | None = None) -> DataFrame:
    """Edges a, b that connect the items (column id, a long) of each key just as the links between all pairs of them do. rows has
    key and id, each pair once, and what compare() needs; weight: the bytes of an item.

    A key of up to BLOCK items, and BYTES, is compared whole. The items of a larger one are dealt into blocks, which some pivots join, the same in
    each, and each block is compared. Items that this connects with most of their key need no more comparisons among each other. Those
    left over are compared with all items of their key, block by block. So every pair that no links connect yet is
    compared, and nothing is dropped; in a group of near copies, few are left over, and the work grows with the group, not its square."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("_n"), F.sum(weight if weight is not None else F.lit(1)).alias("_bytes")).where("_n > 1")
    blocks = F.greatest(F.ceil(F.col("_n") / BLOCK), F.least(F.ceil(F.col("_bytes") / BYTES), F.col("_n")))
    blocks = cut(sizes.select(key, "_n", blocks.alias("_blocks")), "blocks")  # a join of two shuffles: Spark can split it
    small = rows.join(blocks.where("_blocks = 1").select(key), key).withColumn("grp", F.xxhash64(key)).drop(key)
    edges = by_group(small, compare)
    if not blocks.where("_blocks > 1").limit(1).count():
        return cut(edges.distinct(), "linked")
    block = F.pmod(F.xxhash64("id"), F.col("_blocks"))
    large = rows.join(blocks.where("_blocks > 1"), key).withColumn("_block", block)
    pivot = F.pmod(F.xxhash64("id", F.lit(1)), F.ceil(F.col("_n") / F.greatest(F.lit(2), F.col("_n") / F.col("_blocks") * PIVOTS))) == 0
    everywhere = F.expr("sequence(0L, _blocks - 1)")
    dealt = large.withColumn("_at", F.explode(F.when(pivot, everywhere).otherwise(F.array("_block"))))
    dealt = dealt.withColumn("grp", F.xxhash64(key, "_at")).drop(key, "_n", "_blocks", "_block", "_at")
    first = cut(by_group(dealt, compare).distinct(), "linked")
    roots = components(first).select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    edges = edges.unionByName(roots.select(F.col("_node").alias("a"), F.col("_root").alias("b")))  # in place of what they follow from
    members = large.select(key, "id", "_n", "_blocks").join(roots, F.col("id") == F.col("_node"), "left").select(key, "id", "_n", "_blocks", F.coalesce("_root", "id").alias("_label"))
    members = cut(members, "members")
    most = members.groupBy(key, "_label").agg(F.count("*").alias("_m")).groupBy(key).agg(F.max(F.struct("_m", "_label")).alias("_most"))
    rest = cut(members.join(most, key).where(F.col("_label") != F.col("_most._label")).select(key, "id", "_n", "_blocks"), "rest")
    if not rest.limit(1).count():
        return cut(edges.distinct(), "linked")
    chunks = rest.groupBy(key).agg(F.ceil(F.count("*") / (F.first("_n") / F.first("_blocks"))).alias("_chunks"))
    lone = rest.select(F.col(key).alias("_key"), F.col("id").alias("_id"))
    every = large.join(chunks, key).join(lone, (F.col(key) == F.col("_key")) & (F.col("id") == F.col("_id")), "left")
    every = every.withColumn("_chunk", F.when(F.col("_id").isNotNull(), F.pmod(F.xxhash64("id", F.lit(2)), F.col("_chunks"))).otherwise(F.lit(-1)))
    # an item is in its block with each chunk of what is left over; an item left over is, with its chunk, in every block
    here = F.transform(F.expr("sequence(0L, _chunks - 1)"), lambda c: F.struct(F.col("_block").alias("b"), c.alias("c")))
    there = F.transform(everywhere, lambda b: F.struct(b.alias("b"), F.col("_chunk").alias("c")))
    places = F.when(F.col("_chunk") < 0, here).otherwise(F.array_union(here, there))
    met = every.withColumn("_at", F.explode(places)).withColumn("grp", F.xxhash64(key, "_at.b", "_at.c", F.lit(3)))
    met = met.drop(key, "_n", "_blocks", "_block", "_at", "_chunks", "_chunk", "_key", "_id")
    return cut(edges.unionByName(by_group(met, compare)).distinct(), "linked")


def _towards(ids: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    root = spread(len(ids), one, two)
    at = np.flatnonzero(root != np.arange(len(ids)))
    return ids[at], ids[root[at]]


def similar_signatures(width: int, agree: int):
    """compare() for by_group: rows (grp, id, sig: width unsigned 16-bit values, as bytes or four to a long) link
    where at least `agree` values are equal."""
    def compare(table: pa.Table, bounds: np.ndarray):
        ids = table.column("id").to_numpy()
        sig = table.column("sig").combine_chunks()
        if pa.types.is_list(sig.type):
            sig = sig.flatten().to_numpy(zero_copy_only=False).astype("<i8").view("<u2").reshape(-1, width)
        else:
            sig = np.frombuffer(b"".join(sig.to_pylist()), "<u2").reshape(-1, width)
        size = np.diff(bounds)
        one, two = [], []
        small = size <= 24
        of = np.repeat(np.where(small, np.arange(len(size)), -1), size)
        for d in range(1, int(size[small].max(initial=0))):  # all small buckets at once, by distance
            i = np.flatnonzero((of[:-d] >= 0) & (of[:-d] == of[d:]))
            for part in np.array_split(i, len(i) // 200_000 + 1):
                hit = part[(sig[part] == sig[part + d]).sum(axis=1) >= agree]
                one.append(hit)
                two.append(hit + d)
        for k in np.flatnonzero(~small):
            lo, hi = int(bounds[k]), int(bounds[k + 1])
            x = sig[lo:hi]
            for i in range(0, hi - lo, 64):
                same = np.zeros((min(64, hi - lo - i), hi - lo), np.uint8)
                for j in range(width):
                    same += x[i : i + 64, j, None] == x[None, :, j]
                p, q = np.nonzero(same >= agree)
                keep = q > p + i
                one.append(p[keep] + i + lo)
                two.append(q[keep] + lo)
        if not one:
            return ids[:0], ids[:0]
        return _towards(ids, np.concatenate(one), np.concatenate(two))

    return compare


def _in_turn(texts: pa.ChunkedArray, bounds: np.ndarray, most: int = 256_000) -> Iterator[list[str] | None]:
    """For each group, the texts of it and of those after it, some `most` bytes at once, or None while such texts last."""
    weight = np.cumsum(np.append(0, pc.binary_length(texts).to_numpy()))[bounds]
    k = 0
    while k < len(bounds) - 1:
        end = max(k + 1, int(np.searchsorted(weight, weight[k] + most, side="right")) - 1)
        lo, hi = int(bounds[k]), int(bounds[end])
        yield texts.slice(lo, hi - lo).to_pylist()
        for _ in range(end - k - 1):
            yield None
        k = end


def overlapping(elements: Callable[[list], list[np.ndarray]], least: float, columns: int = 2048):
    """compare() for by_group: rows (grp, id, text) link where the Jaccard similarity of their element
    sets (elements(texts): a sorted array of unique hashes each) is at least `least`, counted exactly: the common elements
    of all pairs of a group are the product of its 0/1 matrix with itself, over `columns` at a time."""
    def compare(table: pa.Table, bounds: np.ndarray):
        ids = table.column("id").to_numpy()
        one, two = [], []
        held, base = [], 0
        for lo, hi, text in zip(bounds[:-1].tolist(), bounds[1:].tolist(), _in_turn(table.column("text"), bounds)):
            if text is not None:
                held, base = elements(text), lo
            sets = held[lo - base : hi - base]
            n, sizes = len(sets), np.array([len(s) for s in sets])
            if n == 2:
                both = np.concatenate(sets)
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                p, q = ([0], [1]) if common and common >= least * (sizes.sum() - common) else ([], [])
            else:
                everything = np.concatenate(sets)
                row = np.repeat(np.arange(n), sizes)
                order = np.argsort(everything, kind="stable")
                sorted_, row = everything[order], row[order]
                fresh = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, bool)
                column = np.cumsum(fresh) - 1
                many = np.bincount(column, minlength=1)[column] > 1
                row, column = row[many], np.cumsum(fresh[many]) - 1
                common = np.zeros((n, n), np.float32)
                for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
                    a, b = np.searchsorted(column, [c, c + columns])
                    m = np.zeros((n, min(columns, int(column[-1]) + 1 - c)), np.float32)
                    m[row[a:b], column[a:b] - c] = 1
                    common += m @ m.T
                found = [np.empty((2, 0), np.int64)]
                for i in range(0, n, 256):
                    c = common[i : i + 256].astype(np.float64)
                    at = np.array(np.nonzero((c > 0) & (c >= least * (sizes[i : i + 256, None] + sizes[None, :] - c))))
                    at[0] += i
                    found.append(at[:, at[1] > at[0]])
                p, q = np.concatenate(found, axis=1)
            one.append(np.asarray(p, np.int64) + lo)
            two.append(np.asarray(q, np.int64) + lo)
        if not one:
            return ids[:0], ids[:0]
        return _towards(ids, np.concatenate(one), np.concatenate(two))

    return compare
