"""Embedding near-dedup by spherical-cap filters with structured random product codes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.llm.common import cut
from evidora.llm.graph import components

#: Most rows of a filter that one task compares at once; larger filters are split into blocks.
BLOCK = 1024
#: So many independent product codes share the filters: in one alone, some vectors have far fewer than others.
CODES = 8
#: A pair at the least cosine has so many filters in common on average; exp(-9) is 1 in 8,000.
COMMON = 9.0


@lru_cache(maxsize=64)
def _tail(dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Cosines, falling, and the share of the directions in dim dimensions that have at least that cosine with a given one."""
    angle = (np.arange(100_000) + 0.5) * np.pi / 100_000
    share = np.cumsum(np.sin(angle) ** (dim - 2)) if dim > 1 else 0.5 + 0.5 * (angle > np.pi / 2)
    return np.cos(angle), share / share[-1]


def cap(dim: int, share: float) -> float:
    """The cosine that this share of all directions exceeds."""
    cosines, shares = _tail(dim)
    return float(np.interp(share, shares, cosines))


def chance(dim: int, share: float, least: float) -> float:
    """Of two vectors at cosine `least`, the chance that a filter of one holds the other."""
    if least >= 1 or dim < 3:
        return float(least >= 1)
    t = cap(dim, share)
    cosines, shares = _tail(dim)
    inside = cosines >= t
    s, mass = cosines[inside], np.diff(shares[inside], prepend=0.0)
    others, held = _tail(dim - 1)
    need = (t - least * s) / np.sqrt((1 - least**2) * (1 - s**2))
    return float((mass * np.interp(need, others[::-1], held[::-1])).sum() / mass.sum()) if len(s) else 0.0


class Code:
    """A product code of unit directions in dim dimensions. After a random rotation, the dimensions
    fall into m blocks with `size` random unit codewords each; a direction is one codeword per
    block, so there are size**m of them. decode() lists all whose cap a vector lies in."""

    def __init__(self, dim: int, directions: float, share: float, seed: int = 5):
        rng = np.random.default_rng([seed, dim])
        self.m = min(max(1, dim // 4), max(1, 2 if directions <= 1e6 else int(np.ceil(np.log(directions) / np.log(1000)))))
        self.size = max(2, int(np.ceil(directions ** (1 / self.m))))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.blocks = np.array_split(np.arange(dim), self.m)
        self.words = []
        for block in self.blocks:
            w = rng.standard_normal((self.size, len(block)))
            self.words.append(w / np.linalg.norm(w, axis=1, keepdims=True) * np.sqrt(len(block) / dim))
        self.least = cap(dim, share)

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """The numbers of the directions u with <x, u> >= least, for each unit vector (row) x."""
        row, code, _ = self.scored(x, np.full(len(x), self.least))
        order = np.lexsort((code, row))
        return np.split(code[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])

    def scored(self, x: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, direction, score) of the directions u with <x, u> >= least, a bound for each row.

        A prefix of codewords goes on only if the best codewords of the blocks to come could
        still lift it over the bound; so the work follows the list's length, not the code's."""
        x = x @ self.rotation
        scores = [x[:, b] @ w.T for b, w in zip(self.blocks, self.words)]
        best = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
        row, code, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
        for i, s in enumerate(scores):
            rest = best[i + 1] if i + 1 < self.m else np.zeros(len(x))
            at, word = np.nonzero(s[row] + (total + rest[row])[:, None] >= least[row, None])
            total = total[at] + s[row[at], word]
            row, code = row[at], code[at] * self.size + word
        return row, code, total


class Plan(NamedTuple):
    """Filters a vector on average, and their share of all directions; no filters: all vectors are compared."""

    filters: float
    share: float


def plan(dim: int, n: int, least: float, expected: float, load: float) -> Plan:
    """How n vectors of dim dimensions are filtered: by `expected` filters each, or as many more as a pair at `least`
    needs for COMMON common ones, however few vectors there are. In one or two dimensions caps can't tell vectors apart, and there are none."""
    share = min(0.05, load / max(n, 1))
    hit = chance(dim, share, least)
    filters = max(expected, COMMON / hit) if hit > 0 else float("inf")
    return Plan(0.0, 1.0) if dim < 3 or filters == float("inf") else Plan(filters, share)


class Filters:
    """The filters of a plan. A vector has those whose cap it lies in, and never fewer than the plan's
    average: if too few, its nearest ones."""

    def __init__(self, dim: int, planned: Plan):
        self.fewest = int(np.ceil(planned.filters))
        self.codes = [Code(dim, planned.filters / CODES / planned.share, planned.share, 5 + i) for i in range(CODES)] if self.fewest else []

    def lists(self, x: np.ndarray) -> list[np.ndarray]:
        """The numbers of the filters of each unit vector (row) x, sorted."""
        if not self.codes:
            return [np.zeros(1, np.int64)] * len(x)
        out: list = [None] * len(x)
        rows, bound = np.arange(len(x)), self.codes[0].least
        while len(rows):
            parts, base = [], 0
            for code in self.codes:
                row, number, score = code.scored(x[rows], np.full(len(rows), bound))
                parts.append((row, number + base, score))
                base += code.size**code.m
            row, number, score = (np.concatenate(c) for c in zip(*parts))
            order = np.lexsort((-score, row))
            count = np.bincount(row, minlength=len(rows))
            # after the first round, rows have only their nearest
            last = None if bound == self.codes[0].least else self.fewest
            for i, at in enumerate(np.split(order, np.cumsum(count)[:-1])):
                if len(at) >= self.fewest or bound < -1:
                    out[rows[i]] = np.sort(number[at[:last]])
            rows = rows[count < self.fewest] if bound >= -1 else rows[:0]
            bound -= 0.03
        return out


@lru_cache(maxsize=8)
def _filters(dim: int, planned: Plan) -> Filters:
    return Filters(dim, planned)


DECODED = "filter long, dim int, id long, copies long, filters array<long>, vector binary"


def _decode(plans: dict[int, Plan], kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, copies, vectors = (batch.column(i).to_pylist() for i in range(3))
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, all_rows in by_dim.items():
                for some in range(0, len(all_rows), 128):
                    rows = all_rows[some : some + 128]
                    x = np.array([vectors[i] for i in rows], np.float64)
                    raw = x.astype(kind)
                    x = x / np.abs(x).max(axis=1, keepdims=True)
                    lists = _filters(dim, plans[dim]).lists(x / np.linalg.norm(x, axis=1, keepdims=True))
                    out: list[list] = [[] for _ in range(6)]
                    for i, v, found in zip(rows, raw, lists):
                        found = found.tolist()
                        for j, f in enumerate(found):
                            for column, value in zip(out, (f, dim, ids[i], copies[i], found[:j], v.tobytes())):
                                column.append(value)
                    yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()))], names=["filter", "dim", "id", "copies", "filters", "vector"])

    return run


def _seen_before(lists: list[list[int]]) -> np.ndarray:
    """For each pair of rows, whether they share a filter below their bucket's: then the pair is counted there. lists: those of each row."""
    names, counts = np.unique(np.concatenate([np.array(x, np.int64) for x in lists]), return_counts=True)
    names = names[counts > 1]
    member = np.zeros((len(lists), len(names)), np.float32)
    for i, x in enumerate(lists):
        at = np.searchsorted(names, x)
        member[i, [k for k, f in zip(at, x) if k < len(names) and names[k] == f]] = 1
    return member @ member.T > 0


def _verify(least: float, kind: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        one, two = (k.as_py() for k in key[2:])
        table = table.sort_by("id")
        ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
        n = len(ids)
        x = np.frombuffer(b"".join(table.column("vector").to_pylist()), kind).reshape(n, -1).astype(np.float64)
        norm = np.linalg.norm(x, axis=1)
        with np.errstate(all="ignore"):
            near = (x @ x.T) / (norm[:, None] * norm[None, :]) >= least
        np.fill_diagonal(near, False)
        if one != two:
            near &= block[:, None] != block[None, :]
        near |= near.T
        root = np.arange(n)
        while True:  # the smallest row that each row reaches here
            low = np.minimum(root, np.where(near, root[None, :], n).min(axis=1, initial=n))
            low = low[low]
            if (low == root).all():
                break
            root = low
        if near.any():
            near &= ~_seen_before(table.column("filters").to_pylist())
        degree = near @ copies
        keep = (degree > 0) | (root != np.arange(n))
        return pa.table({"id": ids[keep], "degree": degree[keep].astype(np.int64), "root": ids[root][keep]})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.9, expected: float = 20.0, load: float = 48.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Returns id, n_links, component_id, kept: for each vector the others of cosine >= least (in double
    precision) that were found, the smallest id that links lead to, and whether that is its own.

    Equal vectors are one class; a class links all its members. The classes' vectors go to all filters whose
    cap they exceed, `expected` on average and at least, of so many directions that a filter holds `load`
    vectors on average, however many vectors there are. Of a pair at `least`, a filter of one holds the other
    with a chance that falls with their number (at 0.9 in 64 dimensions from about 0.5 to 0.2 at ten million), so
    the filters of a vector become more (see plan); a few pairs in a thousand there may be missed (tests measure it),
    and fewer that are nearer. Vectors of one or two dimensions are all compared. Pairs
    of a filter are compared block by block, and each pair is counted at its first common filter; a task
    hands on each vector's number of links and one link towards its smallest partner, never the pairs.

    Null, empty and zero vectors and those with null or non-finite components link with nothing,
    and vectors of different length don't link. A null id keeps its row, with its links, and is never a
    component's name unless alone. Repeated rows are vectors of their own. An empty table gives no rows."""
    v = F.col("v").cast("array<double>")
    fine = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("class", F.when(F.coalesce(fine, F.lit(False)), F.md5(F.array_join("v", ",").cast("binary"))))
    classes = rows.where("class is not null").groupBy("class").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), F.first(v).alias("v"))
    classes = cut(classes.where("rep is not null"), "classes")
    plans = {r["dim"]: plan(r["dim"], r["count"], least, expected, load) for r in classes.groupBy(F.size("v").alias("dim")).count().collect()}
    kind = "<f4" if vectors.schema[vector_col].dataType.simpleString() == "array<float>" else "<f8"
    decoded = cut(classes.select("rep", "copies", "v").mapInArrow(_decode(plans, kind), DECODED), "decoded")
    loads = decoded.groupBy("filter", "dim").agg(F.count("*").alias("n")).where("n > 1").select("filter", "dim", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    shared = decoded.join(loads, ["filter", "dim"]).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    shared = shared.withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)"))).select("filter", "dim", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "id", "copies", "filters", "vector")
    found = cut(shared.groupBy("filter", "dim", "one", "two").applyInArrow(_verify(least, kind), "id long, degree long, root long"), "found")
    degrees = found.groupBy("id").agg(F.sum("degree").alias("degree"))
    roots = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b")).distinct())
    named = classes.select("class", "rep", "copies").join(degrees, classes["rep"] == degrees["id"], "left").drop("id").join(roots, F.col("rep") == F.col("node"), "left")
    named = named.select(F.col("class").alias("_class"), (F.col("copies") - 1 + F.coalesce("degree", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component"))
    out = rows.select("id", "class").join(named, F.col("class") == F.col("_class"), "left")
    component = F.coalesce("component", "id")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumnRenamed("id", "vec_id")


#: All pairs, and the closure of their links.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v WHERE v IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM n a JOIN n b ON a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9),
r(d, m) AS (SELECT vec_id, vec_id FROM v UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.d),
q AS (SELECT d AS vec_id, min(m) AS component_id FROM r GROUP BY d),
g AS (SELECT x AS vec_id, count(*) AS n_links FROM e GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept FROM q LEFT JOIN g USING (vec_id)
"""
