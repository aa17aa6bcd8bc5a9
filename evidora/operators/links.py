"""Links between rows: connected components by distributed union-find, and the tables that cut lineage on the way."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.sources.files import remove_folder, shared_folder

#: Edges up to which one task joins what is left: some 16 to 80 MB of them, however large the table is that they come from.
FEW = 1 << 20


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: it isn't computed twice, nor does it depend on an executor
    that may be lost. The files go when Python exits."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(remove_folder, spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _stars(edges: DataFrame) -> bool:
    """Whether edges (u, v) are stars: each u has one v, and no v is a u."""
    ends = edges.select("u", F.lit(1).alias("out"), F.lit(0).alias("in")).unionByName(edges.select(F.col("v").alias("u"), F.lit(0).alias("out"), F.lit(1).alias("in")))
    sums = ends.groupBy("u").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return sums.where((F.col("out") > 1) | (F.col("out") > 0) & (F.col("in") > 0)).limit(1).count() == 0


def spread(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """For items 0..n-1 under the links one[i]-two[i], the smallest item that each reaches."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[one], root[two])
        new = root.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        np.minimum.at(new, root[one], low)
        np.minimum.at(new, root[two], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v), all that there are, to stars around the smallest nodes."""
    held = pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pylist([])])
    if not held.num_rows:
        return
    ends = pa.concat_arrays([c for name in ("u", "v") for c in held.column(name).chunks]).dictionary_encode()
    order = pc.sort_indices(ends.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at = place[ends.indices.to_numpy()]
    root = spread(len(order), at[: held.num_rows], at[held.num_rows :])
    more = np.flatnonzero(root != np.arange(len(root)))
    yield pa.RecordBatch.from_arrays([ends.dictionary.take(pa.array(order[x])) for x in (more, root[more])], names=["u", "v"])


def components(edges: DataFrame, a: str = "a", b: str = "b", cut: Callable[[DataFrame, str], DataFrame] = cut, few: int = FEW) -> DataFrame:
    """Returns node, root for every node of edges that isn't its component's smallest (which is root).

    Large star: each node hands its larger neighbours its smallest neighbour; small star: each node
    ties its smaller neighbours and itself to the smallest of them. Both keep components
    and end, after about log n rounds, in stars around the smallest nodes. A node's minimum is
    summed within tasks before a shuffle and cut, so that both sides of the join back to it come straight from a
    shuffle: Spark splits large partitions of such joins, and a star of any size needs no single task. Edges are cut each
    round: a lost executor costs one round. Up to `few` edges need no rounds, whose jobs would take longer than their work: one task joins
    them. Nulls and loops are ignored."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u > v").distinct()
    e = cut(e, "edges")
    if e.count() <= few:  # read from the files' footers
        e = cut(e.coalesce(1).mapInArrow(_joined, e.schema), "edges")
        return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while not _stars(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = cut(large, "large")
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        ties = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        e = cut(ties.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
