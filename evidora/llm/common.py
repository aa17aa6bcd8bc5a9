"""What the operators of this subpackage share: cut lineage, number rows, name columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A word of the contracts: a run of anything but space and the five control characters.
WORD = r"[^\x20\x09-\x0D]+"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables cut so far, by the scratch() that they belong to; those of none go when Python exits.
_tables: list[list[tuple[SparkSession, str]]] = [[]]


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return tempfile.mkdtemp(prefix="evidora-")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage: the one that spark.checkpoint.dir names. Where that is unset, a local
    session (tests, a single machine) gets a folder of our own, and any other an error: its machines share no other folder."""
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = have.get() if have.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _own_dir()


def built(df: DataFrame) -> DataFrame:
    """df as the side of a join that is hashed: it has few rows for each of the other side's, and one per key, so
    its share of a partition fits in memory and the other side need not be sorted. Spark splits large partitions of such joins, too."""
    return df.hint("shuffle_hash")


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as make it one that df doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is scratch
        pass


@atexit.register
def _remove_all() -> None:
    for table in _tables.pop() if _tables else ():
        _remove(*table)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are cut within go at the end, but for those that cut() is told to keep: for a step whose result is written by then."""
    _tables.append([])
    try:
        yield
    finally:
        for table in _tables.pop():
            _remove(*table)


def cut(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: later stages neither compute it
    twice nor depend on an executor that may be lost. The files go when Python exits, or at the end of a scratch() (keep: of the one
    around it). options: of the Parquet writer."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")  # this job's shuffle files are of no use once it has ended
    _tables[-2 if keep and len(_tables) > 1 else -1].append((spark, path))
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEAN) if before is None else spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> tuple[DataFrame, int]:
    """Adds global row numbers from 0 in the given order, and returns their count.

    Rows are range-partitioned by `order` and cut, so the partition of a row is a stored
    value. Only one count a partition (bounded by the number of shuffle partitions) reaches
    the driver; the numbers themselves are a window within each partition."""
    spark = df.sparkSession
    ranged = cut(df.repartitionByRange(*order, F.monotonically_increasing_id()).withColumn("_pid", F.spark_partition_id()), "ranged")
    counts = sorted((r["_pid"], r["count"]) for r in ranged.groupBy("_pid").count().collect())
    total, starts = 0, []
    for pid, n in counts:
        starts.append((pid, total))
        total += n
    offsets = spark.createDataFrame(starts, "_pid int, _start long")
    within = F.row_number().over(Window.partitionBy("_pid").orderBy(*order)).cast("long")
    out = ranged.withColumn("_n", within).join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_start") + F.col("_n") - 1)
    return out.drop("_pid", "_n", "_start"), total
