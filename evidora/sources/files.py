"""Readers and writers of the stores around the engine: explicit schemas, loud failure on what is missing."""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_SCHEMA = "chunk_id string, doc_id long, section string, pos int, text string, n_tokens int"


def read_jsonl(spark: SparkSession, path: str, schema: str = CHUNK_SCHEMA) -> DataFrame:
    """One record a line; a line that doesn't parse fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole-file JSON: a snapshot of retrieval results, say."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def open_index(spark: SparkSession, path: str) -> DataFrame:
    """A stored index. A missing one fails in Spark; an empty one fails here: it would look like a lack of evidence."""
    df = spark.read.parquet(path)
    if not df.limit(1).count():
        raise ValueError(f"the index {path} is empty")
    return df


def write_postings(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings partitioned by the hash of their term, so that a query reads its terms' partitions only."""
    out = postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    out.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str, terms: list[str], buckets: int = 64) -> DataFrame:
    """The postings of a few terms: partitions are pruned by the terms' hashes, row groups by the terms."""
    wanted = spark.range(1).select(F.array_distinct(F.array(*[F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in terms])).alias("b")).first()["b"]
    return open_index(spark, path).where(F.col("bucket").isin(wanted) & F.col("term").isin(terms)).drop("bucket")


def append_calls(calls: DataFrame, path: str) -> None:
    calls.write.mode("append").parquet(path)


def export_text(df: DataFrame, path: str) -> None:
    """One text file, of a report's size: a single column of lines."""
    df.repartition(1).write.mode("overwrite").text(path)  # what makes the lines keeps its tasks


def write_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """The chunk store: Parquet by a hash of the document, so that one document's chunks lie together."""
    out = chunks.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    out.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "chunk_no").write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return open_index(spark, path).drop("bucket")


def retrieved(live: Callable[[], DataFrame], snapshot: str | None, spark: SparkSession, mode: str = "snapshot") -> DataFrame:
    """Candidates of a retrieval. Mode `live` computes them from the full stores, and writes them to `snapshot` if that is named; mode
    `snapshot` reads what a live run wrote, so that neither index nor vectors are opened."""
    if mode == "snapshot":
        if not snapshot:
            raise ValueError("the mode snapshot needs a path")
        return open_index(spark, snapshot)
    if mode != "live":
        raise ValueError(f"no such mode: {mode}")
    if not snapshot:
        return live()
    live().write.mode("overwrite").parquet(snapshot)
    return open_index(spark, snapshot)


def read_pairs(spark: SparkSession, path: str, names: tuple[str, str] = ("src", "dst")) -> DataFrame:
    """A dictionary from tab-separated lines: translations or synonyms. Lines without a second field fail the read."""
    schema = ", ".join(f"{n} string" for n in names)
    out = spark.read.schema(schema).option("sep", "\t").option("mode", "FAILFAST").csv(path)
    return out.where(F.assert_true(F.col(names[1]).isNotNull(), "a line without a second field").isNull())


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return tempfile.mkdtemp(prefix="evidora-")


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, one of our own in a local session, else an error."""
    have = spark.sparkContext._jsc.sc().getCheckpointDir()
    named = have.get() if have.isDefined() else spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or _own_folder()


def remove_folder(spark: SparkSession, path: str) -> None:
    """Scratch goes, if the session is still there."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001  at exit, the session may be gone
        pass


def resolve_root(start: str | None = None, variable: str = "EVIDORA_ROOT", markers: tuple[str, ...] = ("scripts", "requirements.txt"), depth: int = 6, fallback: str | None = None) -> str:
    """The data root: the environment's if it names one (which must exist), else the nearest of `depth` folders from start up
    that has all markers, else the fallback if it exists. None: an error, never a guess."""
    if named := os.environ.get(variable):
        folder = Path(named).expanduser().absolute()
        if not folder.is_dir():
            raise RuntimeError(f"{variable} names {named}, which isn't a folder")
        return str(folder)
    at = Path(start or os.getcwd()).absolute()
    for folder in [at, *at.parents][:depth]:
        if all((folder / m).exists() for m in markers):
            return str(folder)
    if fallback and os.path.isdir(fallback):
        return fallback
    raise RuntimeError(f"no folder with {' and '.join(markers)} from {at} up; set {variable}")


def evidence_path(name: str, fresh: str, frozen: str) -> str:
    """The fresh copy of a file if there is one, else the frozen copy if there is one, else the fresh path, for callers to skip."""
    paths = [os.path.join(fresh, name), os.path.join(frozen, name)]
    return next((p for p in paths if os.path.exists(p)), paths[0])
