"""Documents in versions, with their postings kept up: snapshots by manifest, delta segments, tombstones, compaction.

A version is a manifest: the segments that make it, each with documents and their postings, and the tombstones, ids that a version has replaced or removed. Segments are
never changed. A row of segment s is live in a version if no tombstone of its id there is younger than s. The manifest is written last, so a commit that
fails is none; of two commits at once the later one fails, as its version is there already."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.operators.retrieve import distinct_postings

_MANIFEST = "kind string, segment long, name string"


class Versions:
    """A store at path. documents: rows with the columns of `schema` (a DDL string) of which id_col is the key and text_col what is indexed. Ids that are null are refused; of
    rows that repeat an id in one commit, which one stays would be chance, so the commit fails, too."""

    def __init__(self, spark: SparkSession, path: str, schema: str, id_col: str = "doc_id", text_col: str = "text"):
        self.spark, self.path, self.schema, self.id_col, self.text_col = spark, path.rstrip("/"), schema, id_col, text_col

    def _exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def latest(self) -> int:
        """The number of the last version, 0 of an empty store. Versions are dense, so doubling steps find it."""
        if not self._exists("manifest-1/_SUCCESS"):
            return 0
        low, high = 1, 2
        while self._exists(f"manifest-{high}/_SUCCESS"):
            low, high = high, 2 * high
        while high - low > 1:
            middle = (low + high) // 2
            low, high = (middle, high) if self._exists(f"manifest-{middle}/_SUCCESS") else (low, middle)
        return low

    def manifest(self, version: int | None = None) -> list[tuple[str, int, str]]:
        version = self.latest() if version is None else version
        if not version:
            return []
        return sorted(map(tuple, self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest-{version}").collect()))  # a row or two a segment

    def _commit(self, version: int, rows: list[tuple[str, int, str]]) -> int:
        self.spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest-{version}")
        return version

    def _write(self, docs: DataFrame, name: str) -> DataFrame:
        docs.write.parquet(f"{self.path}/docs-{name}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/docs-{name}")
        checked = written.groupBy(self.id_col).agg(F.count("*").alias("n")).where(F.col(self.id_col).isNull() | (F.col("n") > 1)).limit(1).collect()
        if checked:
            raise ValueError(f"the id {checked[0][0]} is null or repeats in a commit")
        distinct_postings(written, self.id_col, self.text_col).write.parquet(f"{self.path}/postings-{name}")
        return written

    def upsert(self, changes: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """A new version with the rows of changes added or put in place of those with their ids, and without the ids of deletes (which changes outdo). Only the changes are
        written and indexed. Returns its number."""
        version, name = self.latest() + 1, uuid.uuid4().hex  # folders of one's own: a commit at the same time writes others
        rows = self.manifest(version - 1)
        gone = []
        if changes is not None:
            written = self._write(changes.select(*[f.name for f in self.spark.createDataFrame([], self.schema).schema]), name)
            rows.append(("segment", version, name))
            gone.append(written.select(F.col(self.id_col).cast("long").alias("id")))
        if deletes is not None:
            gone.append(deletes.select(F.col(self.id_col).cast("long").alias("id")).where("id is not null"))
        if gone and version > 1:
            ids = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
            ids.distinct().write.parquet(f"{self.path}/gone-{name}")
            rows.append(("gone", version, name))
        return self._commit(version, rows)

    def _live(self, kind: str, schema: str, key: str, version: int | None) -> DataFrame:
        listed = self.manifest(version)
        out, gone = None, None
        for what, n, name in listed:
            if what == "segment":
                part = self.spark.read.schema(schema).parquet(f"{self.path}/{kind}-{name}").withColumn("_segment", F.lit(n).cast("long"))
                out = part if out is None else out.unionByName(part)
            else:
                part = self.spark.read.schema("id long").parquet(f"{self.path}/gone-{name}").withColumn("_at", F.lit(n).cast("long"))
                gone = part if gone is None else gone.unionByName(part)
        if out is None:
            return self.spark.createDataFrame([], schema)
        if gone is not None:
            last = gone.groupBy("id").agg(F.max("_at").alias("_at"))
            out = out.join(last, F.col(key) == F.col("id"), "left").where(F.col("_at").isNull() | (F.col("_segment") >= F.col("_at"))).drop("id", "_at")
        return out.drop("_segment")

    def documents(self, version: int | None = None) -> DataFrame:
        """The documents as of a version (none: the last)."""
        return self._live("docs", self.schema, self.id_col, version)

    def postings(self, version: int | None = None) -> DataFrame:
        """term, doc_id, tf as of a version: what postings() of its documents would give, without reading a text."""
        return self._live("postings", "term string, doc_id long, tf long", "doc_id", version)

    def compact(self) -> int:
        """A new version of the same rows in one segment, without tombstones. Older versions stay readable."""
        version, name = self.latest() + 1, uuid.uuid4().hex
        self.documents(version - 1).write.parquet(f"{self.path}/docs-{name}")
        self.postings(version - 1).write.parquet(f"{self.path}/postings-{name}")
        return self._commit(version, [("segment", version, name)])
