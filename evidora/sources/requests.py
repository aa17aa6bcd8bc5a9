"""Request logs as a Spark data source: one line a request, written with commits, read back by its fields.

    spark.dataSource.register(RequestLog)
    lines.write.format("request_log").mode("append").save(path)
    spark.read.format("request_log").load(path)

A write makes files of its own names, and its last act is a manifest that lists them: readers see the files of manifests alone, so a write that fails, or a task
that runs twice, leaves nothing to be seen. path is a folder that driver and executors share, by any URI that pyarrow's file systems open."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: What a line has, in this order: `ts=... request_id=... status=... latency_ms=... message`. The message is the rest of the line.
SCHEMA = "ts string, request_id string, status string, latency_ms double, message string"
_FIELDS = ("ts", "request_id", "status", "latency_ms")


def line(row) -> str:
    """A request as a line; nulls are `-`, line ends in messages and backslashes are escaped."""
    parts = [f"{k}={'-' if row[k] is None else row[k]}" for k in _FIELDS]
    message = "\\N" if row["message"] is None else row["message"].replace("\\", "\\\\").replace("\n", "\\n").replace("\r", "\\r")
    return " ".join([*parts, message])


def parsed(text: str) -> tuple:
    """The fields of a line; one that isn't a request fails the read."""
    head = text.split(" ", len(_FIELDS))
    if len(head) <= len(_FIELDS) or any(not p.startswith(f"{k}=") for k, p in zip(_FIELDS, head)):
        raise ValueError(f"no request line: {text[:200]}")
    ts, request, status, latency = (None if (v := p.split("=", 1)[1]) == "-" else v for p in head[:-1])
    return ts, request, status, None if latency is None else float(latency), None if head[-1] == "\\N" else _unescaped(head[-1])


def _unescaped(text: str) -> str:
    out, it = [], iter(text)
    for c in it:
        out.append({"n": "\n", "r": "\r"}.get(d := next(it, ""), d) if c == "\\" else c)
    return "".join(out)


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        files, folder = _opened(self.path)
        files.create_dir(folder, recursive=True)
        name, n = f"part-{uuid.uuid4().hex}.log", 0
        with files.open_output_stream(f"{folder}/{name}") as out:
            for row in rows:
                out.write((line(row) + "\n").encode())
                n += 1
        return Written(name, n)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, folder = _opened(self.path)
        files.create_dir(folder, recursive=True)
        old = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("manifest-")] if self.overwrite else []
        listed = {"files": [m.file for m in messages if m], "replaces": [p.rsplit("/", 1)[1] for p in old]}
        with files.open_output_stream(f"{folder}/manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps(listed).encode())

    def abort(self, messages: list) -> None:
        files, folder = _opened(self.path)
        for m in messages:
            if m:
                files.delete_file(f"{folder}/{m.file}")


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[File]:
        from pyarrow import fs

        files, folder = _opened(self.path)
        names = [f.path for f in files.get_file_info(fs.FileSelector(folder)) if f.base_name.startswith("manifest-")]
        if not names:
            raise FileNotFoundError(f"{self.path} has no finished log")
        listed = {p.rsplit("/", 1)[1]: json.loads(files.open_input_stream(p).read()) for p in names}
        gone = {x for m in listed.values() for x in m["replaces"]}
        return [File(f"{self.path}/{f}") for name, m in sorted(listed.items()) if name not in gone for f in m["files"]]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        import io

        files, path = _opened(partition.path)
        kinds = [pa.string(), pa.string(), pa.string(), pa.float64(), pa.string()]

        def batch(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[*_FIELDS, "message"])

        rows: list = []
        with files.open_input_stream(path) as raw, io.TextIOWrapper(io.BufferedReader(raw), "utf-8", newline="\n") as lines:
            for text in lines:
                rows.append(parsed(text.rstrip("\n")))
                if len(rows) == 8192:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)


class RequestLog(DataSource):
    """The source and sink `request_log`; its option is the path."""

    @classmethod
    def name(cls) -> str:
        return "request_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"].rstrip("/"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"].rstrip("/"), overwrite)
