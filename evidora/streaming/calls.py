"""Structured Streaming over call records.

The sources are files; availableNow reads what is there in batches and stops. The sink is Parquet by foreachBatch, with a checkpoint."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidora.sources.files import remove_folder, shared_folder

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream. The table's name is a pattern here: a file source reads directories or patterns; times become zoned,
    which watermarks need."""
    out = spark.readStream.schema(SCHEMA).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return out.withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str, path: str | None = None) -> DataFrame:
    """Runs a query over all that is available into Parquet, a folder for each batch (written again if the batch is), and reads it:
    of mode `complete` the last batch, which has everything, else all. Nothing passes through the driver. path: by default a new one in the shared
    folder, which goes with its checkpoints when Python exits."""
    spark = stream.sparkSession
    if not path:
        path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
        atexit.register(remove_folder, spark, path)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        last[:] = [number]

    q = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/rows/batch={last[0]}" if mode == "complete" else f"{path}/rows/batch=*")


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    out = events.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts by day, emitted once the watermark has passed the day's end; later events are dropped."""
    out = events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("day"), "event_type", "n")


def deduplicated(events: DataFrame, late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def running(events: DataFrame) -> DataFrame:
    """user_id, n, total so far, kept as state of our own."""
    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for pdf in batches:
            n, total = n + len(pdf), total + float(pdf["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, total double", "n long, total double", "update", "NoTimeout")
