"""Streams in several runs on one checkpoint: rows in the order of their arrival, late ones dropped, sessions closed by timers."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from evidora.sources.files import remove_folder, shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Arrivals:
    """A stream that is fed and drained again and again, as a job that comes by once a day does: every run() takes in what has arrived since, with the state and the watermark
    of the runs before. Everything lies in the shared folder."""

    def __init__(self, schema, plan: Callable[[DataFrame], DataFrame], mode: str = "append"):
        self.schema, self.plan, self.mode = schema, plan, mode
        self.path, self.progress = "", []

    def run(self, rows: DataFrame) -> None:
        """Takes in rows, and empty batches after them that move the watermark on."""
        spark = rows.sparkSession
        if not self.path:
            self.path = f"{shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
            atexit.register(remove_folder, spark, self.path)
        rows.write.mode("append").parquet(f"{self.path}/in")
        out = self.plan(spark.readStream.schema(self.schema).parquet(f"{self.path}/in"))
        self.out_schema = out.schema

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{self.path}/out/batch={number}")  # the same batch again replaces itself

        q = out.writeStream.foreachBatch(write).outputMode(self.mode).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start()
        try:
            q.awaitTermination()
            self.progress += [p for p in q.recentProgress]
        finally:
            q.stop()

    def result(self, spark) -> DataFrame:
        return spark.read.schema(self.out_schema).parquet(f"{self.path}/out/batch=*") if self.progress else spark.createDataFrame([], "n long").limit(0)

    def dropped(self) -> int:
        """Rows (for aggregations: groups of a task's rows) that came too late, by the progress records."""
        return sum(s["numRowsDroppedByWatermark"] for p in self.progress for s in p["stateOperators"])


def months(rows: DataFrame, arrived: str) -> Iterator[DataFrame]:
    """rows by the month in which they arrived, in order."""
    month = F.trunc(arrived, "month")
    low, high = rows.agg(F.min(month), F.max(month)).first()
    while low is not None and low <= high:
        yield rows.where(month == F.lit(low))
        low = (low.replace(day=28) + pd.Timedelta(days=4)).replace(day=1)


def daily(late: str = "1 hour") -> Callable[[DataFrame], DataFrame]:
    """Counts by day and kind. A day closes when the watermark, `late` behind the latest time seen, has passed its end; what comes later for it is dropped."""
    def plan(clicks: DataFrame) -> DataFrame:
        timed = clicks.where("ts is not null").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
        return timed.groupBy(F.window("at", "1 day").alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("day"), "kind", "n")

    return plan


class Sessions(StatefulProcessor):
    """The open sessions of a slice of the users as one list in state: user, first, last, n, in microseconds. Rows join the sessions within `gap` of them, which may make two sessions
    one. One timer a slice, at the end of the gap of the session that ends first, closes all that are over and is set anew for the next, so state lives as long as a session is open
    (Spark takes a time to live with processing time only). A call of Python and its state cost far more than a row, so there is one for a slice, not for each user or session."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("sessions", "user_id long, first long, last long, n long")

    def _read(self) -> pd.DataFrame:
        return pd.DataFrame([tuple(r) for r in self.open.get()], columns=["user_id", "first", "last", "n"], dtype="int64")

    def _keep(self, spans: pd.DataFrame) -> None:
        """Writes the sessions down, with a timer for the first that ends; a timer that is set already stays the same one."""
        if spans.empty:
            self.open.clear()
            return
        self.open.put(list(zip(*(spans[c].tolist() for c in ("user_id", "first", "last", "n")))))
        self.handle.registerTimer((int(spans["last"].min()) + self.gap) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [pd.DataFrame({"user_id": pdf["user_id"], "first": pdf["at"], "last": pdf["at"], "n": 1}) for pdf in rows or ()]
        spans = pd.concat([self._read(), *new]).sort_values(["user_id", "first"], ignore_index=True)
        before = spans.groupby("user_id")["last"].cummax().shift(fill_value=0)
        starts = (spans["user_id"] != spans["user_id"].shift()) | (spans["first"] - before >= self.gap)
        self._keep(spans.groupby(starts.cumsum()).agg({"user_id": "first", "first": "min", "last": "max", "n": "sum"}))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        spans = self._read()
        done = spans["last"] + self.gap <= timerValues.getCurrentWatermarkInMs() * 1000
        self._keep(spans[~done])
        if done.any():
            yield spans[done].rename(columns={"first": "start"})[["start", "user_id", "n"]]

    def close(self) -> None:
        pass


def timed_sessions(late: str = "1 hour", gap_minutes: int = 30, slices: int = 1024) -> Callable[[DataFrame], DataFrame]:
    """start, user_id, n of each session that the watermark has closed. Users are dealt to `slices` keys of state (which stays the same for a checkpoint). The state is in RocksDB,
    so it may be larger than memory."""
    def plan(events: DataFrame) -> DataFrame:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
        timed = events.where("user_id is not null and ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
        rows = timed.select(F.pmod(F.xxhash64("user_id"), F.lit(slices)).alias("slice"), F.col("user_id").cast("long").alias("user_id"), "ts", F.unix_micros("ts").alias("at"))
        out = rows.groupBy("slice").transformWithStateInPandas(Sessions(gap_minutes * 60_000_000), "start long, user_id long, n long", "append", "EventTime")
        return out.select(F.timestamp_micros("start").cast("timestamp_ntz").alias("start"), "user_id", "n")

    return plan
