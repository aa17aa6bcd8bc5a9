"""Queries of streams and of functions of one's own."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidora.plans.base import Tables, query
from evidora.streaming import calls, late


def _stream(t: Tables) -> DataFrame:
    return calls.source(t.spark, t._dir)


@query("st_tumble", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st_tumble(t: Tables) -> DataFrame:
    return calls.drain(calls.tumbling(_stream(t)), "complete")


@query("st_slide", "SELECT time_bucket(INTERVAL 15 MINUTE, ts) - k * INTERVAL 15 MINUTE AS start, event_type, count(*) AS n FROM events, (VALUES (0), (1), (2), (3)) v(k) GROUP BY ALL")
def st_slide(t: Tables) -> DataFrame:
    return calls.drain(calls.tumbling(_stream(t), "1 hour", "15 minutes"), "complete")


@query("st_session", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g) SELECT min(ts) AS start, user_id, count(*) AS n FROM s GROUP BY user_id, sid")
def st_session(t: Tables) -> DataFrame:
    return calls.drain(calls.sessions(_stream(t)), "complete")


@query("st_watermark", "SELECT * FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st_watermark(t: Tables) -> DataFrame:
    """The last windows stay open until the watermark passes them, so they are not in the result."""
    return calls.drain(calls.daily(_stream(t)), "append")


@query("st_dedup", "SELECT DISTINCT event_id, user_id FROM events")
def st_dedup(t: Tables) -> DataFrame:
    s = _stream(t)
    return calls.drain(calls.deduplicated(s.unionByName(s)).select("event_id", "user_id"), "append")


@query("st_state", "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY user_id")
def st_state(t: Tables) -> DataFrame:
    """The totals as of the last batch in which a user has calls."""
    out = calls.drain(calls.running(_stream(t)), "update")
    return out.groupBy("user_id").agg(F.max(F.struct("n", "total")).alias("x")).select("user_id", "x.n", F.round("x.total", 4).alias("total"))


@query("st_enrich", "SELECT event_id, c_mktsegment AS segment FROM events JOIN customer ON c_custkey = user_id")
def st_enrich(t: Tables) -> DataFrame:
    static = t.customer.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return calls.drain(_stream(t).join(static, "user_id").select("event_id", "segment"), "append")


@query("st_late", "WITH b AS (SELECT *, date_trunc('month', arrived_at) AS m, time_bucket(INTERVAL 1 DAY, ts) AS day FROM clicks WHERE ts IS NOT NULL), w AS (SELECT m, max(max(ts)) OVER (ORDER BY m ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 1 HOUR AS mark FROM b GROUP BY m), kept AS (SELECT b.* FROM b JOIN w USING (m) WHERE mark IS NULL OR day + INTERVAL 1 DAY > mark) SELECT day, kind, n FROM (SELECT day, kind, count(*) AS n FROM kept GROUP BY ALL) WHERE day + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM b)")
def st_late(t: Tables) -> DataFrame:
    """Clicks as they arrived, month by month, in runs on one checkpoint: what comes for a day that an earlier run has closed is dropped."""
    stream = late.Arrivals(t.clicks.schema, late.daily())
    for part in late.months(t.clicks, "arrived_at"):
        stream.run(part)
    return stream.result(t.spark)


@query("st_session_timers", "WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g), x AS (SELECT min(ts) AS start, max(ts) AS last, user_id, count(*) AS n FROM s GROUP BY user_id, sid) SELECT start, user_id, n FROM x WHERE last + INTERVAL 30 MINUTE < (SELECT max(ts) - INTERVAL 1 HOUR FROM events)")
def st_session_timers(t: Tables) -> DataFrame:
    """Sessions as state of our own, closed by timers, in two runs: those that are open at the end of the first go on in the second."""
    stream = late.Arrivals(t.events.schema, late.timed_sessions())
    first = F.dayofmonth("ts") <= 15
    stream.run(t.events.where(first))
    stream.run(t.events.where(~first))
    return stream.result(t.spark)


@query("udf_scalar", "SELECT doc_id, length(text) - length(replace(text, ' ', ''))::BIGINT AS n_spaces FROM documents")
def udf_scalar(t: Tables) -> DataFrame:
    @F.pandas_udf("long")
    def spaces(s: pd.Series) -> pd.Series:
        return s.str.count(" ")

    return t.documents.select("doc_id", spaces("text").alias("n_spaces"))


@query("udaf_pandas", "SELECT event_type, median(value) AS mid FROM events GROUP BY event_type")
def udaf_pandas(t: Tables) -> DataFrame:
    @F.pandas_udf("double")
    def mid(s: pd.Series) -> float:
        return float(s.median())

    return t.events.groupBy("event_type").agg(mid("value").alias("mid"))


@query("udtf_chunk", "SELECT doc_id, i::BIGINT AS i, substr(source, i + 1, 2) AS part FROM documents, (VALUES (0), (2), (4)) v(i) WHERE i < length(source)")
def udtf_chunk(t: Tables) -> DataFrame:
    @F.udtf(returnType="i long, part string", useArrow=True)
    class Chunks:
        def eval(self, text: str):
            for i in range(0, len(text), 2):
                yield i, text[i : i + 2]

    t.spark.udtf.register("source_chunks", Chunks)
    t.documents.select("doc_id", "source").createOrReplaceTempView("_chunked")
    return t.spark.sql("SELECT doc_id, c.i, c.part FROM _chunked, LATERAL source_chunks(source) c")
