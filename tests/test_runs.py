"""Streams in several runs, and sketches that merge."""

import datetime as dt

from pyspark.sql import functions as F

from evidora.operators import sketches
from evidora.streaming import late

DAY = dt.datetime(2024, 3, 1)
CLICKS = "click_id long, ts timestamp_ntz, kind string"


def at(hours):
    return DAY + dt.timedelta(hours=hours)


def test_late_rows_are_dropped_and_counted(spark):
    stream = late.Arrivals(spark.createDataFrame([], CLICKS).schema, late.daily())
    df = lambda rows: spark.createDataFrame([(i, None if h is None else at(h), k) for i, (h, k) in enumerate(rows)], CLICKS)
    stream.run(df([(1, "a"), (30, "a"), (23.9, "b"), (None, "a")]))  # the watermark comes to hour 29: day one is closed
    assert {(r["day"], r["kind"], r["n"]) for r in stream.result(spark).collect()} == {(DAY, "a", 1), (DAY, "b", 1)} and stream.dropped() == 0
    stream.run(df([(5, "a"), (29, "a"), (28, None), (60, "b")]))  # hour 5 is too late, hours 28 and 29 aren't: their day is open
    got = {(r["day"], r["kind"], r["n"]) for r in stream.result(spark).collect()}
    assert got == {(DAY, "a", 1), (DAY, "b", 1), (at(24), "a", 2), (at(24), None, 1)} and stream.dropped() == 1


def test_queries_late_rows(spark, sf_dir):
    """There are late rows in the given table, and the progress records have them."""
    clicks = spark.read.parquet("/root/testdata/sf0.01/clicks.parquet")
    stream = late.Arrivals(clicks.schema, late.daily())
    parts = list(late.months(clicks, "arrived_at"))
    for part in parts:
        stream.run(part)
    assert len(parts) >= 4 and sum(p.count() for p in parts) == clicks.count() and stream.dropped() > 0


def test_sessions_by_timers(spark):
    schema = "user_id long, ts timestamp_ntz"
    stream = late.Arrivals(spark.createDataFrame([], schema).schema, late.timed_sessions("3 hours"))
    run = lambda rows: stream.run(spark.createDataFrame([(u, at(h)) for u, h in rows], schema))
    run([(1, 1.0), (1, 1.9), (2, 1.0), (None, 1.0), (1, 1.0)])  # two sessions of user 1, all open
    assert stream.result(spark).count() == 0
    run([(1, 1.45), (3, 4.0)])  # joins the two
    run([(2, 9.0), (2, 9.25)])  # the watermark comes to 6.25
    got = {(r["user_id"], r["start"], r["n"]) for r in stream.result(spark).collect()}
    assert got == {(1, at(1), 4), (2, at(1), 1), (3, at(4), 1)}
    run([(2, 5.0), (2, 20)])  # too late for a session, and one that closes the last
    got = {(r["user_id"], r["start"], r["n"]) for r in stream.result(spark).collect()}
    assert (2, at(9), 2) in got and len(got) == 4


def test_sketches_within_their_bounds(spark):
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    stored = sketches.hourly(events)
    for by in ([], ["event_type"]):
        found = sketches.read(sketches.merged(sketches.merged(stored, F.date_trunc("day", "hour").alias("day"), "event_type"), *by), *by).collect()
        for r in found:
            mine = events.where(F.col("event_type") == r["event_type"]) if by else events
            n, users = mine.agg(F.count("*"), F.countDistinct("user_id")).first()
            assert r["n"] == n and abs(r["n_users"] - users) <= 0.05 * users
            for p, q in ((r["p50"], 0.5), (r["p95"], 0.95)):
                low, high = mine.agg(F.avg((F.col("value") < p).cast("double")), F.avg((F.col("value") <= p).cast("double"))).first()
                assert low - 0.0265 <= q <= high + 0.0265


def test_sketches_of_nulls(spark):
    rows = [(at(1), "a", None, None), (at(1), "a", 2.0, 7), (at(2), "b", None, None)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double, user_id long")
    got = {r["event_type"]: (r["n"], r["p50"], r["n_users"]) for r in sketches.read(sketches.merged(sketches.hourly(df), "event_type"), "event_type").collect()}
    assert got == {"a": (2, 2.0, 1), "b": (1, None, 0)}
    assert sketches.merged(sketches.hourly(df.limit(0)), "event_type").count() == 0


def test_sessions_take_few_calls(spark):
    """State and timers cost a call for each slice of the users, not for each user or session."""
    schema = "user_id long, ts timestamp_ntz"
    stream = late.Arrivals(spark.createDataFrame([], schema).schema, late.timed_sessions("1 hour", slices=8))
    stream.run(spark.createDataFrame([(u, at(3.0 * h)) for u in range(40) for h in range(10)], schema))
    got = sorted((r["user_id"], r["start"], r["n"]) for r in stream.result(spark).collect())
    assert got == sorted((u, at(3.0 * h), 1) for u in range(40) for h in range(9))
    rows = max(sum(s["numRowsTotal"] for s in p["stateOperators"]) for p in stream.progress)
    assert rows <= 400 + 4 * 8  # the sessions, and counts and timers of eight slices
