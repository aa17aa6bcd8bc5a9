"""The request log as a data source: round trips, commits, failures."""

import os

import pytest
from pyspark.sql import functions as F

from evidora.sources import requests


@pytest.fixture(scope="module")
def log(spark):
    spark.dataSource.register(requests.RequestLog)
    rows = [("2024-01-01T00:00:00", f"r{i}", ["ok", "error", None][i % 3], None if i % 7 == 0 else i / 3, [None, "", "a b = c", "x\\n y\nz\r", "-", "\\N"][i % 6]) for i in range(500)]
    return spark.createDataFrame(rows, requests.SCHEMA).repartition(5)


def read(spark, path):
    return sorted(map(tuple, spark.read.format("request_log").load(path).collect()), key=str)


def test_round_trip(spark, log, tmp_path):
    path = str(tmp_path / "log")
    expected = sorted(map(tuple, log.collect()), key=str)
    log.write.format("request_log").mode("append").save(path)
    assert read(spark, path) == expected
    log.write.format("request_log").mode("append").save(path)
    assert read(spark, path) == sorted(expected * 2, key=str)
    log.where("status = 'ok'").write.format("request_log").mode("overwrite").save(path)
    assert read(spark, path) == [r for r in expected if r[2] == "ok"]
    assert spark.read.format("request_log").load(path).where("request_id = 'r3'").count() == 1


def test_only_what_is_committed_is_read(spark, log, tmp_path):
    path = str(tmp_path / "log")
    log.write.format("request_log").mode("append").save(path)
    with open(os.path.join(path, "part-of-a-lost-task.log"), "w") as f:
        f.write("half a li")
    assert len(read(spark, path)) == 500
    bad = log.withColumn("latency_ms", F.when(F.col("request_id") == "r77", F.raise_error(F.lit("stop"))).otherwise(F.col("latency_ms")))
    with pytest.raises(Exception, match="stop"):
        bad.write.format("request_log").mode("append").save(path)
    assert len(read(spark, path)) == 500


def test_missing_and_broken(spark, log, tmp_path):
    with pytest.raises(Exception):
        read(spark, str(tmp_path / "none"))
    path = str(tmp_path / "log")
    log.limit(0).write.format("request_log").mode("append").save(path)
    assert read(spark, path) == []
    log.limit(3).coalesce(1).write.format("request_log").mode("append").save(path)
    name = next(n for n in os.listdir(path) if n.endswith(".log") and os.path.getsize(os.path.join(path, n)))
    with open(os.path.join(path, name), "a") as f:
        f.write("not a request\n")
    with pytest.raises(Exception, match="no request line"):
        read(spark, path)
