"""The session that tests, the bench and small runs use."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Adaptive execution on, UTC, Arrow on; unions claim no partitioning, which Spark 4.1 gets wrong. On a cluster the deployment's own settings hold."""
    spark = (
        SparkSession.builder.master(master).appName("evidora")
        .config("spark.sql.unionOutputPartitioning", "false").config("spark.sql.shuffle.partitions", str(partitions)).config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
