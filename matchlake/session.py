"""SparkSession factory used by tests, the bench and the command line."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "matchlake", master: str | None = None, **extra: str) -> SparkSession:
    """A session with UTC, AQE and skew handling on.

    On a cluster the submitter's settings win: nothing here names a machine-local folder.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | extra
    return builder.config(map=conf).getOrCreate()


def local_session(cpus: int | None = None, **extra: str) -> SparkSession:
    """A single-JVM session for tests and the bench."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    conf = {
        "spark.sql.shuffle.partitions": str(n),
        "spark.driver.memory": "12g",
        "spark.driver.host": "127.0.0.1",
    } | extra
    spark = build_session(master=f"local[{n}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    return spark
