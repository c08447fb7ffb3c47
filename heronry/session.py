"""SparkSession factory used by the tests, the benchmark and the examples."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "heronry", cpus: int | None = None, **conf: str) -> SparkSession:
    """A session with ANSI SQL, UTC, AQE and Arrow on; ``conf`` overrides single settings.

    Under spark-submit the cluster's master, memory and shuffle partitions stay; else the session is local."""
    n = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    local = {"spark.master": f"local[{n}]", "spark.driver.memory": "12g", "spark.sql.shuffle.partitions": str(n)}
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ or "MASTER" in os.environ or "SPARK_REMOTE" in os.environ
    settings = ({} if submitted else local) | {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.appName(app)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
