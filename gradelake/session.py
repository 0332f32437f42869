"""The session that tests, the bench and interactive use share."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(app: str = "gradelake", cores: int | None = None, **conf: str) -> SparkSession:
    """A local session with the settings that results depend on (UTC) and adaptive execution.

    On a cluster, take the session from ``spark-submit`` instead and set the same options.
    """
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    options = {
        "spark.master": f"local[{cores}]",
        "spark.driver.memory": os.environ.get("GRADELAKE_DRIVER_MEMORY", "8g"),
        "spark.sql.shuffle.partitions": str(cores),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.host": "127.0.0.1",
        "spark.driver.bindAddress": "127.0.0.1",
    } | conf
    spark = SparkSession.builder.appName(app).config(map=options).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
