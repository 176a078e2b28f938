"""Sessions of Spark for this library."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, however the driver was started."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if REPO not in paths:
        env["PYTHONPATH"] = os.pathsep.join([REPO, *paths])
    return spark


def local(cpus: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A local session with the settings of the tests and the benchmark."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    for key, value in {"spark.sql.shuffle.partitions": partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.adaptive.enabled": "true"}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ready(spark)
