"""Session settings that the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "quarry", cores: str | int | None = None) -> SparkSession:
    """A local session unless one runs already: UTC, adaptive execution, and partitions to match the cores."""
    cores = str(cores or os.environ.get("BENCH_CPUS") or "*")
    partitions = cores if cores.isdigit() else str(os.cpu_count() or 8)
    spark = (
        SparkSession.builder.appName(name)
        .master(f"local[{cores}]")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", os.environ.get("QUARRY_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
