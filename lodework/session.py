"""Session construction and the shared scratch folder."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(app: str = "lodework", cpus: str | None = None, partitions: int | None = None) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings their own."""
    cpus = cpus or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.driver.memory", os.environ.get("LODEWORK_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
