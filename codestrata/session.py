"""Session for tests, benchmarks and local exploration."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(app: str = "codestrata", cpus: int | str = "*") -> SparkSession:
    """A local session; on a cluster bring your own with ``spark.checkpoint.dir`` set."""
    partitions = "8" if cpus == "*" else str(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
