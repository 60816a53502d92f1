"""Session settings shared by the bench, the tests and the entry point."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: str | int = "*", memory: str = "8g") -> SparkSession:
    """A local session; on a cluster the submitted settings are used instead."""
    n = 8 if cpus == "*" else int(cpus)
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stanzaflow")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
