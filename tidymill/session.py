"""Session settings the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Adaptive execution picks join strategies by measured sizes, splits hot join partitions and merges
# small ones. The forced skew join also splits a hot key when a later step could have used the
# join's partitioning. Shuffle partitions and memory belong to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
}


def configure(spark: SparkSession) -> SparkSession:
    """Put the settings into a running session."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cpus: int = 8, name: str = "tidymill", memory: str = "12g") -> SparkSession:
    """A session on this machine, for tests and timing."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(name)
    settings = {
        **SETTINGS, "spark.sql.shuffle.partitions": str(cpus), "spark.driver.memory": memory,
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
