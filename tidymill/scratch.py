"""Tables written on the way, in the folder that all machines of the cluster share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import Executor, Future

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, or by ``setCheckpointDir``.

    Only a local session with neither gets a temporary folder of this machine.
    """
    context = spark.sparkContext
    folder = (
        spark.conf.get("spark.checkpoint.dir", None)
        or context.getConf().get("spark.checkpoint.dir")
        or context.getCheckpointDir()
    )
    if folder:
        return folder.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="tidymill-"))
    return context.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing there yet."""
    return f"{scratch_dir(spark)}/tidymill-{label}-{uuid.uuid4().hex}"


def write_out(df: DataFrame, label: str) -> DataFrame:
    """Write the table once and go on from the files.

    This cuts the lineage, survives lost executors, and fixes values that would otherwise be
    computed anew by each later job (range boundaries, row numbers). The files stay columnar,
    so later reads still prune columns and skip row groups.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_background(pool: Executor, spark: SparkSession, make: Callable[[], DataFrame]) -> Future:
    """Run jobs beside others of this driver, for steps that do not need one another."""
    return pool.submit(inheritable_thread_target(spark)(make))
