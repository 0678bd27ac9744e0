"""Intermediate tables in the folder that every executor and the driver share."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

from ..operators.rounds import Scratch, shared_root  # noqa: F401


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished jobs."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def small_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Hold the Arrow batches that go to Python workers to ``size`` bytes: with long texts the default of rows is too much for two tasks an executor."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(key)) or 0) > size:
        spark.conf.set(key, str(size))
