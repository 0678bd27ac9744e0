"""Intermediate tables of iterative queries, in the folder that every executor and the driver share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; where that is unset, one is made here for a single machine, and a cluster fails."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("pathloom.scratch.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is not set; executors of {master or 'a cluster'} need a folder that they all share")
        root = "file://" + tempfile.mkdtemp(prefix="pathloom-")
        spark.conf.set("pathloom.scratch.dir", root)
    return root.rstrip("/")


class Scratch:
    """Names the tables of one operator run and deletes those that are no longer read."""

    def __init__(self, spark: SparkSession, label: str, row_group: int | None = None):
        """``row_group``: bytes that a task holds before it writes them, Parquet's 128 MB by default."""
        self.spark, self.row_group = spark, row_group
        self.root = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
        path, fs = self._fs(self.root)
        fs.mkdirs(path)
        fs.deleteOnExit(path)  # what a result still reads lives as long as the session

    def _fs(self, where: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and read it again: lineage ends here and survives a lost executor."""
        path = self.path(name)
        writer = df.write.mode("overwrite").option("compression", "zstd")
        (writer.option("parquet.block.size", self.row_group) if self.row_group else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, fs = self._fs(self.path(name))
            fs.delete(path, True)

    def drop_all_but(self, *names: str) -> None:
        """Delete every table but these."""
        folder, fs = self._fs(self.root)
        self.drop(*(n for f in fs.listStatus(folder) if (n := f.getPath().getName()) not in names))
