"""Result sinks and benchmark configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: columns of the benchmark result files, by kind
LAYOUTS = {
    "index": ("graph", "grammar", "time", "count_S", "variance"),
    "allpaths": ("graph", "grammar", "count_paths", "time"),
    "singlepaths": ("graph", "grammar", "len_path", "time"),
    "msindex": ("graph", "grammar", "size_chunk", "time", "count_S"),
}


def append_csv(df: DataFrame, path: str, layout: str | None = None) -> None:
    """Quoted CSV with header, appended to the folder."""
    out = df.select(*LAYOUTS[layout]) if layout else df
    out.write.mode("append").option("header", True).option("quoteAll", True).csv(path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Text lines ``src dst``."""
    pairs.select(F.concat_ws(" ", F.col("src"), F.col("dst"))).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """(graph, grammars) of a CSV with columns graph and grammar, in either case."""
    rows = spark.read.csv(path, header=True)
    rows = rows.toDF(*(c.strip().lower() for c in rows.columns))
    return rows.groupBy("graph").agg(F.sort_array(F.collect_set("grammar")).alias("grammars"))
