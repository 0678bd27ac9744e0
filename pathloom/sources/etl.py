"""From raw relations to labelled edges: short labels, inverse edges, dense ids, chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_inverse(edges: DataFrame, suffix: str = "_r") -> DataFrame:
    """Each edge and its inverse under the label with the suffix: one pass, no shuffle."""
    both = F.array(F.struct("src", "label", "dst"), F.struct(F.col("dst").alias("src"), F.concat("label", F.lit(suffix)).alias("label"), F.col("src").alias("dst")))
    return edges.select(F.explode(both).alias("e")).select("e.*")


def mapped(edges: DataFrame, labels: dict[str, str], other: str | None = None) -> DataFrame:
    """Labels replaced by their short names; edges of other labels are dropped, or get ``other``."""
    rows = edges.sparkSession.createDataFrame(list(labels.items()), "label string, short string")
    found = edges.join(F.broadcast(rows), "label", "inner" if other is None else "left")
    return found.select("src", F.coalesce("short", F.lit(other)).alias("label"), "dst") if other else found.select("src", F.col("short").alias("label"), "dst")


def dense_ids(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges over 0..n-1, dictionary (name, id)).

    Ids come from sorted range partitions and their counts, not from one global window.
    """
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct().orderBy("name")
    ids = _numbered(names)
    a, b = ids.select(F.col("name").alias("src"), F.col("id").alias("s")), ids.select(F.col("name").alias("dst"), F.col("id").alias("d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("s").alias("src"), "label", F.col("d").alias("dst")), ids


def _numbered(names: DataFrame) -> DataFrame:
    from ..operators.rounds import Scratch

    held = Scratch(names.sparkSession, "dictionary").table(names.withColumns({"p": F.spark_partition_id(), "i": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "names")
    counts = held.groupBy("p").agg(F.count("*").alias("n"))
    # one row a partition
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return held.join(F.broadcast(before.select("p", "before")), "p").select("name", (F.col("before") + F.col("i")).alias("id"))


def chain(rows: DataFrame, by: str, order: list[str], vertex: str | Column, label: str, part: bool = True, hot_rows: int | None = None) -> DataFrame:
    """Edges from each row to the next of its group; the label is the source row's.  ``part`` keeps the group, which no walk crosses.

    A group is sorted in one task, unless ``hot_rows`` is given: then groups are counted, and one of more rows is dealt out by ranges of its order and sorted range by range.
    """
    v = F.col(vertex) if isinstance(vertex, str) else vertex
    own = rows.select(v.alias("src"), F.col(label).alias("label"), F.col(by).alias("part"), *(F.col(c).alias(f"o{k}") for k, c in enumerate(order)))
    sort = [f"o{k}" for k in range(len(order))]
    columns = ["src", "label", "dst", *(["part"] if part else [])]
    plain = own
    if hot_rows is not None:
        hot = own.groupBy("part").count().where(F.col("count") > hot_rows).select(F.col("part").alias("hot"))
        plain = own.join(hot, own["part"].eqNullSafe(hot["hot"]), "left_anti")
    out = plain.withColumn("dst", F.lead("src").over(Window.partitionBy("part").orderBy(*sort))).where(F.col("dst").isNotNull()).select(*columns)
    if hot_rows is None:
        return out
    from ..operators.rounds import Scratch

    # the range of a row is written down, so it is the same for all that read it
    large = own.join(hot, own["part"].eqNullSafe(hot["hot"]), "left_semi").repartitionByRange("part", *sort)
    held = Scratch(rows.sparkSession, "chain").table(large.withColumn("range", F.spark_partition_id()), "ranges")
    ranged = held.withColumn("dst", F.lead("src").over(Window.partitionBy("part", "range").orderBy(*sort)))
    # one row for each range of a group: where the next one begins
    first = held.groupBy("part", "range").agg(F.min_by("src", F.struct(*sort)).alias("src"))
    follow = first.select(F.col("part").alias("p"), F.col("range").alias("r"), F.lead("src").over(Window.partitionBy("part").orderBy("range")).alias("begin"))
    joined = ranged.join(follow, ranged["part"].eqNullSafe(follow["p"]) & (ranged["range"] == follow["r"]))
    return out.unionByName(joined.withColumn("dst", F.coalesce("dst", "begin")).where(F.col("dst").isNotNull()).select(*columns))
