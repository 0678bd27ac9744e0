"""Facts laid out for large rounds: bucketed by what rounds join on, so that only new facts move, and vertices of very many facts spread over tasks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Scratch

#: layout: its bucket columns; a left part is joined by its end, a right part by its begin, a found fact by all of its key
LAYOUTS = {"left": ["sym", "dst"], "right": ["sym", "src"], "fact": ["sym", "src", "dst"]}


def heavy(table: DataFrame, vertex: str, most: int) -> DataFrame:
    """(v, n): vertices with more than ``most`` facts under one symbol, at most one in ``most`` of the rows; counts are summed before they are shuffled."""
    many = table.where(F.col(vertex).isNotNull()).groupBy("sym", vertex).count().where(F.col("count") > most)
    return many.groupBy(F.col(vertex).alias("v")).agg(F.max("count").alias("n"))


def salted(table: DataFrame, vertex: str, split: DataFrame, own: str, other: str, far: str) -> DataFrame:
    """The facts of ``table`` at the vertices of ``split``: dealt to ``own`` cells by their ``far`` end, one copy for each of the ``other`` side's cells, as (.., own, other)."""
    at = table.join(split.withColumnsRenamed({"v": vertex, own: "__own", other: "__other"}), vertex)
    dealt = at.withColumn(own, F.pmod(F.xxhash64("sym", far), F.col("__own").cast("long")).cast("int"))
    return dealt.withColumn(other, F.explode(F.sequence(F.lit(0), F.col("__other") - 1))).drop("__own", "__other")


class Layouts:
    """Bucketed copies of written tables of facts, made when a large round first needs them and dropped with their table.

    A copy has one file for each bucket, and as many buckets as a shuffle has partitions, so a join shuffles its other side alone.  They are tables of the session's catalogue whose files lie in the
    shared folder; ``close`` removes both.
    """

    def __init__(self, scratch: Scratch, heavy_rows: int):
        self.scratch, self.heavy_rows, self.made = scratch, heavy_rows, {}
        self.buckets = int(scratch.spark.conf.get("spark.sql.shuffle.partitions"))

    def __enter__(self) -> Layouts:
        return self

    def __exit__(self, *_) -> None:
        self.keep([])

    def of(self, name: str, table: DataFrame, layout: str, symbols: list[int]) -> tuple[DataFrame, DataFrame | None]:
        """Facts of ``symbols`` of the written ``table``, the same ones at every call for a layout, and the heavy vertices that they are joined on; None if there are none."""
        columns = LAYOUTS[layout]
        if (name, layout) not in self.made:
            own = f"pathloom_{layout}_{uuid.uuid4().hex}"
            self.made[name, layout] = own, None
            dealt = table.where(F.col("sym").isin(symbols)).repartition(self.buckets, *columns)
            dealt.write.format("parquet").bucketBy(self.buckets, *columns).option("compression", "zstd").option("path", self.scratch.path(own)).saveAsTable(own)
            if layout != "fact":
                self.made[name, layout] = own, self.heavy(self.scratch.spark.table(own), columns[-1], f"{own}-heavy")
        own, many = self.made[name, layout]
        return self.scratch.spark.table(own), many

    def heavy(self, table: DataFrame, vertex: str, name: str) -> DataFrame | None:
        """The heavy vertices of a table, written; None if there are none."""
        many = self.scratch.table(heavy(table, vertex, self.heavy_rows), name)
        return None if many.isEmpty() else many

    def keep(self, names: list[str]) -> None:
        """Drop the copies of all other tables."""
        for name, layout in [key for key in self.made if key[0] not in names]:
            own, _ = self.made.pop((name, layout))
            self.scratch.spark.sql(f"DROP TABLE IF EXISTS {own}")
            self.scratch.drop(own, f"{own}-heavy")
