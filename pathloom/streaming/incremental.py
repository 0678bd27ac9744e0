"""Reachability under inserted edges: each micro-batch of edges adds the pairs that it makes possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.annotations import REACH
from ..operators.fixpoint import Strategy, solve
from ..operators.rounds import Scratch
from ..query import PathQuery, parse
from ..sources.graphs import Graph


class ReachView:
    """Keeps the pairs of a language over all edges that came; ``apply`` takes a batch, and ``start`` a stream of them.

    The state lies in the folder ``path``, on storage that all executors share: what a batch adds to the edges, facts and pairs, under its number, and a mark once all of
    that is written.  A batch without mark counts as not applied and is written anew, one with a mark is skipped.  So a view that is made again on the same
    folder, after any failure, goes on where the last one ended.  A batch writes what it adds; once there are more than ``MOST`` folders, the last ones that are small next
    to what came before are merged into one, named by its first and last batch.  It counts once Spark has marked it complete, and the folders it replaces are deleted at the merge after
    that, so a frame that was read before a batch outlives it.  Folders stay few and each row is rewritten a logarithmic number of times.

    With ``part`` the parts that got edges are solved anew, each in one task while it is small; without, the new edges' facts start rounds over those known.
    Insertions only: a pair stays once it is there.
    """

    MOST = 8

    def __init__(self, spark: SparkSession, language: str, path: str, part: str | None = None, strategy: Strategy = Strategy()):
        self.spark, self.language, self.path, self.part, self.strategy = spark, parse(language), path.rstrip("/"), part, strategy
        self.program = self.language.compile(self.language.start)
        folder, fs = self._fs("marks")
        self.last = max((int(f.getPath().getName()) for f in fs.listStatus(folder)), default=-1) if fs.exists(folder) else -1

    def _fs(self, name: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _folders(self, name: str) -> tuple[list[tuple[int, int, str]], list[str]]:
        """(first batch, last batch, folder) of what the marked batches added, in order, and the folders that merged ones replace."""
        folder, fs = self._fs(name)
        found = []
        for f in fs.listStatus(folder) if fs.exists(folder) else ():
            own = f.getPath().getName()
            first, _, last = own.partition("_")
            if int(last or first) <= self.last and (not last or fs.exists(self._fs(f"{name}/{own}/_SUCCESS")[0])):
                found.append((int(first), int(last or first), own))
        kept, gone = [], []
        for x in sorted(found, key=lambda x: (x[0], -x[1])):
            if kept and x[1] <= kept[-1][1]:
                gone.append(x[2])
            else:
                kept.append(x)
        return kept, gone

    def _read(self, name: str) -> DataFrame | None:
        """What the marked batches added; None before any has."""
        own, _ = self._folders(name)
        return self.spark.read.parquet(*(f"{self.path}/{name}/{n}" for _, _, n in own)) if own else None

    def _merge(self, name: str) -> None:
        own, gone = self._folders(name)
        if len(own) <= self.MOST:
            return
        for n in gone:
            where, fs = self._fs(f"{name}/{n}")
            fs.delete(where, True)
        _, fs = self._fs(name)
        size = [fs.getContentSummary(self._fs(f"{name}/{n}")[0]).getLength() for _, _, n in own]
        k = len(own) - 1
        while k and size[k - 1] <= 2 * sum(size[k:]):
            k -= 1
        if k < len(own) - 1:
            merged = self.spark.read.parquet(*(f"{self.path}/{name}/{n}" for _, _, n in own[k:]))
            merged.coalesce(max(1, sum(size[k:]) >> 27)).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/{own[k][0]}_{own[-1][1]}")

    def _add(self, df: DataFrame, name: str, batch_id: int) -> DataFrame:
        where = f"{self.path}/{name}/{batch_id}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    @property
    def edges(self) -> DataFrame | None:
        return self._read("edges")

    @property
    def pairs(self) -> DataFrame | None:
        """(src, dst) of all pairs so far; vertices without edges have no empty walk."""
        return self._read("pairs")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.last:
            return
        columns = ["src", "label", "dst", *([self.part] if self.part else [])]
        old, pairs = self.edges, self.pairs
        new = batch.select(*columns).where(F.col("src").isNotNull() & F.col("label").isNotNull() & F.col("dst").isNotNull()).distinct()
        if old is not None:
            same = [old[c].eqNullSafe(new[c]) for c in columns]
            new = new.join(old, same, "left_anti")
        new = self._add(new, "edges", batch_id)
        fresh = self._of_parts(new, old) if self.part else self._of_facts(new, batch_id)
        if pairs is not None:
            fresh = fresh.join(pairs, ["src", "dst"], "left_anti")
        self._add(fresh.select("src", "dst").distinct(), "pairs", batch_id)
        mark, fs = self._fs(f"marks/{batch_id}")
        fs.create(mark, True).close()
        self.last = batch_id
        folder, fs = self._fs("marks")
        for n in sorted(int(f.getPath().getName()) for f in fs.listStatus(folder))[:-2]:
            fs.delete(self._fs(f"marks/{n}")[0], False)
        for name in ("edges", "facts", "pairs"):
            self._merge(name)

    def _of_parts(self, new: DataFrame, old: DataFrame | None) -> DataFrame:
        """All pairs of the parts that got edges."""
        touched = new.select(F.col(self.part).alias("touched")).distinct()
        every = new if old is None else new.unionByName(old.join(touched, old[self.part].eqNullSafe(touched["touched"]), "left_semi"))
        return PathQuery(Graph.from_frame(every, part=self.part), self.language, strategy=self.strategy).reach()

    def _of_facts(self, new: DataFrame, batch_id: int) -> DataFrame:
        """The pairs that the new edges add, from the facts kept so far."""
        known = self._read("facts")
        edges = new.select("src", "label", "dst").where(F.col("label").isin(self.program.labels)) if self.program.labels else new.where(F.lit(False))
        scratch = Scratch(self.spark, "view")
        facts = self._add(solve(edges, self.program, REACH, None, self.strategy, scratch, known=known), "facts", batch_id)
        scratch.drop("")
        sym = self.program.start
        found = facts.where(F.col("sym") == sym).select("src", "dst")
        if sym in self.program.nullable:
            ends = new.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
            found = found.unionByName(ends.select("src", F.col("src").alias("dst")))
        return found

    def start(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """``stream`` is a streaming DataFrame of (src, label, dst and the part); its checkpoint belongs to this view's folder and to no other."""
        return stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
