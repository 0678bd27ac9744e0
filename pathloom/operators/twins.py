"""Graphs of twins: vertices with the same edges under every label, in and out, are one.

Twins begin and end the same walks, so a walk of the graph of their classes stands for one of every choice of members, with the same labels and length: what holds of two classes holds of all
pairs of members, and walks are counted by the sizes of the classes they pass.  A place with n suppliers has n * n pairs of suppliers, which no round derives, compares or writes then; they
appear as the result is read.

Classes are found by two 64-bit sums (exclusive or) of hashes of a vertex's edges and then checked exactly: between two classes there must be all edges or none.  Where that fails the graph stays as it is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fixpoint import small_table
from .rounds import Scratch

#: members of a class that a row holds while pairs are made
CHUNK = 512
#: rows of the result that a task makes, about
TASK_ROWS = 4_000_000


@dataclass
class Twins:
    """``edges`` (src, label, dst) between classes, each named by its least member; ``classes`` (rep, n, chunk, members) of those with several members."""

    edges: DataFrame
    classes: DataFrame
    scratch: Scratch
    #: edges between classes
    size: int

    @property
    def sizes(self) -> DataFrame:
        return _sizes(self.classes)

    def names(self, vertices: DataFrame) -> DataFrame:
        """(v): the classes of the vertices of a one-column table."""
        members = self.classes.select("rep", F.explode("members").alias("m"))
        own = vertices.select(F.col(vertices.columns[0]).cast(self.edges.schema["src"].dataType).alias("v"))
        return own.join(members, own["v"] == members["m"], "left").select(F.coalesce("rep", "v").alias("v")).distinct()

    def expanded(self, found: DataFrame, columns: tuple[str, ...] = ("src", "dst"), sources: DataFrame | None = None) -> DataFrame:
        """A row for every choice of members of the classes in ``columns``; nothing is gathered, and classes travel as lists of about ``CHUNK`` members.  Of the first column only ``sources`` if given."""
        classes = dict.fromkeys(columns, self.classes)
        if sources is not None:
            own = sources.select(F.col(sources.columns[0]).cast(self.edges.schema["src"].dataType).alias("v")).where(F.col("v").isNotNull()).distinct()
            each = self.classes.select("rep", F.explode("members").alias("m"))
            own = self.scratch.table(own.join(each, own["v"] == each["m"], "left").select("v", F.coalesce("rep", "v").alias("rep")), "source-classes")
            # their lists are made anew: the few sources of an old one would meet as many lists of the other columns as all its members do
            classes[columns[0]] = self.scratch.table(_lists(own.join(own.groupBy("rep").agg(F.count("*").alias("n")), "rep")), "sources")
            found = found.join(own.select(F.col("rep").alias(columns[0])).distinct(), columns[0], "left_semi")
        rows, total = found, F.lit(1.0)
        for c in columns:
            own = _sizes(classes[c]).select(F.col("rep").alias(c), F.col("n").alias(f"__n_{c}"))
            rows = rows.join(own, c, "left")
            total = total * F.coalesce(f"__n_{c}", F.lit(1))
        n = found.sparkSession.conf.get("spark.sql.shuffle.partitions")
        tasks = max(int(n), int((rows.agg(F.sum(total)).first()[0] or 0) // TASK_ROWS) + 1)
        out = found
        for c in columns:
            own = classes[c].select(F.col("rep").alias(c), F.col("members").alias(f"__m_{c}"))
            out = out.join(own, c, "left").withColumn(f"__m_{c}", F.coalesce(f"__m_{c}", F.array(c)))
        tasks = min(tasks, 20_000)
        out = out.drop(*columns).repartition(tasks)
        for c in columns:
            # compiled into one loop, several lists would make all their rows before one is handed on; the coalesce moves nothing and ends the loop
            out = out.coalesce(tasks).withColumn(c, F.explode(f"__m_{c}")).drop(f"__m_{c}")
        return out.select(*found.columns)


def _sizes(classes: DataFrame) -> DataFrame:
    return classes.groupBy("rep").agg(F.max("n").alias("n"))


def _lists(member: DataFrame) -> DataFrame:
    """(rep, n, chunk, members) of (v, rep, n): a class is cut into lists without being gathered, members are dealt by hash."""
    dealt = member.withColumn("chunk", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / CHUNK)))
    return dealt.groupBy("rep", "n", "chunk").agg(F.collect_list("v").alias("members"))


def twins(edges: DataFrame, scratch: Scratch, least: int) -> Twins | None:
    """The graph's classes, if it has at least ``least`` edges and classes have at most half of them."""
    edges = edges.select("src", "label", "dst").where(F.col("src").isNotNull() & F.col("label").isNotNull() & F.col("dst").isNotNull())
    if edges.limit(least).count() < least:
        return None
    edges = scratch.table(edges.distinct(), "edges")
    ends = F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(0).alias("side"), "label", F.col("dst").alias("w")), F.struct(F.col("dst").alias("v"), F.lit(1).alias("side"), "label", F.col("src").alias("w"))))
    own = edges.select(ends.alias("e")).select("e.*")
    # edges are distinct, so none takes another one out
    total = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "side", "label", "w"))
    signed = own.groupBy("v").agg(F.count("*").alias("d"), total(1).alias("a"), total(2).alias("b"))
    key = ["d", "a", "b"]
    # both sides of the join read one exchange of the sums
    least_of = signed.groupBy(*key).agg(F.min("v").alias("rep"), F.count("*").alias("n")).where("n > 1")
    member = scratch.table(signed.join(least_of, key).select("v", "rep", "n"), "member")
    if member.isEmpty():
        return None
    of = lambda c: member.select(F.col("v").alias(c), F.col("rep").alias(f"{c}_rep"), F.col("n").alias(f"{c}_n"))
    both = edges.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    found = both.groupBy(F.coalesce("src_rep", "src").alias("src"), "label", F.coalesce("dst_rep", "dst").alias("dst")).agg(
        F.count("*").alias("n"), F.first(F.coalesce("src_n", F.lit(1)) * F.coalesce("dst_n", F.lit(1))).alias("all")
    )
    found = scratch.table(found, "classes-edges")
    seen = found.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum((F.col("n") != F.col("all")).cast("int")).alias("bad")).first()
    if seen["bad"] or 2 * seen["k"] > seen["n"]:
        return None
    classes = scratch.table(_lists(member), "classes")
    return Twins(found.select("src", "label", "dst"), classes, scratch, seen["k"])


def live(edges: DataFrame, moves: list[tuple[int, str, int]], finals: list[int], most: int, scratch: Scratch) -> list[DataFrame]:
    """Of each number of steps k below ``most``, the (q, v) from which a walk of exactly k steps ends in a final state."""
    table = F.broadcast(small_table(edges.sparkSession, moves, "q int, label string, q2 int"))
    ends = edges.select(F.col("dst").alias("v")).distinct()
    out = [scratch.table(ends.select(F.explode(F.array(*(F.lit(q).cast("int") for q in finals))).alias("q"), "v"), "live-0")]
    step = edges.join(table, "label").select("q", F.col("src").alias("v"), "q2", F.col("dst").alias("v2"))
    for k in range(1, most):
        after = out[-1].select(F.col("q").alias("q2"), F.col("v").alias("v2"))
        out.append(scratch.table(step.join(after, ["q2", "v2"]).select("q", "v").distinct(), f"live-{k}"))
    return out


def class_walks(t: Twins, moves: list[tuple[int, str, int]], start: int, finals: list[int], max_len: int, scratch: Scratch) -> list[tuple[int, DataFrame]]:
    """(n, table (v0, label1, v1, ..., vn)): the walks of n steps between classes that a deterministic automaton accepts, which are distinct as its runs are; only prefixes of accepted walks are made."""
    if max_len < 2 or not moves:
        return []
    table = F.broadcast(small_table(t.edges.sparkSession, moves, "q int, label string, q2 int"))
    ahead, out = live(t.edges, moves, finals, max_len, scratch), []
    step = t.edges.join(table, "label")
    for n in range(1, max_len):
        now = step.where(F.col("q") == start).select(F.col("src").alias("v0"), F.col("label").alias("label1"), F.col("dst").alias("v1"), F.col("q2").alias("q"))
        for k in range(1, n + 1):
            if k > 1:
                more = step.select("q", F.col("src").alias(f"v{k - 1}"), F.col("label").alias(f"label{k}"), F.col("dst").alias(f"v{k}"), "q2")
                now = now.join(more, ["q", f"v{k - 1}"]).drop("q").withColumnRenamed("q2", "q")
            now = now.join(ahead[n - k].withColumnRenamed("v", f"v{k}"), ["q", f"v{k}"], "left_semi")
        table_n = scratch.table(now.drop("q"), f"class-walks-{n}")
        if not table_n.isEmpty():
            out.append((n, table_n))
    return out
