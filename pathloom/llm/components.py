"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def _forest(links: DataFrame) -> DataFrame:
    """(a, b): each node of a bounded link table with the least node it reaches, by union-find in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}

        def find(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field(0).type
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = find(a), find(b)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(x, find(x)) for x in parent]
        for k in range(0, len(rows), 100_000):
            step = [r for r in rows[k : k + 100_000] if r[0] != r[1]]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in step], kind), pa.array([r for _, r in step], kind)], names=["a", "b"])

    return links.repartition(1).mapInArrow(run, links.schema)


def components(links: DataFrame, scratch: Scratch, max_rounds: int = 60, task_links: int = 500_000) -> DataFrame:
    """(node, root): the least node that each linked node reaches, from links (a, b) over any ordered type.

    Distinct links are counted first.  Up to ``task_links`` of them one task holds (about 100 MB) and joins by union-find.  Beyond that, large-star and small-star rounds
    alternate: each is two aggregations and joins on the nodes, whose results are written to the shared folder, and nothing is gathered by node, so a node with any number of
    links is spread by the join's skew handling.  The number of rounds grows with the logarithm of the longest shortest path, squared at worst.  Null ends and loops are ignored.
    """
    edges = scratch.table(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "cc-0"
    )
    rooted = lambda e: e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(e.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root")))
    if edges.count() <= task_links:
        return rooted(scratch.table(_forest(edges), "cc-forest"))
    before = None
    for k in range(1, max_rounds + 1):
        # large star: what is greater than a node goes to the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        # small star: what is smaller than a node, and the node itself, go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select("a", F.col("m").alias("b")).unionByName(small.select(F.col("b").alias("a"), F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        edges = scratch.table(small, f"cc-{k}")
        scratch.drop(f"cc-{k - 1}")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return rooted(edges)
        before = state
    raise RuntimeError(f"no stable components after {max_rounds} rounds")
