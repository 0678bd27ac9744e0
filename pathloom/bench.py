"""Benchmark command: ``python -m pathloom.bench --graph edges.txt --grammar 'S -> a S b | a b' --algo reach --out results``.

Or ``--config pairs.csv`` with columns graph and grammar (paths of files).  Results are appended as CSV in the layout of the algorithm's kind.
"""

from __future__ import annotations

import argparse
import statistics
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators.registry import ALGORITHMS
from .query import PathQuery
from .sources import sinks
from .sources.graphs import Graph

CHUNKS = (1, 2, 4, 8, 16, 32, 50, 100, 500, 1000, 5000, 10000)


def measure(spark: SparkSession, graph: str, grammar: str, algo: str, rounds: int = 5, max_len: int = 5, chunks: tuple[int, ...] = CHUNKS) -> list[tuple]:
    """Rows of the algorithm's CSV layout."""
    kind, run = ALGORITHMS[algo]
    text = Path(grammar).read_text() if Path(grammar).exists() else grammar
    # a query object keeps its facts, so each measurement has one of its own
    fresh = lambda: PathQuery(Graph.from_text(spark, graph), text)
    times, n = [], 0
    if kind in ("index", "singlepaths"):
        for _ in range(rounds):
            q = fresh()
            began = time.perf_counter()
            found = run(q)
            n = found.count()
            times.append(time.perf_counter() - began)
        if kind == "singlepaths":
            return [(graph, grammar, r["length"], statistics.fmean(times)) for r in found.groupBy("length").count().collect()]
        return [(graph, grammar, statistics.fmean(times), n, statistics.variance(times) if rounds > 1 else None)]
    if kind == "allpaths":
        q = fresh()
        began = time.perf_counter()
        n = run(q, q.reach(), max_len).agg(F.sum("n_paths")).first()[0] or 0
        return [(graph, grammar, n, time.perf_counter() - began)]
    rows, size = [], fresh().graph.vertex_count()
    for chunk in [c for c in chunks if c < size] + [size]:
        for k in range(0, size, chunk):
            q = fresh()
            began = time.perf_counter()
            n = run(q, spark.range(k, min(k + chunk, size)).toDF("v")).count()
            rows.append((graph, grammar, chunk, time.perf_counter() - began, n))
    return rows


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("--graph")
    p.add_argument("--grammar")
    p.add_argument("--config")
    p.add_argument("--algo", default="reach", choices=sorted(ALGORITHMS))
    p.add_argument("--rounds", type=int, default=5)
    p.add_argument("--max-len", type=int, default=5)
    p.add_argument("--out", default="results")
    a = p.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.config:
        pairs = [(r["graph"], g) for r in sinks.read_config(spark, a.config).collect() for g in r["grammars"]]
    elif a.graph and a.grammar:
        pairs = [(a.graph, a.grammar)]
    else:
        p.error("--config, or --graph and --grammar")
    kind = ALGORITHMS[a.algo][0]
    for graph, grammar in pairs:
        rows = measure(spark, graph, grammar, a.algo, a.rounds, a.max_len)
        sinks.append_csv(spark.createDataFrame(rows, ", ".join(f"{c} {t}" for c, t in zip(sinks.LAYOUTS[kind], {"index": ("string", "string", "double", "long", "double"), "allpaths": ("string", "string", "long", "double"), "singlepaths": ("string", "string", "long", "double"), "msindex": ("string", "string", "long", "double", "long")}[kind]))), a.out, kind)


if __name__ == "__main__":
    main()
