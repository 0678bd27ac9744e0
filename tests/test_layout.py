"""Large rounds: bucketed copies of known facts, and vertices of very many facts."""

import pytest
from pyspark.sql import functions as F

from pathloom.functions.annotations import REACH, k_least
from pathloom.operators import fixpoint
from pathloom.operators.fixpoint import Scratch, Strategy
from pathloom.operators.layout import Layouts, heavy, salted
from pathloom.query import PathQuery
from pathloom.sources.graphs import Graph

#: every round is large, every table bucketed
LARGE = Strategy(local_edges=0, broadcast_bytes=0, direct_facts=0, bucket_rows=1)


def rows(df):
    return sorted(map(tuple, df.collect()))


def graph(spark, edges):
    return Graph.from_frame(spark.createDataFrame(edges, "src long, label string, dst long"))


def hub_edges(n):
    """``n`` edges into vertex 0 and out of it, nested once more, a loop that runs through one of them, repeated rows."""
    around = [(1000 + i, "a", 0) for i in range(n)] + [(0, "b", 2000 + i) for i in range(n)]
    return around + [(1, "a", 1000), (1, "a", 1001), (2000, "b", 2), (2, "a", 1002)] + around[:3]


@pytest.mark.parametrize(("language", "heavy_rows"), [("S -> a S b | a b", 7), ("S -> S S | a b", 65_536)])
def test_large_rounds_agree(spark, language, heavy_rows):
    g = graph(spark, hub_edges(12))
    strategy = Strategy(local_edges=0, broadcast_bytes=0, direct_facts=0, bucket_rows=20, heavy_rows=heavy_rows)
    assert rows(PathQuery(g, language, strategy=strategy).reach()) == rows(PathQuery(g, language).reach())


def test_large_rounds_with_values(spark):
    g, grammar = graph(spark, hub_edges(9)), "S -> a S b | a b"
    strategy = Strategy(local_edges=0, broadcast_bytes=0, direct_facts=0, bucket_rows=20, heavy_rows=4)
    q, plain = PathQuery(g, grammar, strategy=strategy), PathQuery(g, grammar)
    assert rows(q.shortest()) == rows(plain.shortest())
    assert rows(q.single_path()) == rows(plain.single_path())
    least = lambda x: sorted((r.src, r.dst, tuple(r["values"])) for r in x.annotated(k_least(3)).collect())
    assert least(q) == least(PathQuery(g, grammar, strategy=Strategy(local_edges=0)))


def test_text_vertices_and_nulls(spark):
    edges = spark.createDataFrame([("t", "a", "u"), ("u", "a", "v"), ("v", "b", "w"), ("w", "b", "x"), (None, "a", "u"), ("w", "b", None)], "src string, label string, dst string")
    found = PathQuery(Graph.from_frame(edges), "S -> a S b | a b", strategy=Strategy(local_edges=0, broadcast_bytes=0, direct_facts=0, bucket_rows=2, heavy_rows=1)).reach()
    expected = PathQuery(Graph.from_frame(edges), "S -> a S b | a b", strategy=Strategy(local_edges=0)).reach()
    assert set(map(tuple, found.collect())) == set(map(tuple, expected.collect()))


def test_no_tables_stay(spark):
    before = {t.name for t in spark.catalog.listTables()}
    PathQuery(graph(spark, hub_edges(5)), "S -> a S b | a b", strategy=LARGE).reach().count()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_known_facts_are_not_shuffled(spark):
    """Of the three joins of a large round, only the side of new facts has an exchange."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scratch = Scratch(spark, "plan")
        facts = spark.range(1000).select(F.lit(0).alias("sym"), (F.col("id") % 50).alias("src"), (F.col("id") % 71).alias("dst")).distinct()
        known, delta = scratch.table(facts, "known"), scratch.table(facts.limit(200), "delta")
        with Layouts(scratch, 1_000) as layouts:
            for new_is_left, layout in ((True, "right"), (False, "left")):
                (found,) = fixpoint._large_join((delta, None), layouts.of("known", known, layout, [0]), [(0, 0, 0)], REACH, new_is_left, LARGE, scratch, f"heavy-{layout}")
                plan = found._jdf.queryExecution().executedPlan().toString()
                assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
            seen, _ = layouts.of("known", known, "fact", [0])
            plan = delta.join(seen, fixpoint.KEY, "left_anti")._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_cells_are_bounded(spark):
    """A hub's facts are dealt to cells evenly, and every pair of its in- and out-edges meets once."""
    into = spark.range(800).select(F.lit(0).alias("sym"), F.col("id").alias("src"), F.lit(-1).cast("long").alias("dst"))
    out = spark.range(600).select(F.lit(1).alias("sym"), F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))
    assert rows(heavy(into, "dst", 100)) == [(-1, 800)] and heavy(into, "src", 100).isEmpty()
    split = spark.createDataFrame([(-1, 8, 6)], "v long, __i int, __j int")
    left, right = salted(into, "dst", split, "__i", "__j", "src"), salted(out, "src", split, "__j", "__i", "dst")
    for side in (left, right):
        sizes = [r["count"] for r in side.groupBy("__i", "__j").count().collect()]
        assert len(sizes) == 48 and max(sizes) < 150
    met = left.alias("l").join(right.alias("r"), ["__i", "__j"]).groupBy("l.src", "r.dst").count()
    assert met.count() == 480_000 and met.where("count > 1").isEmpty()
