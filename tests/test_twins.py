"""Results by classes of vertices with the same edges against the same queries without."""

import random

import pytest
from pyspark.sql import functions as F

from pathloom.functions.annotations import k_least
from pathloom.operators import product, twins
from pathloom.operators.fixpoint import Strategy
from pathloom.operators.rounds import Scratch
from pathloom.query import PathQuery
from pathloom.sources.graphs import Graph

PLAIN = Strategy(twin_edges=10**9)
#: no task solves the graph, but one does solve that of its classes
CLASSES = Strategy(local_edges=40, twin_edges=1)


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()))


@pytest.fixture(scope="module")
def graph(spark):
    """Two levels of places with inverse edges, a clique of twins with loops, an odd vertex, repeated rows."""
    rng = random.Random(7)
    e = [(k, "in", 100 + k % 3) for k in range(17)] + [(100 + k, "in", 200) for k in range(3)]
    e += [(d, "in_r", s) for s, _, d in e]
    e += [(x, "a", y) for x in (300, 301, 302, 303, 304) for y in (300, 301, 302, 303, 304)] + [(300 + k, "in", 200) for k in range(5)]
    e += [(400, "in", 100), (400, "a", 401), (401, "in", 200)]
    e += e[:9]
    rng.shuffle(e)
    return Graph.from_frame(spark.createDataFrame(e, "src long, label string, dst long"))


def test_classes_are_found_and_none_where_they_bring_nothing(spark, graph):
    t = twins.twins(graph.edges, Scratch(spark, "t"), 1)
    assert sorted(r["n"] for r in t.sizes.collect()) == [5, 5, 6, 6]
    chain = spark.range(50).select(F.col("id").alias("src"), F.lit("a").alias("label"), (F.col("id") + 1).alias("dst"))
    assert twins.twins(chain, Scratch(spark, "t"), 1) is None
    assert twins.twins(graph.edges, Scratch(spark, "t"), 10**6) is None


def test_equal_hashes_are_no_twins(spark, graph, monkeypatch):
    monkeypatch.setattr(twins.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    assert twins.twins(graph.edges, Scratch(spark, "t"), 1) is None


@pytest.mark.parametrize("language", ["S -> in S in_r | in in_r", "S -> S S | in in_r |", "( in in_r ) +", "( in in_r ) *", "in in_r in in_r", "a + in in_r"])
def test_pairs_by_classes(spark, graph, language):
    one, two = (PathQuery(graph, language, strategy=s) for s in (PLAIN, CLASSES))
    assert two._by_classes(two.program().labels)
    assert rows(one.reach()) == rows(two.reach())
    assert rows(one.shortest()) == rows(two.shortest())
    sources = spark.createDataFrame([(0,), (3,), (5,), (101,), (302,), (None,), (999,)], "v int")
    assert rows(one.from_sources(sources)) == rows(two.from_sources(sources))


def test_annotations_by_classes(spark, graph):
    one, two = (PathQuery(graph, "S -> S S | in in_r | a", strategy=s) for s in (PLAIN, CLASSES))
    assert rows(one.annotated(k_least(3))) == rows(two.annotated(k_least(3)))


@pytest.mark.parametrize("language", ["in in_r in in_r", "( in in_r ) *", "a + in"])
def test_walks_by_classes(spark, graph, language):
    one, two = (PathQuery(graph, language, strategy=s) for s in (PLAIN, CLASSES))
    pairs = one.reach()
    assert rows(one.count_paths(pairs, 5)) == rows(two.count_paths(None, 5)) == rows(one.count_paths(None, 5))
    assert rows(one.count_derivations(pairs, 5)) == rows(two.count_derivations(None, 5))
    walks = lambda df: sorted(map(repr, df.select("src", "dst", "length", "path").collect()))
    assert walks(one.all_paths(pairs, 5)) == walks(two.all_paths(None, 5)) == walks(one.all_paths(None, 5))


def test_steps_by_classes(graph):
    e = graph.edges
    assert rows(product.step_pairs(e, e, CLASSES)) == rows(product.step_pairs(e, e, PLAIN))


def test_pairs_of_classes_are_not_derived_or_compared(spark):
    """Pairs of members appear as the result is read: no round, shuffle or table has them."""
    star = spark.range(3000).select(F.col("id").alias("src"), F.lit("in").alias("label"), F.lit(-1).cast("long").alias("dst"))
    edges = star.unionByName(star.select(F.col("dst").alias("src"), F.lit("in_r").alias("label"), F.col("src").alias("dst")))
    found = PathQuery(Graph.from_frame(edges), "S -> in S in_r | in in_r", strategy=Strategy(local_edges=0)).reach()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "Aggregate" not in plan
    assert found.count() == 9_000_000


def test_least_sums_in_a_task(spark, graph, monkeypatch):
    """Several least lengths of a small graph take no distributed round, unless they outgrow the task."""
    import pathloom.query

    asked = lambda **s: rows(PathQuery(graph, "S -> S S | in in_r | in a | ", strategy=Strategy(twin_edges=10**9, **s)).annotated(k_least(3)))
    far = asked(local_edges=0)
    assert far == asked(local_facts=500)
    parts = [(k // 4, k, "a", (k // 4) * 4 + (k + 1) % 4) for k in range(12)] + [(None, 20, "a", 21), (None, 21, "a", 20)]
    parts = Graph.from_frame(spark.createDataFrame(parts, "part int, src long, label string, dst long"), part="part")
    cycles = lambda **s: rows(PathQuery(parts, "S -> S S | a", strategy=Strategy(**s)).annotated(k_least(2)))
    want = cycles(local_edges=0)
    monkeypatch.setattr(pathloom.query, "solve", lambda *a, **b: pytest.fail("a distributed round"))
    assert far == asked()
    assert want == cycles()


@pytest.mark.parametrize("ask", ["reach", "catalogue", "rounds", "shortest", "regular", "sources"])
def test_classes_come_before_tasks(spark, ask):
    """Twins that one task might solve are classes first: few edges may have more pairs than a task makes."""
    from pathloom.plans import catalog

    e = [(k, "in", 100 + k % 3) for k in range(30)] + [(100 + k, "in", 200) for k in range(3)]
    g = Graph.from_frame(spark.createDataFrame(e + [(d, "in_r", s) for s, _, d in e], "src long, label string, dst long"))
    language = {"catalogue": catalog.grammar("binomial", "sg"), "regular": "( in in_r ) +"}.get(ask, "S -> in S in_r | in in_r")
    q = PathQuery(g, language, strategy=Strategy(twin_edges=1, **({"local_edges": 0} if ask == "rounds" else {})))
    found = q.shortest() if ask == "shortest" else q.from_sources(spark.createDataFrame([(1,), (101,)], "v long")) if ask == "sources" else q.reach()
    assert "Generate explode" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(x, y): 2 if x % 3 == y % 3 else 4 for x in range(30) for y in range(30)} | {(x, y): 2 for x in (100, 101, 102) for y in (100, 101, 102)}
    if ask == "regular":
        want = {p: 2 for p, n in want.items() if n == 2}
    if ask == "sources":
        want = {p: n for p, n in want.items() if p[0] in (1, 101)}
    assert sorted(map(tuple, found.collect())) == sorted((*p, n) if ask == "shortest" else p for p, n in want.items())


def test_few_sources_are_dealt_by_themselves(spark, monkeypatch):
    """Tasks and lists are as many as the asked sources take, not as all members of their classes would."""
    monkeypatch.setattr(twins, "CHUNK", 16)
    monkeypatch.setattr(twins, "TASK_ROWS", 100)
    e = [(k, "in", -1) for k in range(200)] + [(-1, "in_r", k) for k in range(200)]
    t = twins.twins(Graph.from_frame(spark.createDataFrame(e, "src long, label string, dst long")).edges, Scratch(spark, "t"), 1)
    found = spark.createDataFrame([(0, 0)], "src long, dst long")
    sources = spark.createDataFrame([(25 * k,) for k in range(8)] + [(None,), (-1,), (999,)], "v int")
    out = t.expanded(found, sources=sources)
    assert out.rdd.getNumPartitions() == 17
    assert rows(out) == rows(spark.createDataFrame([(25 * k, y) for k in range(8) for y in range(200)], "src long, dst long"))
    assert spark.read.parquet(t.scratch.path("sources")).where("size(members) > 1").count() == 1


def test_a_counted_graph_is_not_written_again_for_its_task(spark, graph, monkeypatch):
    """The graph of classes is a table and was counted as it was made, so the task that solves it reads it there."""
    names, write = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: names.append(name) or write(self, df, name))
    same = "S -> in S in_r | in in_r"
    found = PathQuery(graph, same, strategy=CLASSES).reach()
    assert "local" in names and "parts" not in names
    outgrown = PathQuery(graph, same, strategy=Strategy(local_edges=40, twin_edges=1, local_facts=5)).reach()
    assert "round-0" in names and "parts" not in names
    assert rows(found) == rows(outgrown) == rows(PathQuery(graph, same, strategy=PLAIN).reach())
