import pytest

from pathloom.functions.stats import summarise
from pathloom.plans.automaton import RecursiveAutomaton
from pathloom.plans.catalog import GRAMMARS, grammar
from pathloom.plans.grammar import Grammar
from pathloom.query import PathQuery
from pathloom.sources import etl, graphs, sinks
from pathloom.sources.graphs import Graph


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_triples(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("0 a  1\n 1\tb 4 \n0 a 1\n")
    g = Graph.from_text(spark, str(path))
    assert rows(g.edges) == [(0, "a", 1), (1, "b", 4)]
    assert g.vertex_count() == 5 and g.edge_count() == 2 and g.domain().count() == 5 and graphs.line_count(spark, str(path)) == 3
    assert rows(PathQuery(g, "S -> a |").reach()) == [(0, 0), (0, 1), (1, 1), (2, 2), (3, 3), (4, 4)]
    g.write(str(tmp_path / "parquet"))
    assert rows(Graph.from_parquet(spark, str(tmp_path / "parquet")).edges) == rows(g.edges)
    path.write_text("0 a\n")
    with pytest.raises(Exception, match="not a triple"):
        Graph.from_text(spark, str(path)).edges.collect()


def test_grammar_text():
    g = Grammar.from_text('"S" -> "a" S b | c\nV2 -> \nS -> V2')
    assert g.start == "S" and g.terminals == {"a", "b", "c"} and g.nullable() == {"V2", "S"}
    assert Grammar.from_text("T -> a").start == "T"
    for bad in ("S a b", "", "A B -> c"):
        with pytest.raises(ValueError):
            Grammar.from_text(bad)
    cnf = Grammar.from_cnf_text("S\n\nS -> A B\nA -> a\nB -> b\nB ->\n")
    assert cnf.to_rules() == {"eps": [("B",)], "term": [("A", "a"), ("B", "b")], "bin": [("S", "A", "B")]}
    with pytest.raises(ValueError):
        Grammar.from_cnf_text("S\n\nS -> a b c\n")


def test_automaton_text():
    text = "3\n1\n4\na\n1\n0 1\nS\n1\n1 2\nb\n2\n1 3\n2 3\nS\n1\n0 3\n"
    a = RecursiveAutomaton.from_counted_text(text, "S")
    assert a.moves == ((0, "a", 1), (1, "S", 2), (1, "b", 3), (2, "b", 3)) and a.boxes["S"].finals == {3} and not a.regular
    with pytest.raises(ValueError):
        RecursiveAutomaton.from_counted_text(text, "T")
    with pytest.raises(ValueError):
        RecursiveAutomaton.from_counted_text("3\n1\n4\na\n", "S")
    assert RecursiveAutomaton.from_regexes({"S": "( a | b ) * c ?"}).regular
    for bad in ("( a", "* a", "a )"):
        with pytest.raises(ValueError):
            RecursiveAutomaton.from_regexes({"S": bad})


def test_catalog():
    for kind, own in GRAMMARS.items():
        for name in own:
            assert grammar(kind, name).compile().binary


def test_etl(spark):
    e = spark.createDataFrame([("x", "long label", "y"), ("y", "odd", "z")], "src string, label string, dst string")
    assert rows(etl.with_inverse(etl.mapped(e, {"long label": "l"}))) == [("x", "l", "y"), ("y", "l_r", "x")]
    assert rows(etl.mapped(e, {"long label": "l"}, other="other")) == [("x", "l", "y"), ("y", "other", "z")]
    dense, ids = etl.dense_ids(e)
    assert rows(ids) == [("x", 0), ("y", 1), ("z", 2)] and rows(dense) == [(0, "long label", 1), (1, "odd", 2)]
    assert rows(graphs.batches(spark.range(5).toDF("v"), 2)) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2)]


def test_graph_algebra(spark):
    a = Graph.from_frame(spark.createDataFrame([(0, "a", 1)], "src long, label string, dst long"))
    none = Graph.from_frame(a.edges.where("false"))
    assert (a + none).edge_count() == 1 and a.joined(none).edge_count() == 0 and a.joined(a).edge_count() == 1
    assert rows(a.with_witness_columns()) == [(0, "a", 1, 0, 1, 1)] and rows(a.with_length_columns()) == [(0, "a", 1, 0, 1)]


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([("g", "c", 1.0, 5), ("g", "c", 3.0, 5), ("h", "c", 2.0, 1)], "graph string, grammar string, time double, count_S long")
    stats = summarise(runs, ["graph", "grammar", "count_S"])
    assert rows(stats.select("graph", "time", "variance")) == [("g", 2.0, 2.0), ("h", 2.0, None)]
    sinks.append_csv(stats, str(tmp_path / "out"), "index")
    sinks.append_csv(stats, str(tmp_path / "out"), "index")
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 4
    (tmp_path / "config.csv").write_text("Graph,Grammar\ng1,a\ng1,b\ng2,a\n")
    assert rows(sinks.read_config(spark, str(tmp_path / "config.csv"))) == [("g1", ["a", "b"]), ("g2", ["a"])]
    sinks.write_pairs(spark.createDataFrame([(1, 2)], "src long, dst long"), str(tmp_path / "pairs"))
    assert spark.read.text(str(tmp_path / "pairs")).first()[0] == "1 2"


def test_bench_command(spark, tmp_path):
    from pathloom import bench

    (tmp_path / "g.txt").write_text("0 a 1\n1 a 2\n2 b 3\n3 b 4\n")
    grammar = "S -> a S b | a b"
    for algo, n in (("reach", 1), ("shortest", 2), ("all_paths", 1), ("multi_source", 4)):
        found = bench.measure(spark, str(tmp_path / "g.txt"), grammar, algo, rounds=2, chunks=(2,))
        assert len(found) == n, algo
    bench.main(["--graph", str(tmp_path / "g.txt"), "--grammar", grammar, "--rounds", "1", "--out", str(tmp_path / "out")])
    assert spark.read.csv(str(tmp_path / "out"), header=True).first()["count_S"] == "2"
