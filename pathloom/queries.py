"""The engine's queries on the driver's tables, each with its DuckDB equivalent."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.annotations import k_least, semiring
from .functions.stats import summarise
from .operators import product
from .operators.fixpoint import Strategy
from .operators.registry import ALGORITHMS
from .operators.rounds import Scratch
from .plans import catalog
from .plans.automaton import RecursiveAutomaton
from .plans.grammar import Grammar
from .query import PathQuery, SourceSession
from .sources import etl, graphs, sinks
from .sources.graphs import Graph

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ANBN = "S -> view S click | view click"
DYCK = "S -> S S | view S click | view click"
SAME = "S -> in S in_r | in in_r"
HOPS = "in in_r in in_r"
#: everything by distributed rounds, as on graphs and parts that no task can hold
ROUNDS = Strategy(local_edges=0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- graphs --------------------------------------------------------------------------------------------------------------


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Each user's events in order of time; an edge has the type of the event it leaves."""
    edges = etl.chain(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", "event_type")
    return Graph.from_frame(edges, part="part")


def places_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers in nations in regions, with inverse edges."""
    v = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    edge = lambda a, b: (a.alias("src"), F.lit("in").alias("label"), b.alias("dst"))
    s = read(spark, sf_dir, "supplier").select(*edge(v("S", "s_suppkey"), v("N", "s_nationkey")))
    n = read(spark, sf_dir, "nation").select(*edge(v("N", "n_nationkey"), v("R", "n_regionkey")))
    return Graph.from_frame(etl.with_inverse(s.unionByName(n)))


def supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("src"), F.lit("in").alias("label"), F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("dst"))
    return Graph.from_frame(etl.with_inverse(s))


def talk_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Each conversation's turns in order; an edge has the role of the turn it leaves."""
    edges = etl.chain(read(spark, sf_dir, "conversations"), "conv_id", ["turn"], F.concat_ws("-", F.col("conv_id"), F.col("turn")), "role")
    return Graph.from_frame(edges, part="part")


_E = """e AS (SELECT event_id AS src, event_type AS label, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events QUALIFY dst IS NOT NULL)"""
_P = """g AS (SELECT 'S' || s_suppkey AS src, 'in' AS label, 'N' || s_nationkey AS dst FROM supplier UNION SELECT 'N' || n_nationkey, 'in', 'R' || n_regionkey FROM nation),
e AS (SELECT * FROM g UNION SELECT dst, 'in_r', src FROM g)"""
_SUP = """g AS (SELECT 'S' || s_suppkey AS src, 'N' || s_nationkey AS dst FROM supplier), e AS (SELECT src, 'in' AS label, dst FROM g UNION SELECT dst, 'in_r', src FROM g)"""
_T = """e AS (SELECT conv_id || '-' || turn AS src, role AS label, lead(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations QUALIFY dst IS NOT NULL)"""
_S = """s AS (SELECT x.src, y.dst, 1 AS n FROM e x JOIN e y ON x.dst = y.src WHERE x.label = 'view' AND y.label = 'click'
  UNION SELECT x.src, y.dst, s.n + 1 FROM s JOIN e x ON x.dst = s.src AND x.label = 'view' JOIN e y ON y.src = s.dst AND y.label = 'click')"""
_SG = """s AS (SELECT x.src, y.dst, 1 AS n FROM e x JOIN e y ON x.dst = y.src WHERE x.label = 'in' AND y.label = 'in_r'
  UNION SELECT x.src, y.dst, s.n + 1 FROM s JOIN e x ON x.dst = s.src AND x.label = 'in' JOIN e y ON y.src = s.dst AND y.label = 'in_r')"""
_ORDER = """o AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"""


# ---- reachability --------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_E}, {_S} SELECT DISTINCT src, dst FROM s")
def cfpq_events_anbn(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), ANBN).reach()


@query(f"""WITH RECURSIVE {_E},
s(src, dst) USING KEY (src, dst) AS (
  SELECT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src WHERE x.label='view' AND y.label='click'
  UNION (SELECT x.src, y.dst FROM s JOIN e x ON x.dst = s.src AND x.label='view' JOIN e y ON y.src = s.dst AND y.label='click'
         UNION SELECT l.src, r.dst FROM s l JOIN recurring.s r ON l.dst = r.src
         UNION SELECT l.src, r.dst FROM recurring.s l JOIN s r ON l.dst = r.src))
SELECT src, dst FROM s""")
def cfpq_events_dyck(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), DYCK).reach()


@query(f"WITH RECURSIVE {_P}, {_SG} SELECT DISTINCT src, dst FROM s")
def cfpq_same_generation(spark, sf_dir):
    return PathQuery(places_graph(spark, sf_dir), SAME).reach()


@query(f"""WITH RECURSIVE {_E}, s AS (SELECT src, dst FROM e WHERE label = 'view' UNION SELECT s.src, e.dst FROM s JOIN e ON e.src = s.dst AND e.label = 'view'),
v AS (SELECT src AS v FROM e UNION SELECT dst FROM e) SELECT src, dst FROM s UNION SELECT v, v FROM v""")
def cfpq_events_nullable(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), "S -> view S |").reach()


@query(f"WITH RECURSIVE {_E}, s AS (SELECT src, dst FROM e WHERE label = 'view' UNION SELECT s.src, e.dst FROM s JOIN e ON e.src = s.dst AND e.label = 'view') SELECT src, dst FROM s")
def rpq_events_view_plus(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), "view +").reach()


@query(f"""WITH RECURSIVE {_E}, s AS (SELECT src, dst FROM e WHERE label = 'view' UNION SELECT s.src, e.dst FROM s JOIN e ON e.src = s.dst AND e.label IN ('view', 'click'))
SELECT DISTINCT s.src, e.dst FROM s JOIN e ON e.src = s.dst AND e.label = 'purchase'""")
def rpq_events_to_purchase(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), "view ( click | view ) * purchase").reach()


@query(f"""WITH {_SUP} SELECT DISTINCT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src WHERE x.label = 'in' AND y.label = 'in_r'""")
def rpq_supplier_cycles(spark, sf_dir):
    return PathQuery(supplier_graph(spark, sf_dir), "( in in_r ) +").reach()


@query(f"""WITH {_T} SELECT DISTINCT x.src, z.dst FROM e x JOIN e y ON x.dst = y.src JOIN e z ON y.dst = z.src WHERE x.label = 'user' AND y.label = 'assistant' AND z.label = 'user'""")
def rpq_conversation(spark, sf_dir):
    return PathQuery(talk_graph(spark, sf_dir), "user assistant user").reach()


@query(f"WITH RECURSIVE {_E}, {_S} SELECT DISTINCT src, dst FROM s")
def automaton_events_anbn(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), RecursiveAutomaton.from_grammar(Grammar.from_text(ANBN))).reach()


@query(f"""WITH RECURSIVE {_E}, {_S}, v AS (SELECT src, dst FROM e WHERE label = 'view' UNION SELECT v.src, e.dst FROM v JOIN e ON e.src = v.dst AND e.label = 'view')
SELECT 'S' AS nonterminal, count(*) AS n_pairs FROM (SELECT DISTINCT src, dst FROM s) UNION ALL SELECT 'V', count(*) FROM v""")
def nonterminal_counts(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), "S -> view S click | view click\nV -> V V | view").nonterminal_counts()


# ---- witnesses, walks, subgraphs -----------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_E}, {_S} SELECT src, dst, CAST(2 * min(n) AS BIGINT) AS length FROM s GROUP BY src, dst")
def shortest_events_anbn(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), ANBN).shortest()


@query(f"WITH RECURSIVE {_P}, {_SG} SELECT src, dst, CAST(2 * min(n) AS BIGINT) AS length FROM s GROUP BY src, dst")
def shortest_same_generation(spark, sf_dir):
    return PathQuery(places_graph(spark, sf_dir), SAME).shortest()


@query(f"WITH RECURSIVE {_E}, {_S} SELECT src, dst, CAST(2 * min(n) AS BIGINT) AS height, CAST(2 * min(n) AS BIGINT) AS length FROM s GROUP BY src, dst")
def single_events_anbn(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), ANBN).single_path()


@query(f"""WITH RECURSIVE {_E}, {_S}, {_ORDER}, p AS (SELECT DISTINCT src, dst FROM s)
SELECT p.src AS root_src, p.dst AS root_dst, CAST(x.k - a.k AS BIGINT) AS pos, x.event_id AS src, y.event_id AS dst, x.event_type AS label
FROM p JOIN o a ON a.event_id = p.src JOIN o b ON b.event_id = p.dst JOIN o x ON x.user_id = a.user_id AND x.k >= a.k AND x.k < b.k JOIN o y ON y.user_id = x.user_id AND y.k = x.k + 1""")
def single_edges_events_anbn(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), ANBN).single_path_edges()


@query(f"""WITH RECURSIVE {_E}, {_S}, {_ORDER}, p AS (SELECT DISTINCT src, dst FROM s)
SELECT DISTINCT x.event_id AS src, x.event_type AS label, y.event_id AS dst
FROM p JOIN o a ON a.event_id = p.src JOIN o b ON b.event_id = p.dst JOIN o x ON x.user_id = a.user_id AND x.k >= a.k AND x.k < b.k JOIN o y ON y.user_id = x.user_id AND y.k = x.k + 1""")
def subgraph_events_anbn(spark, sf_dir):
    q = PathQuery(events_graph(spark, sf_dir), ANBN)
    return q.subgraph(q.reach())


@query(f"""WITH RECURSIVE {_E}, {_S} SELECT src, dst, CAST(count(*) AS BIGINT) AS n_paths FROM s WHERE n < 4 GROUP BY src, dst""")
def count_paths_unambiguous_events_anbn(spark, sf_dir):
    """Walks of an unambiguous grammar, counted as derivations without being listed."""
    q = PathQuery(events_graph(spark, sf_dir), ANBN)
    return q.count_paths(q.reach(), 8, unambiguous=True).select("src", "dst", F.col("n_paths").cast("long").alias("n_paths"))


_HOPS = f"WITH {_SUP}, w AS (SELECT a.src, d.dst, a.dst AS m1, b.dst AS m2, c.dst AS m3 FROM e a JOIN e b ON a.dst = b.src JOIN e c ON b.dst = c.src JOIN e d ON c.dst = d.src WHERE a.label = 'in' AND b.label = 'in_r' AND c.label = 'in' AND d.label = 'in_r')"


@query(f"{_HOPS} SELECT src, dst, count(*) AS n_paths FROM w GROUP BY src, dst")
def count_paths_supplier_hops(spark, sf_dir):
    q = PathQuery(supplier_graph(spark, sf_dir), HOPS)
    return q.count_paths(None, 5).select("src", "dst", F.col("n_paths").cast("long").alias("n_paths"))


@query(f"{_HOPS} SELECT src, dst, CAST(4 AS BIGINT) AS length, count(*) AS n FROM w GROUP BY src, dst")
def count_derivations_supplier_hops(spark, sf_dir):
    q = PathQuery(supplier_graph(spark, sf_dir), HOPS)
    return q.count_derivations(None, 5).select("src", "dst", "length", F.col("n").cast("long").alias("n"))


@query(f"{_HOPS} SELECT src || ' ' || m1 || ' ' || m2 || ' ' || m3 || ' ' || dst AS walk, CAST(4 AS BIGINT) AS length FROM w")
def all_paths_supplier_hops(spark, sf_dir):
    q = PathQuery(supplier_graph(spark, sf_dir), HOPS)
    steps = F.transform("path", lambda x: x["src"])
    return q.all_paths(None, 5).select(F.concat_ws(" ", steps, F.col("dst")).alias("walk"), "length")


@query(f"""WITH RECURSIVE {_E}, s AS (SELECT src, dst, 1 AS n FROM e WHERE label = 'view' UNION SELECT s.src, e.dst, s.n + 1 FROM s JOIN e ON e.src = s.dst AND e.label = 'view')
SELECT src, dst, CAST(n - 1 AS BIGINT) AS n_mids, n = 1 AS is_edge FROM s""")
def midpoints_events_view(spark, sf_dir):
    found = PathQuery(events_graph(spark, sf_dir), "S -> S S | view").midpoints()
    return found.select("src", "dst", F.size("mids").cast("long").alias("n_mids"), "is_edge")


@query(f"""WITH RECURSIVE {_E}, {_S}, {_ORDER}, p AS (SELECT DISTINCT src, dst FROM s WHERE n <= 2)
SELECT DISTINCT x.event_id AS src, x.event_type AS label, y.event_id AS dst
FROM p JOIN o a ON a.event_id = p.src JOIN o b ON b.event_id = p.dst JOIN o x ON x.user_id = a.user_id AND x.k >= a.k AND x.k < b.k JOIN o y ON y.user_id = x.user_id AND y.k = x.k + 1""")
def subgraph_height_events_anbn(spark, sf_dir):
    """Of all accepted walks those with a derivation of height 4 at most, which are the words of up to two views and clicks."""
    q = PathQuery(events_graph(spark, sf_dir), ANBN)
    return q.subgraph(q.reach(), max_height=4)


@query(f"WITH RECURSIVE {_E}, {_S} SELECT DISTINCT src, dst, CAST(2 * n AS BIGINT) AS length, CAST(1 AS BIGINT) AS n FROM s WHERE n < 4")
def rounds_count_derivations_events_anbn(spark, sf_dir):
    """The forest of walks under a length by distributed rounds, which derive no fact of longer walks."""
    q = PathQuery(whole(spark, sf_dir), ANBN, strategy=ROUNDS)
    return q.count_derivations(whole(spark, sf_dir).edges.select("src").distinct().join(q.reach(), "src"), 8).select("src", "dst", "length", F.col("n").cast("long").alias("n"))


@query("WITH RECURSIVE " + _E + """, s AS (SELECT src, dst, 1 AS n FROM e WHERE label = 'view' UNION SELECT s.src, e.dst, s.n + 1 FROM s JOIN e ON e.src = s.dst AND e.label = 'view')
SELECT l.src, r.dst, l.dst AS mid FROM s l JOIN s r ON l.dst = r.src UNION SELECT src, dst, CAST(NULL AS BIGINT) FROM s WHERE n = 1""")
def midpoint_rows_events_view(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), "S -> S S | view").midpoint_rows().select("src", "dst", "mid")


# ---- sources -------------------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_E}, {_S} SELECT DISTINCT src, dst FROM s WHERE src IN (SELECT event_id FROM events WHERE value > 50)")
def multi_source_events_anbn(spark, sf_dir):
    sources = read(spark, sf_dir, "events").where("value > 50").select("event_id")
    return PathQuery(events_graph(spark, sf_dir), ANBN).from_sources(sources)


@query(f"WITH RECURSIVE {_P}, {_SG} SELECT DISTINCT src, dst FROM s WHERE src IN (SELECT 'S' || s_suppkey FROM supplier WHERE s_acctbal < 0)")
def multi_source_same_generation(spark, sf_dir):
    sources = read(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("v"))
    return PathQuery(places_graph(spark, sf_dir), SAME).from_sources(sources)


@query(f"WITH RECURSIVE {_E}, {_S} SELECT DISTINCT src, dst FROM s WHERE src IN (SELECT event_id FROM events WHERE value > 50)")
def source_session_events_anbn(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    session = SourceSession(PathQuery(events_graph(spark, sf_dir), ANBN))
    session.solve(events.where("value > 80").select("event_id"))
    return session.solve(events.where("value > 50").select("event_id"))


@query(f"WITH {_E} SELECT DISTINCT dst AS v FROM e WHERE label = 'view' EXCEPT SELECT src FROM e WHERE label = 'click'")
def next_sources_events(spark, sf_dir):
    edges = events_graph(spark, sf_dir).edges
    return product.next_sources(edges.where("label = 'view'"), edges.where("label = 'click'").select("src"))


@query(f"WITH {_E} SELECT src, label, dst FROM e WHERE src IN (SELECT event_id FROM events WHERE value > 50)")
def source_mask_events(spark, sf_dir):
    return product.masked(events_graph(spark, sf_dir).edges.select("src", "label", "dst"), read(spark, sf_dir, "events").where("value > 50").select("event_id"))


# ---- parts of the engine -------------------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT 'A' AS nt, src, dst FROM e WHERE label = 'view' UNION SELECT 'B', src, dst FROM e WHERE label IN ('click', 'purchase')")
def terminal_seed_events(spark, sf_dir):
    return product.terminal_facts(events_graph(spark, sf_dir).edges, Grammar.from_text("S -> A B\nA -> view\nB -> click | purchase"))


@query(f"WITH {_P}, v AS (SELECT src AS v FROM e UNION SELECT dst FROM e) SELECT 'A' AS nt, v AS src, v AS dst FROM v UNION ALL SELECT 'S', v, v FROM v")
def epsilon_seed_places(spark, sf_dir):
    return product.epsilon_facts(places_graph(spark, sf_dir).domain(), Grammar.from_text("S -> A A\nA -> in |"))


@query(f"WITH {_E}, m(q, label, q2) AS (VALUES (0, 'view', 1), (1, 'click', 2)) SELECT CAST(q AS INTEGER) AS q, src, label, CAST(q2 AS INTEGER) AS q2, dst FROM e JOIN m USING (label)")
def product_edges_events(spark, sf_dir):
    return product.product_edges(events_graph(spark, sf_dir).edges, RecursiveAutomaton.from_regexes({"S": "view click"}))


@query(f"WITH {_P} SELECT DISTINCT x.src, y.dst FROM e x JOIN e y ON x.dst = y.src")
def step_pairs_places(spark, sf_dir):
    edges = places_graph(spark, sf_dir).edges
    return product.step_pairs(edges, edges)


@query(f"WITH {_P} SELECT src, label, dst FROM e")
def etl_inverse_edges(spark, sf_dir):
    return places_graph(spark, sf_dir).edges.distinct()


@query(f"WITH {_E} SELECT src, CASE label WHEN 'view' THEN 'v' ELSE 'c' END AS label, dst FROM e WHERE label IN ('view', 'click')")
def etl_mapped_labels(spark, sf_dir):
    return etl.mapped(events_graph(spark, sf_dir).edges, {"view": "v", "click": "c"})


@query(f"WITH {_P}, d AS (SELECT v AS name, row_number() OVER (ORDER BY v) - 1 AS id FROM (SELECT src AS v FROM e UNION SELECT dst FROM e)) SELECT a.id AS src, label, b.id AS dst FROM e JOIN d a ON a.name = src JOIN d b ON b.name = dst")
def etl_dense_ids(spark, sf_dir):
    return etl.dense_ids(places_graph(spark, sf_dir).edges.distinct())[0]


@query(f"WITH {_E} SELECT dst AS src, label, src AS dst FROM e")
def transposed_events(spark, sf_dir):
    return graphs.transposed(events_graph(spark, sf_dir).edges)


@query(f"WITH {_E} SELECT label, count(*) AS n_edges FROM e GROUP BY label")
def label_counts_events(spark, sf_dir):
    return events_graph(spark, sf_dir).label_counts()


@query(f"WITH {_E} SELECT (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM (SELECT src FROM e UNION SELECT dst FROM e)) AS n_vertices")
def graph_stats_events(spark, sf_dir):
    g = events_graph(spark, sf_dir)
    return spark.createDataFrame([(g.edge_count(), g.vertex_count())], "n_edges long, n_vertices long")


@query("SELECT event_id AS v, event_id // 1000 AS batch FROM events")
def source_batches_events(spark, sf_dir):
    return graphs.batches(read(spark, sf_dir, "events").select(F.col("event_id").alias("v")), 1000)


@query(f"WITH {_E}, a AS (SELECT * FROM e WHERE label = 'view'), b AS (SELECT * FROM e WHERE label = 'click') SELECT src, label, dst FROM (SELECT * FROM a UNION SELECT * FROM b) WHERE EXISTS (FROM a) AND EXISTS (FROM b)")
def joined_graphs_events(spark, sf_dir):
    edges = events_graph(spark, sf_dir).edges.select("src", "label", "dst")
    return Graph.from_frame(edges.where("label = 'view'")).joined(Graph.from_frame(edges.where("label = 'click'"))).edges


@query(f"WITH {_E} SELECT src, label, dst, src AS mid, CAST(1 AS INTEGER) AS height, CAST(1 AS BIGINT) AS length FROM e")
def witness_edges_events(spark, sf_dir):
    return events_graph(spark, sf_dir).with_witness_columns()


@query("SELECT event_type, round(avg(value), 4) AS time, round(var_samp(value), 4) AS variance FROM events GROUP BY event_type")
def measurement_stats(spark, sf_dir):
    found = summarise(read(spark, sf_dir, "events"), ["event_type"], "value")
    return found.select("event_type", F.round("time", 4).alias("time"), F.round("variance", 4).alias("variance"))


# ---- distributed rounds --------------------------------------------------------------------------------------------------


def whole(spark: SparkSession, sf_dir: str) -> Graph:
    """The events' graph without its parts: nothing says that it falls apart."""
    return Graph.from_frame(events_graph(spark, sf_dir).edges.select("src", "label", "dst"))


@query(ORACLES["cfpq_events_anbn"])
def rounds_cfpq_events_anbn(spark, sf_dir):
    return PathQuery(whole(spark, sf_dir), ANBN, strategy=ROUNDS).reach()


@query(ORACLES["cfpq_events_dyck"])
def rounds_cfpq_events_dyck(spark, sf_dir):
    """Every join broadcast-free and every find measured: the plan of rounds that bring more than may be broadcast."""
    return PathQuery(whole(spark, sf_dir), DYCK, strategy=Strategy(local_edges=0, broadcast_bytes=0, direct_facts=0)).reach()


@query(ORACLES["cfpq_same_generation"])
def rounds_same_generation(spark, sf_dir):
    return PathQuery(places_graph(spark, sf_dir), SAME, strategy=ROUNDS).reach()


@query(ORACLES["rpq_events_view_plus"])
def rounds_rpq_events_view_plus(spark, sf_dir):
    return PathQuery(whole(spark, sf_dir), "view +", strategy=ROUNDS).reach()


@query(ORACLES["shortest_events_anbn"])
def rounds_shortest_events_anbn(spark, sf_dir):
    return PathQuery(whole(spark, sf_dir), ANBN, strategy=ROUNDS).shortest()


@query(ORACLES["single_events_anbn"])
def rounds_single_events_anbn(spark, sf_dir):
    return PathQuery(whole(spark, sf_dir), ANBN, strategy=ROUNDS).single_path()


@query(ORACLES["multi_source_events_anbn"])
def rounds_multi_source_events_anbn(spark, sf_dir):
    sources = read(spark, sf_dir, "events").where("value > 50").select("event_id")
    return PathQuery(whole(spark, sf_dir), ANBN, strategy=ROUNDS).from_sources(sources)


@query(ORACLES["rpq_events_view_plus"])
def powers_rpq_events_view_plus(spark, sf_dir):
    """Powers of the product graph from the first round on: rounds grow with the logarithm of the longest walk."""
    return PathQuery(whole(spark, sf_dir), "view +", strategy=Strategy(local_edges=0, square_after=1, power_factor=1_000)).reach()


@query(ORACLES["rpq_events_to_purchase"])
def powers_rpq_events_to_purchase(spark, sf_dir):
    return PathQuery(whole(spark, sf_dir), "view ( click | view ) * purchase", strategy=Strategy(local_edges=0, square_after=1, power_factor=1_000)).reach()


@query(ORACLES["rpq_conversation"])
def straight_rpq_conversation(spark, sf_dir):
    """No recursion: one plan of joins."""
    g = Graph.from_frame(talk_graph(spark, sf_dir).edges.select("src", "label", "dst"))
    return PathQuery(g, "user assistant user", strategy=ROUNDS).reach()


@query(f"WITH RECURSIVE {_E}, {_S} SELECT src, dst, CAST(4 * min(n) AS BIGINT) AS value FROM s GROUP BY src, dst")
def cheapest_events_anbn(spark, sf_dir):
    """A semiring of one's own: a view costs 1, anything else 3."""
    cost = semiring("cost", "long", F.when(F.col("label") == "view", 1).otherwise(3), F.lit(0), lambda l, r: l + r)
    return PathQuery(events_graph(spark, sf_dir), ANBN).annotated(cost)


@query(f"""WITH RECURSIVE {_P}, b AS (SELECT x.src, y.dst, 2 AS n FROM e x JOIN e y ON x.dst = y.src WHERE x.label = 'in' AND y.label = 'in_r'
  UNION SELECT x.src, z.dst, 4 FROM e x JOIN e y ON x.dst = y.src JOIN e w ON y.dst = w.src JOIN e z ON w.dst = z.src WHERE x.label = 'in' AND y.label = 'in' AND w.label = 'in_r' AND z.label = 'in_r'),
w AS (SELECT src, dst, n FROM b UNION SELECT w.src, b.dst, w.n + b.n FROM w JOIN b ON w.dst = b.src WHERE w.n + b.n <= 8)
SELECT src, dst, array_to_string(list_sort(list(DISTINCT n))[1:3], ' ') AS lengths FROM w GROUP BY src, dst""")
def three_shortest_lengths_places(spark, sf_dir):
    """The three least lengths of walks over common nations and regions, of which there are endlessly many: a semiring without a best value."""
    q = PathQuery(places_graph(spark, sf_dir), "S -> S S | in in_r | in in in_r in_r")
    return q.annotated(k_least(3)).select("src", "dst", F.array_join(F.col("values").cast("array<string>"), " ").alias("lengths"))


@query(f"""WITH RECURSIVE {_E}, {_S} SELECT (SELECT count(DISTINCT (src, dst)) FROM s) AS n_pairs,
(SELECT CAST(max(greatest(2 * s.n, CASE WHEN e.src IS NULL THEN 0 ELSE 2 * s.n + 1 END)) AS BIGINT) FROM s LEFT JOIN e ON e.src = s.dst AND e.label = 'click') AS n_rounds""")
def rounds_of_events_anbn(spark, sf_dir):
    """A round derives facts that are one higher than those of the last; the last round finds nothing."""
    q = PathQuery(whole(spark, sf_dir), ANBN, strategy=ROUNDS)
    return spark.createDataFrame([(q.reach().count(), q.rounds)], "n_pairs long, n_rounds long")


# ---- files in and out ----------------------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT src, label, dst FROM e")
def text_triples_events(spark, sf_dir):
    path = Scratch(spark, "triples").path("edges.txt")
    events_graph(spark, sf_dir).write_text(path)
    return Graph.from_text(spark, path).edges


@query(f"WITH {_E} SELECT (SELECT max(greatest(src, dst)) + 1 FROM e) AS n_vertices, (SELECT count(*) FROM e) AS n_lines")
def text_domain_events(spark, sf_dir):
    path = Scratch(spark, "triples").path("edges.txt")
    events_graph(spark, sf_dir).write_text(path)
    return spark.createDataFrame([(Graph.from_text(spark, path).vertex_count(), graphs.line_count(spark, path))], "n_vertices long, n_lines long")


@query(f"WITH {_E} SELECT src, label, dst FROM e WHERE label = 'view'")
def label_graph_events(spark, sf_dir):
    """Edges stored by label: a query of one label reads its files alone."""
    path = Scratch(spark, "labels").path("edges")
    Graph.from_frame(events_graph(spark, sf_dir).edges).write(path)
    return Graph.from_parquet(spark, path).edges.where("label = 'view'").select("src", "label", "dst")


@query(f"WITH {_E} SELECT src, label, dst, src AS mid, CAST(1 AS BIGINT) AS length FROM e")
def length_edges_events(spark, sf_dir):
    return events_graph(spark, sf_dir).with_length_columns()


@query(ORACLES["cfpq_events_anbn"])
def normal_form_events_anbn(spark, sf_dir):
    return PathQuery(events_graph(spark, sf_dir), Grammar.from_cnf_text("S\n\nS -> A T\nS -> A B\nT -> S B\nA -> view\nB -> click\n")).reach()


@query(ORACLES["cfpq_events_anbn"])
def automaton_file_events_anbn(spark, sf_dir):
    a = RecursiveAutomaton.from_counted_text("3\n1\n4\nview\n1\n0 1\nS\n1\n1 2\nclick\n2\n1 3\n2 3\nS\n1\n0 3\n", "S")
    return PathQuery(events_graph(spark, sf_dir), a).reach()


@query(ORACLES["cfpq_same_generation"])
def catalogue_same_generation(spark, sf_dir):
    return PathQuery(places_graph(spark, sf_dir), catalog.grammar("binomial", "sg")).reach()


@query("SELECT event_type AS graph, 'g' AS grammar, CAST(round(avg(value), 4) AS VARCHAR) AS time, CAST(count(*) AS VARCHAR) AS \"count_S\", CAST(round(var_samp(value), 4) AS VARCHAR) AS variance FROM events GROUP BY event_type")
def csv_results_events(spark, sf_dir):
    found = summarise(read(spark, sf_dir, "events").withColumns({"graph": F.col("event_type"), "grammar": F.lit("g")}), ["graph", "grammar"], "value")
    counts = read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("graph")).agg(F.count("*").alias("count_S"))
    path = Scratch(spark, "results").path("index")
    rounded = found.join(counts, "graph").withColumns({"time": F.round("time", 4), "variance": F.round("variance", 4)})
    sinks.append_csv(rounded, path, "index")
    return spark.read.csv(path, header=True)


@query("SELECT event_type AS graph, array_to_string(list_sort(list(DISTINCT strftime(ts, '%Y'))), ' ') AS grammars FROM events GROUP BY event_type")
def configuration_events(spark, sf_dir):
    path = Scratch(spark, "configuration").path("pairs")
    rows = read(spark, sf_dir, "events").select(F.col("event_type").alias("Graph"), F.date_format("ts", "yyyy").alias("Grammar")).distinct()
    rows.write.option("header", True).csv(path)
    return sinks.read_config(spark, path).select("graph", F.array_join("grammars", " ").alias("grammars"))


@query(ORACLES["cfpq_events_anbn"])
def pair_dump_events_anbn(spark, sf_dir):
    path = Scratch(spark, "pairs").path("pairs.txt")
    sinks.write_pairs(PathQuery(events_graph(spark, sf_dir), ANBN).reach(), path)
    ends = F.split("value", " ")
    return spark.read.text(path).select(ends[0].cast("long").alias("src"), ends[1].cast("long").alias("dst"))


# ---- sources and sessions of automata ------------------------------------------------------------------------------------


@query(ORACLES["multi_source_events_anbn"])
def automaton_multi_source_events_anbn(spark, sf_dir):
    sources = read(spark, sf_dir, "events").where("value > 50").select("event_id")
    return PathQuery(events_graph(spark, sf_dir), RecursiveAutomaton.from_grammar(Grammar.from_text(ANBN))).from_sources(sources)


@query(f"""WITH RECURSIVE {_E}, {_S}, n AS (SELECT event_id AS v FROM events WHERE value > 50 UNION SELECT e.dst FROM n JOIN e ON e.src = n.v AND e.label = 'view')
SELECT DISTINCT src, dst FROM s WHERE src IN (SELECT v FROM n)""")
def needed_facts_events_anbn(spark, sf_dir):
    """Unmasked: also the pairs from vertices that the sources' walks need."""
    sources = read(spark, sf_dir, "events").where("value > 50").select("event_id")
    return PathQuery(events_graph(spark, sf_dir), RecursiveAutomaton.from_grammar(Grammar.from_text(ANBN))).needed_facts(sources)


@query(f"WITH RECURSIVE {_E}, {_S} SELECT DISTINCT src, dst FROM s WHERE src IN (SELECT event_id FROM events WHERE value > 80)")
def session_reset_events_anbn(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    session = SourceSession(PathQuery(events_graph(spark, sf_dir), ANBN))
    session.solve(events.where("value > 50").select("event_id"))
    session.reset()
    session.solve(events.where("value > 80").select("event_id"))
    return session.cached()


# ---- algebra -------------------------------------------------------------------------------------------------------------


@query(f"WITH {_E} SELECT CAST(src AS VARCHAR) AS src, label, CAST(dst AS VARCHAR) AS dst FROM e WHERE label IN ('view', 'click')")
def union_graphs_events(spark, sf_dir):
    edges = events_graph(spark, sf_dir).edges.select(F.col("src").cast("string"), "label", F.col("dst").cast("string"))
    views = Graph.from_frame(edges.where("label = 'view'"))
    views += Graph.from_frame(edges.where("label in ('view', 'click')"))
    return views.edges


@query(f"WITH RECURSIVE {_E}, s AS (SELECT src, dst FROM e WHERE label = 'view' UNION SELECT s.src, e.dst FROM s JOIN e ON e.src = s.dst AND e.label = 'view') SELECT 'S' AS nt, src, dst FROM s")
def closure_block_events(spark, sf_dir):
    """The block of a closed product graph from a box's start to its final states: vertices of that graph are (state, vertex)."""
    a = RecursiveAutomaton.from_regexes({"S": "view +"})
    steps = product.product_edges(events_graph(spark, sf_dir).edges, a)
    g = Graph.from_frame(steps.select(F.concat_ws(":", "q", "src").alias("src"), F.lit("x").alias("label"), F.concat_ws(":", "q2", "dst").alias("dst")))
    end = lambda c, k, kind: F.split(c, ":")[k].cast(kind)
    closed = PathQuery(g, "x +", strategy=ROUNDS).reach().select(end("src", 0, "int").alias("q"), end("src", 1, "long").alias("src"), end("dst", 0, "int").alias("q2"), end("dst", 1, "long").alias("dst"))
    return product.block(closed, a)


@query(ORACLES["cfpq_events_anbn"])
def registry_automaton_events_anbn(spark, sf_dir):
    return ALGORITHMS["automaton"][1](PathQuery(events_graph(spark, sf_dir), ANBN))


@query(f"WITH {_E} SELECT src, label, dst FROM e")
def split_chain_events(spark, sf_dir):
    """Users of over 20 events count as hot: their events are sorted in several tasks."""
    return etl.chain(read(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_id", "event_type", part=False, hot_rows=20)
