"""Golden values of the fixture graphs, and both ways of solving against each other and a plain worklist."""

import random

import pytest

from pyspark.sql import functions as F

from pathloom.functions.annotations import REACH, SHORTEST, SINGLE, semiring
from pathloom.operators import product
from pathloom.operators.fixpoint import Known, Scratch, Strategy, solve, solve_local, solve_straight
from pathloom.operators.registry import ALGORITHMS
from pathloom.plans.automaton import RecursiveAutomaton
from pathloom.plans.grammar import Grammar
from pathloom.query import PathQuery, SourceSession
from pathloom.sources.graphs import Graph

ROUNDS = Strategy(local_edges=0)
ANBN, PLUS = "S -> a S b | a b", "S -> a S | a"
BINARY_TREE = "0 a 2 | 1 a 2 | 3 a 5 | 4 a 5 | 2 a 6 | 5 a 6 | 2 b 0 | 2 b 1 | 5 b 3 | 5 b 4 | 6 b 2 | 6 b 5"
CYCLE = "0 a 1 | 1 a 2 | 2 a 0"
LINE = "0 a 1 | 1 a 2 | 2 b 3 | 3 b 4"
LOOP = "0 a 0 | 0 b 1 | 1 c 2"
TWO_CYCLES = "0 a 1 | 1 a 2 | 2 a 0 | 2 b 3 | 3 b 2"
BALANCED = "0 a 1 | 1 a 2 | 2 a 3 | 3 a 4 | 3 b 5 | 4 b 3 | 5 b 6 | 6 b 7"
#: a balanced tree for a^4 b^4 of height 4, a skewed one for a^3 b^3 of height 5
BALANCED_GRAMMAR = """
S -> S1 S2 | S15 S16
S1 -> S3 S4
S2 -> S5 S6
S3 -> S7 S8
S4 -> S9 S10
S5 -> S11 S12
S6 -> S13 S14
S16 -> S17 S18
S17 -> S19 S20
S18 -> S21 S22
S22 -> S23 S24
S7 -> a
S8 -> a
S9 -> a
S10 -> a
S15 -> a
S19 -> a
S20 -> a
S11 -> b
S12 -> b
S13 -> b
S14 -> b
S21 -> b
S23 -> b
S24 -> b
"""


def edges_of(text):
    return [(int(a), b, int(c)) for a, b, c in (x.split() for x in text.split("|"))]


def graph(spark, text):
    return Graph.from_frame(spark.createDataFrame(edges_of(text), "src long, label string, dst long"), dense=True)


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "src long, dst long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("case,language,n", [(BINARY_TREE, ANBN, 20), (CYCLE, PLUS, 9), (LINE, ANBN, 2), (LOOP, "S -> a | a S", 1), (TWO_CYCLES, ANBN, 6)])
def test_reach_sizes(spark, case, language, n):
    assert PathQuery(graph(spark, case), language).reach().count() == n


def test_distributed_rounds_agree(spark):
    for case, language in ((TWO_CYCLES, ANBN), (CYCLE, "a *")):
        g = graph(spark, case)
        assert rows(PathQuery(g, language, strategy=ROUNDS).reach()) == rows(PathQuery(g, language).reach())


@pytest.mark.parametrize("case,language,pair,length", [(BINARY_TREE, ANBN, (0, 3), 4), (CYCLE, PLUS, (0, 1), 1), (LINE, ANBN, (0, 4), 4), (LOOP, "S -> a | a S", (0, 0), 1), (TWO_CYCLES, ANBN, (1, 3), 2)])
def test_single_path_lengths(spark, case, language, pair, length):
    found = PathQuery(graph(spark, case), language).single_path()
    assert [r["length"] for r in found.collect() if (r["src"], r["dst"]) == pair] == [length]


def test_single_and_shortest_differ(spark):
    for strategy in (Strategy(), ROUNDS):
        q = PathQuery(graph(spark, BALANCED), BALANCED_GRAMMAR, strategy=strategy)
        assert rows(q.shortest()) == [(0, 7, 6), (1, 6, 6)]
        assert rows(q.single_path()) == [(0, 7, 4, 8), (1, 6, 5, 6)]
    walk = PathQuery(graph(spark, BALANCED), BALANCED_GRAMMAR).single_path_edges(pairs(spark, (0, 7))).orderBy("pos").collect()
    assert [r["label"] for r in walk] == list("aaaabbbb") and all(x["dst"] == y["src"] for x, y in zip(walk, walk[1:]))


@pytest.mark.parametrize("case,language,pair,bound,n", [(BINARY_TREE, ANBN, (0, 3), 5, 1), (CYCLE, PLUS, (0, 1), 3, 1), (LINE, ANBN, (0, 4), 2, 0), (LOOP, "S -> a | a S", (0, 0), 1, 0), (TWO_CYCLES, ANBN, (1, 3), 3, 1), (CYCLE, PLUS, (0, 2), 3, 1)])
def test_path_counts(spark, case, language, pair, bound, n):
    q = PathQuery(graph(spark, case), language)
    assert sum(r["n_paths"] for r in q.count_paths(pairs(spark, pair), bound).collect()) == n


def test_walks_pass_through_their_end(spark):
    q = PathQuery(graph(spark, CYCLE), "a +")
    assert sorted(r["length"] for r in q.all_paths(pairs(spark, (0, 1)), 6).collect()) == [1, 4]
    assert [tuple(r) for r in q.count_derivations(pairs(spark, (0, 1)), 6).orderBy("length").collect()] == [(0, 1, 1, 1), (0, 1, 4, 1)]


def test_subgraph(spark):
    found = PathQuery(graph(spark, BINARY_TREE), ANBN).subgraph(pairs(spark, (0, 3)))
    assert rows(found) == sorted([(0, "a", 2), (2, "a", 6), (6, "b", 5), (5, "b", 3)])


def test_multi_source(spark):
    one = lambda v: spark.createDataFrame([(v,)], "v long")
    q = PathQuery(graph(spark, BINARY_TREE), ANBN)
    assert q.from_sources(one(0)).count() == 4 and q.needed_facts(one(0)).count() == 6
    q = PathQuery(graph(spark, LINE), ANBN)
    assert rows(q.from_sources(one(1))) == [(1, 3)] and q.needed_facts(one(1)).count() == 1
    session = SourceSession(PathQuery(graph(spark, BINARY_TREE), ANBN))
    assert session.solve(one(0)).count() == 4 and session.cached().count() == 4
    assert session.solve(one(0).union(one(1))).count() == 8
    session.reset()
    assert session.cached() is None


def test_regressions(spark):
    for text, language, expected in (
        ("0 a 1 | 1 d 2 | 2 b 3 | 3 d 4 | 4 c 5", "S -> a S b S c | d", [(0, 5), (1, 2), (3, 4)]),
        ("0 a 1", "S -> a |", [(0, 0), (0, 1), (1, 1)]),
        ("0 a 1", "S -> z", []),
        ("0 a 1 | 0 a 1", "S -> a", [(0, 1)]),
        ("0 a 1 | 1 b 2 | 2 a 3 | 3 b 4", "S -> S S | a S b | a b", [(0, 2), (0, 4), (2, 4)]),
        ("0 a 1 | 1 a 2 | 2 a 3", "S -> A A\nA -> a", [(0, 2), (1, 3)]),
        ("0 x 1 | 1 b 2", "S -> A b\nA -> x |", [(0, 2), (1, 2)]),
        ("0 t 1", "S -> A | t\nA -> z", [(0, 1)]),
    ):
        assert rows(PathQuery(graph(spark, text), language).reach()) == expected, language


def test_overflow_falls_back_to_rounds(spark):
    edges = spark.createDataFrame([(0, "a", 1, 0), (1, "a", 0, 0), (5, "a", 6, 1)], "src long, label string, dst long, p long")
    g = Graph.from_frame(edges, part="p")
    assert rows(PathQuery(g, PLUS, strategy=Strategy(local_facts=3)).reach()) == [(0, 0), (0, 1), (1, 0), (1, 1), (5, 6)]
    assert rows(PathQuery(g, PLUS, strategy=Strategy(local_edges=1)).reach()) == [(0, 0), (0, 1), (1, 0), (1, 1), (5, 6)]


def worklist(edges, grammar, n):
    """All (nonterminal, u, v) by a plain fixpoint over the productions as they are."""
    reach = {s: {(u, v) for u, t, v in edges if t == s} for s in grammar.terminals} | {s: set() for s in grammar.nonterminals}
    changed = True
    while changed:
        changed = False
        for h, body in grammar.productions:
            now = {(v, v) for v in range(n)}
            for s in body:
                now = {(u, w) for u, v in now for x, w in reach[s] if x == v}
            if not now <= reach[h]:
                reach[h] |= now
                changed = True
    return reach


GRAMMARS = ["S -> a S b | a b", "S -> S S | a S b |", "S -> A B\nA -> a A | a\nB -> b | B S", "S -> A\nA -> B | a\nB -> b S | A A", "S -> A S B | c\nA -> a |\nB -> b | A", "S -> a | T\nT -> S S S"]


def test_local_against_worklist():
    rng = random.Random(5)
    for text in GRAMMARS:
        g = Grammar.from_text(text)
        for _ in range(15):
            n = rng.randint(1, 6)
            edges = [(rng.randrange(n), rng.choice("abc"), rng.randrange(n)) for _ in range(rng.randint(0, 10))]
            truth = worklist(edges, g, n)["S"]
            for program in (g.compile(), RecursiveAutomaton.from_grammar(g).compile(), RecursiveAutomaton.from_grammar(g).to_grammar().compile()):
                facts = solve_local(edges, program, REACH, None, 10**6)
                sym = program.names["S"]
                own = {(u, v) for s, u, v in facts if s == sym} | ({(v, v) for v in range(n)} if sym in program.nullable else set())
                assert own == truth, (text, edges)
            sources = [v for v in range(n) if rng.random() < 0.5]
            for program in (g.compile().restricted(), RecursiveAutomaton.from_grammar(g).compile().restricted()):
                facts = solve_local(edges, program, REACH, sources, 10**6)
                sym = program.names["S"]
                own = {(u, v) for s, u, v in facts if s == sym and u in sources} | ({(v, v) for v in sources} if sym in program.nullable else set())
                assert own == {x for x in truth if x[0] in sources}, (text, edges, sources)


def test_local_lengths_against_rounds(spark):
    rng = random.Random(9)
    for text in GRAMMARS[1:2]:
        program = Grammar.from_text(text).compile()
        edges = [(rng.randrange(5), rng.choice("ab"), rng.randrange(5)) for _ in range(9)]
        df = spark.createDataFrame(edges, "src long, label string, dst long")
        for a in (SHORTEST, SINGLE):
            local = sorted(str(k + v) for k, v in solve_local(edges, program, a, None, 10**6).items())
            assert sorted(str(tuple(r)) for r in solve(df, program, a).collect()) == local


def test_registry(spark):
    q = PathQuery(graph(spark, LINE), ANBN)
    assert ALGORITHMS["reach"][1](q).count() == ALGORITHMS["automaton"][1](q).count() == 2


def test_no_product_in_plans(spark):
    g = graph(spark, TWO_CYCLES)
    plan = PathQuery(g, ANBN, strategy=ROUNDS).reach()._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and len(plan) < 20_000


NULL_PARTS = [(0, "a", 1, None), (1, "b", 2, None), (3, "a", 4, 5), (4, "a", 5, 5), (5, "b", 6, 5), (6, "b", 7, 5), (8, "a", 9, 6), (9, "b", 10, 6)]


@pytest.mark.parametrize("strategy", [Strategy(), Strategy(local_edges=0), Strategy(local_edges=1), Strategy(local_facts=7)])
def test_null_and_outgrown_parts(spark, strategy):
    edges = spark.createDataFrame(NULL_PARTS, "src long, label string, dst long, p long")
    q = PathQuery(Graph.from_frame(edges, part="p"), ANBN, strategy=strategy)
    assert rows(q.reach()) == [(0, 2), (3, 7), (4, 6), (8, 10)]
    if strategy.local_facts == 7:
        assert rows(q.shortest()) == [(0, 2, 2), (3, 7, 4), (4, 6, 2), (8, 10, 2)]
    sources = spark.createDataFrame([(0,), (4,), (8,), (None,)], "v long")
    assert rows(PathQuery(Graph.from_frame(edges, part="p"), ANBN, strategy=strategy).from_sources(sources)) == [(0, 2), (4, 6), (8, 10)]


def test_rounds_against_one_task(spark):
    """Distributed rounds, with and without broadcasts and measured finds, against the in-task solver on random graphs."""
    rng = random.Random(3)
    strategies = [Strategy(local_edges=0), Strategy(local_edges=0, broadcast_bytes=0, direct_facts=0), Strategy(local_edges=0, direct_facts=5)]
    for k, text in enumerate(["S -> S S | a S b | a b", "S -> A B\nA -> a A | a\nB -> b | B S", "S -> a S | a"]):
        edges = [(rng.randrange(7), rng.choice("ab"), rng.randrange(7)) for _ in range(14)]
        df, program = spark.createDataFrame(edges, "src long, label string, dst long"), Grammar.from_text(text).compile()
        for a in (REACH, SHORTEST, SINGLE):
            local = sorted(str(x + v) for x, v in solve_local(edges, program, a, None, 10**6).items())
            assert sorted(str(tuple(r)) for r in solve(df, program, a, strategy=strategies[k]).collect()) == local


def test_rounds_from_known_facts(spark):
    """Facts that new edges add, beside all facts at once."""
    rng = random.Random(8)
    program = Grammar.from_text("S -> S S | a S b | a b").compile()
    edges = list({(rng.randrange(8), rng.choice("ab"), rng.randrange(8)) for _ in range(18)})
    frame = lambda own: spark.createDataFrame(own, "src long, label string, dst long")
    before = solve(frame(edges[:9]), program)
    added = solve(frame(edges[9:]), program, known=before)
    every = rows(solve(frame(edges), program))
    assert sorted(rows(before) + rows(added)) == every and len(set(every)) == len(every)


def test_known_facts_merge(spark):
    """Whatever the sizes of the rounds, there are few tables and no fact is lost."""
    scratch = Scratch(spark, "known")
    known, n = Known(scratch, REACH), 0
    for k, size in enumerate([50, 3, 1, 1, 2, 1, 1, 1, 1, 40, 1, 1, 1, 1, 1, 1, 1, 1]):
        table = scratch.table(spark.range(n, n + size).selectExpr("cast(0 as int) as sym", "id as src", "id as dst"), f"t{k}")
        known.add(f"t{k}", table, size)
        n += size
        assert len(known.tables) <= Known.MOST + 1
    assert sorted(r["src"] for r in known.frame().collect()) == list(range(n))


def test_straight_plan(spark):
    g = graph(spark, BINARY_TREE)
    for text in ("S -> a a b | A b\nA -> a | a a", "S -> A B\nA -> a |\nB -> b b |"):
        program = Grammar.from_text(text).compile()
        assert not program.recursive
        for a in (REACH, SHORTEST, SINGLE):
            one = sorted(str(tuple(r)) for r in solve_straight(g.edges, program, a, Scratch(spark, "straight")).collect())
            assert one == sorted(str(x + v) for x, v in solve_local(edges_of(BINARY_TREE), program, a, None, 10**6).items())
        q = PathQuery(g, text, strategy=ROUNDS)
        assert rows(q.reach()) == rows(PathQuery(g, text).reach()) and q.rounds == 0
    assert Grammar.from_text(ANBN).compile().recursive


def test_regular_language_joins_edges_only(spark):
    """A right-linear program: what a rule adds on the right has the facts of edges alone."""
    program = RecursiveAutomaton.from_regexes({"S": "a ( b | a ) *"}).compile()
    heads = {r[0] for r in program.binary} | {r[0] for r in program.unary}
    assert all(r[2] not in heads for r in program.binary)
    q = PathQuery(graph(spark, CYCLE), "a *", strategy=ROUNDS)
    assert q.reach().count() == 9 and 3 <= q.rounds <= 6


def test_rounds_are_counted(spark):
    for strategy in (Strategy(), ROUNDS):
        q = PathQuery(graph(spark, LINE), ANBN, strategy=strategy)
        assert q.reach().count() == 2 and 3 <= q.rounds <= 5


def test_semirings_of_ones_own(spark):
    """Cheapest and widest walks by label, in both kinds of rounds and without recursion."""
    cost = lambda: semiring("cost", "long", F.when(F.col("label") == "a", 2).otherwise(5), F.lit(0), lambda l, r: l + r)
    width = lambda: semiring("width", "int", F.when(F.col("label") == "a", 2).otherwise(5), F.lit(9), F.least, least=False)
    g = graph(spark, BALANCED)
    assert rows(PathQuery(g, BALANCED_GRAMMAR).annotated(cost())) == [(0, 7, 21), (1, 6, 21)]
    assert rows(PathQuery(graph(spark, "0 a 1 | 0 b 1 | 1 b 2"), "a b | b b").annotated(cost())) == [(0, 2, 7)]
    assert rows(PathQuery(graph(spark, "0 a 1 | 0 b 1 | 1 b 2"), "( a | b ) +").annotated(width())) == [(0, 1, 5), (0, 2, 5), (1, 2, 5)]
    assert (0, 0, 0) in rows(PathQuery(graph(spark, CYCLE), "S -> a S |").annotated(cost()))


def test_counted_walks_against_listed_ones(spark):
    rng = random.Random(4)
    edges = list({(rng.randrange(5), rng.choice("ab"), rng.randrange(5)) for _ in range(12)})
    g = Graph.from_frame(spark.createDataFrame(edges, "src long, label string, dst long"))
    every = pairs(spark, *[(u, v) for u in range(5) for v in range(5)])
    for regex, bound in (("a ( a | b ) * b ?", 5), ("( a b ) *", 5), ("a b a", 3), ("a *", 1), ("a *", 0)):
        listed = PathQuery(g, regex).all_paths(every, bound).groupBy("src", "dst").count()
        assert rows(PathQuery(g, regex).count_paths(every, bound)) == rows(listed), (regex, bound)


def test_languages_from_files(spark, tmp_path):
    (tmp_path / "g.cfg").write_text(ANBN)
    (tmp_path / "g.cnf").write_text("S\n\nS -> A T\nS -> A B\nT -> S B\nA -> a\nB -> b\n")
    (tmp_path / "g.rsa").write_text("3 1 4\na 1 0 1\nS 1 1 2\nb 2 1 3 2 3\nS 1 0 3\n")
    for name in ("g.cfg", "g.cnf", "g.rsa"):
        assert rows(PathQuery(graph(spark, LINE), tmp_path / name).reach()) == [(0, 4), (1, 3)]
    assert RecursiveAutomaton.from_file(str(tmp_path / "g.rsa")).moves == RecursiveAutomaton.from_counted_text((tmp_path / "g.rsa").read_text(), "S").moves


def test_blocks_of_a_closed_product(spark):
    a = RecursiveAutomaton.from_regexes({"S": "a b", "T": "b"})
    closed = spark.createDataFrame([(q, u, r, v) for q in range(5) for r in range(5) for u, v in ((0, 1), (2, 3))], "q int, src long, q2 int, dst long")
    found = rows(product.block(closed, a))
    assert found == [("S", 0, 1), ("S", 2, 3), ("T", 0, 1), ("T", 2, 3)]


def test_sessions_forget(spark):
    one = lambda v: spark.createDataFrame([(v,)], "v long")
    session = SourceSession(PathQuery(graph(spark, BINARY_TREE), ANBN))
    session.solve(one(0))
    session.reset(sources_only=True)
    assert session.cached().count() == 4 and session.solve(one(1)).count() == 4


def test_powers_take_few_rounds(spark):
    """4,096 edges in a row: as many rounds by steps, and all pairs by powers in the logarithm of that."""
    n = 4096
    chain = Graph.from_frame(spark.range(n).selectExpr("id AS src", "'a' AS label", "id + 1 AS dst"))
    q = PathQuery(chain, "a +", strategy=ROUNDS)
    found = q.reach()
    assert found.count() == n * (n + 1) // 2 == found.distinct().count() and found.where("src < dst").count() == n * (n + 1) // 2
    assert q.rounds <= ROUNDS.square_after + 12 + 2


def test_powers_against_one_task(spark):
    rng = random.Random(12)
    edges = list({(rng.randrange(12), rng.choice("aabc"), rng.randrange(12)) for _ in range(18)})
    edges += [(100 + k, "a", 101 + k) for k in range(20)] + [(200 + k, rng.choice("ab"), 200 + (k + 1) % 17) for k in range(17)]
    g = Graph.from_frame(spark.createDataFrame(edges, "src long, label string, dst long"))
    regex = "a ( b | a a ) * c ?"
    want = rows(PathQuery(g, regex).reach())
    for strategy in (Strategy(0, square_after=1, power_factor=10**6), Strategy(0, square_after=3, power_factor=1, broadcast_bytes=0)):
        assert rows(PathQuery(g, regex, strategy=strategy).reach()) == want, strategy


def test_powers_of_the_golden_graphs(spark):
    powers = Strategy(local_edges=0, square_after=1, power_factor=100)
    assert PathQuery(graph(spark, CYCLE), "a +", strategy=powers).reach().count() == 9
    assert PathQuery(graph(spark, CYCLE), "b +", strategy=powers).reach().count() == 0
    assert rows(PathQuery(graph(spark, LOOP), "a * b c", strategy=powers).reach()) == [(0, 2)]


def test_counts_beyond_a_long(spark):
    """Bracketings of 21 threefold edges, 3^21 times the 20th Catalan number, and walks of a vertex with eight loops."""
    chain = "|".join(f" {k} {x} {k + 1} " for k in range(21) for x in "abc")
    found = PathQuery(graph(spark, chain), "S -> S S | a | b | c").count_derivations(pairs(spark, (0, 21)), 22).collect()
    assert [(r["length"], int(r["n"])) for r in found] == [(21, 3**21 * 6564120420)]
    loops = PathQuery(graph(spark, "|".join(f"0 {x} 0" for x in "abcdefgh")), "( a | b | c | d | e | f | g | h ) *")
    assert int(loops.count_paths(pairs(spark, (0, 0)), 23).first()["n_paths"]) == (8**23 - 1) // 7


def test_unambiguous_counts_are_those_of_listed_walks(spark):
    g = graph(spark, BINARY_TREE + "| 0 c 2 | 2 c 0")
    for grammar in ("S -> a S b | c S b | a b", "S -> a S b |"):
        q = PathQuery(g, grammar)
        asked = q.reach()
        assert rows(q.count_paths(asked, 7, unambiguous=True)) == rows(q.count_paths(asked, 7)), grammar


def test_sessions_keep_facts(spark):
    """A later call derives and writes only what is new; sources whose needs are known add themselves at most."""
    g = Graph.from_frame(spark.createDataFrame([(k, "a", k + 1) for k in range(10)] + [(10 + k, "b", 11 + k) for k in range(10)], "src long, label string, dst long"))
    table = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    q = PathQuery(g, ANBN)
    session = SourceSession(q)
    assert rows(session.solve(table(8))) == [(8, 12)]
    first = session.known.rows
    assert rows(session.solve(table(5, 8))) == [(5, 15), (8, 12)]
    added = session.added.count()
    assert session.known.rows == first + added and session.known.frame().distinct().count() == session.known.rows
    whole = q._facts(q.program().restricted(), REACH, table(5, 8)).distinct().count()
    assert first + added == whole and 0 < added < whole
    assert rows(session.solve(table(6))) == [(6, 14)] and session.added.count() == 0  # 5's walks needed it
    assert rows(session.cached()) == [(5, 15), (6, 14), (8, 12)]
    assert rows(session.solve(table())) == [] and rows(session.solve(table(0))) == [(0, 20)]


def test_sessions_of_many_calls(spark):
    rng = random.Random(3)
    edges = list({(rng.randrange(14), rng.choice("ab"), rng.randrange(14)) for _ in range(30)})
    g = Graph.from_frame(spark.createDataFrame(edges, "src long, label string, dst long"))
    q = PathQuery(g, "S -> S S | a S b | a b", strategy=ROUNDS)
    every = rows(q.reach())
    session = SourceSession(q)
    for v in (3, 0):
        before = session.known.rows if session.known else 0
        assert rows(session.solve(spark.createDataFrame([(v,)], "v long"))) == [r for r in every if r[0] == v]
        assert session.known.rows == before + session.added.count() == session.known.frame().distinct().count()
