"""Derivations by height and length, several values of a fact, and midpoints, against plain enumeration of derivation trees."""

import random
from collections import Counter
from functools import lru_cache

import pytest

from pyspark.sql import functions as F

from pathloom.functions.annotations import k_least, shorter
from pathloom.operators import paths, registry
from pathloom.operators.fixpoint import Scratch, Strategy
from pathloom.query import PathQuery
from pathloom.sources.graphs import Graph

ROUNDS = Strategy(local_edges=0, broadcast_bytes=0)
#: in normal form already: (head, first, second) and (head, label)
GRAMMAR = "S -> S S\nS -> A T\nT -> S B\nS -> A B\nA -> a\nB -> b"
RULES = [("S", "S", "S"), ("S", "A", "T"), ("T", "S", "B"), ("S", "A", "B")]
SEEDS = {("A", "a"), ("B", "b")}


def random_edges(seed, n, m):
    rng = random.Random(seed)
    return sorted({(rng.randrange(n), rng.choice("ab"), rng.randrange(n)) for _ in range(m)})


def frame(spark, edges):
    return Graph.from_frame(spark.createDataFrame(edges, "src long, label string, dst long"))


def trees(edges, n):
    """Functions of a fact: the edges of its trees of at most a height, and its trees by their walk, of exactly a length."""

    @lru_cache(None)
    def within(sym, u, v, height):
        out = {e for e in edges if e[0] == u and e[2] == v and (sym, e[1]) in SEEDS}
        if height > 1:
            for head, x, y in RULES:
                for m in range(n) if head == sym else ():
                    l, r = within(x, u, m, height - 1), within(y, m, v, height - 1)
                    out |= l | r if l and r else set()
        return frozenset(out) if height > 0 else frozenset()

    @lru_cache(None)
    def of_length(sym, u, v, length):
        out = Counter({(e,): 1 for e in edges if length == 1 and e[0] == u and e[2] == v and (sym, e[1]) in SEEDS})
        for head, x, y in RULES:
            for m in range(n) if head == sym else ():
                for k in range(1, length):
                    for p, i in of_length(x, u, m, k).items():
                        for q, j in of_length(y, m, v, length - k).items():
                            out[p + q] += i * j
        return out

    return within, of_length


@pytest.mark.parametrize("strategy", [Strategy(), ROUNDS])
def test_subgraphs_by_height(spark, strategy):
    edges = random_edges(4, 6, 13)
    within, _ = trees(edges, 6)
    q = PathQuery(frame(spark, edges), GRAMMAR, strategy=strategy)
    every = [(u, v) for u in range(6) for v in range(6)]
    sizes = []
    for some, heights in ((every, (0, 3)), (every[3:9], (2, 6))):
        asked = spark.createDataFrame(some + some[:1], "src long, dst long")
        for height in heights:
            want = set().union(*(within("S", u, v, height) for u, v in some))
            got = [tuple(r) for r in q.subgraph(asked, max_height=height).collect()]
            assert sorted(got) == sorted(want), height
            sizes.append(len(want))
    assert {tuple(r) for r in q.subgraph(asked).collect()} == set().union(*(within("S", u, v, 14) for u, v in some))
    assert sizes[2:] == [4, 13]


@pytest.mark.parametrize("strategy", [Strategy(), ROUNDS])
def test_walks_and_counts_of_a_cyclic_graph(spark, strategy):
    edges = random_edges(8, 4, 8)
    _, of_length = trees(edges, 4)
    q = PathQuery(frame(spark, edges), GRAMMAR, strategy=strategy)
    asked = [(u, v) for u in range(4) for v in range(4) if (u + v) % 3]
    pairs = spark.createDataFrame(asked, "src long, dst long")
    for bound in (1, 7):
        listed, counted = set(), {}
        for u, v in asked:
            for n in range(1, bound):
                if found := of_length("S", u, v, n):
                    listed |= {(u, v, n, p) for p in found}
                    counted[u, v, n] = sum(found.values())
        got = {(r["src"], r["dst"], r["length"], tuple(tuple(s) for s in r["path"])) for r in q.all_paths(pairs, bound).collect()}
        assert got == listed, bound
        assert {(r["src"], r["dst"], r["length"]): int(r["n"]) for r in q.count_derivations(pairs, bound).collect()} == counted, bound
    assert len(listed) > 10


def test_bounded_lengths_stop_rounds(spark):
    """Facts of longer walks are not derived: a chain of 60 edges asks for as many rounds as the bound has, and for facts near the root alone."""
    chain = [(k, "a", k + 1) for k in range(60)]
    for strategy in (Strategy(), ROUNDS):
        q = PathQuery(frame(spark, chain), "S -> a S | a", strategy=strategy)
        facts = q._facts(q.grammar.compile("S"), shorter(5))
        assert facts.agg(F.max("length")).first()[0] == 4 and q.rounds <= 5
    p = q.grammar.compile("S")
    need, ways = paths.forest(facts, p, q._roots(spark.createDataFrame([(10, 14)], "src long, dst long"), p), 5, Scratch(spark, "t"))
    assert need.agg(F.min("src"), F.max("dst")).first() == (10, 14) and ways.count() == 3
    assert {r["most"] for r in need.collect()} == {1, 2, 3, 4}


@pytest.mark.parametrize("strategy", [Strategy(), Strategy(local_edges=0, direct_facts=0, broadcast_bytes=0)])
def test_several_least_values(spark, strategy):
    edges = random_edges(8, 4, 8)
    _, of_length = trees(edges, 4)
    q = PathQuery(frame(spark, edges), GRAMMAR, strategy=strategy)
    # a Dyck word of length n costs 5 / 2 n, so those that are not listed are longer than 10 and cost more than 25
    for k, price, least, most in ((2, {"a": 1, "b": 1}, k_least(2), 10), (3, {"a": 1, "b": 4}, k_least(3, F.when(F.col("label") == "a", 1).otherwise(4)), 25)):
        want = {}
        for u in range(4):
            for v in range(4):
                if sums := sorted({sum(price[e[1]] for e in p) for n in range(1, 11) for p in of_length("S", u, v, n)})[:k]:
                    want[u, v] = sums
        got = {(r["src"], r["dst"]): [x for x in r["values"] if x <= most] for r in q.annotated(least).collect()}
        assert {x: v for x, v in got.items() if v} == want and max(len(v) for v in want.values()) == k


def test_least_values_of_empty_walks_and_plans_without_recursion(spark):
    loop = [(0, "a", 1), (1, "a", 0)]
    got = {(r["src"], r["dst"]): r["values"] for r in PathQuery(frame(spark, loop), "S -> a S |").annotated(k_least(3)).collect()}
    assert got == {(0, 0): [0, 2, 4], (1, 1): [0, 2, 4], (0, 1): [1, 3, 5], (1, 0): [1, 3, 5]}
    got = PathQuery(frame(spark, [(0, "a", 1), (1, "b", 2), (0, "c", 2)]), "a b | c").annotated(k_least(2)).collect()
    assert [tuple(r) for r in got] == [(0, 2, [1, 2])]


def test_midpoint_rows(spark):
    q = PathQuery(frame(spark, [(0, "a", 1), (1, "a", 2), (2, "a", 3), (0, "a", 3), (0, "a", 3)]), "S -> S S | a")
    got = sorted((r["src"], r["dst"], -1 if r["mid"] is None else r["mid"]) for r in q.midpoint_rows().collect())
    assert got == [(0, 1, -1), (0, 2, 1), (0, 3, -1), (0, 3, 1), (0, 3, 2), (1, 2, -1), (1, 3, 2), (2, 3, -1)]
    assert {(r["src"], r["dst"]): (r["mids"], r["is_edge"]) for r in q.midpoints().collect()}[0, 3] == ([1, 2], True)


def test_algorithms_of_ones_own(spark):
    registry.register("two least", "index", lambda q: q.annotated(k_least(2)).select("src", "dst"))
    try:
        q = PathQuery(frame(spark, [(0, "a", 1), (1, "b", 2)]), "a b")
        assert [tuple(r) for r in registry.ALGORITHMS["two least"][1](q).collect()] == [(0, 2)]
    finally:
        del registry.ALGORITHMS["two least"]
