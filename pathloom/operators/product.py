"""Operators of the product view: automaton moves against edges, and the parts that rule programs are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.automaton import RecursiveAutomaton
from ..plans.grammar import Grammar
from .fixpoint import Strategy, small_table
from .rounds import Scratch
from .twins import twins


def moves_table(edges: DataFrame, automaton: RecursiveAutomaton) -> DataFrame:
    return small_table(edges.sparkSession, [m for m in automaton.moves], "q int, label string, q2 int")


def boxes_table(edges: DataFrame, automaton: RecursiveAutomaton) -> DataFrame:
    rows = [(n, q, q in b.starts, q in b.finals) for n, b in automaton.boxes.items() for q in sorted(b.starts | b.finals)]
    return small_table(edges.sparkSession, rows, "nt string, q int, is_start boolean, is_final boolean")


def product_edges(edges: DataFrame, automaton: RecursiveAutomaton) -> DataFrame:
    """(q, src, label, q2, dst): one step of automaton and graph together; the moves are broadcast, the edges don't move."""
    return edges.join(F.broadcast(moves_table(edges, automaton)), "label").select("q", "src", "label", "q2", "dst")


def terminal_facts(edges: DataFrame, grammar: Grammar) -> DataFrame:
    """(nt, src, dst) of the rules A -> t."""
    rules = [(h, b[0]) for h, b in grammar.productions if len(b) == 1 and b[0] in grammar.terminals]
    return edges.join(F.broadcast(small_table(edges.sparkSession, rules, "nt string, label string")), "label").select("nt", "src", "dst").distinct()


def epsilon_facts(vertices: DataFrame, grammar: Grammar) -> DataFrame:
    """(nt, v, v) of every nullable nonterminal and vertex: the one product of two tables, and one of them is the query's."""
    v = F.col(vertices.columns[0])
    names = F.array(*(F.lit(n) for n in sorted(grammar.nullable()))) if grammar.nullable() else F.array().cast("array<string>")
    return vertices.select(F.explode(names).alias("nt"), v.alias("src"), v.alias("dst"))


def step_pairs(left: DataFrame, right: DataFrame, strategy: Strategy = Strategy()) -> DataFrame:
    """Distinct (src, dst) of a pair of ``left`` followed by one of ``right``; by classes of vertices with the same pairs where there are such."""
    kinds = {df.schema[c].dataType for df in (left, right) for c in ("src", "dst")}
    if len(kinds) == 1:
        both = left.select("src", F.lit("l").alias("label"), "dst").unionByName(right.select("src", F.lit("r").alias("label"), "dst"))
        found = twins(both, Scratch(left.sparkSession, "step"), strategy.twin_edges) if both.where(F.col("src").isNull() | F.col("dst").isNull()).isEmpty() else None
        if found is not None:
            own = lambda label: found.edges.where(F.col("label") == label)
            return found.expanded(_step_pairs(own("l"), own("r")))
    return _step_pairs(left, right)


def _step_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    l, r = left.select("src", F.col("dst").alias("mid")), right.select(F.col("src").alias("mid"), "dst")
    return l.join(r, "mid").select("src", "dst").distinct()


def masked(pairs: DataFrame, sources: DataFrame) -> DataFrame:
    """The pairs whose source is asked for."""
    return pairs.join(sources.select(F.col(sources.columns[0]).alias("src")).distinct(), "src", "left_semi")


def next_sources(pairs: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """Distinct ends of the pairs, without those done already."""
    ends = pairs.select(F.col("dst").alias("v")).distinct()
    return ends if done is None else ends.join(done.select(F.col(done.columns[0]).alias("v")), "v", "left_anti")


def block(closure: DataFrame, automaton: RecursiveAutomaton) -> DataFrame:
    """(nt, src, dst) of a closed product (q, src, q2, dst) that leads from a box's start to one of its final states."""
    boxes = boxes_table(closure, automaton)
    starts = boxes.where("is_start").select("nt", "q")
    finals = boxes.where("is_final").select("nt", F.col("q").alias("q2"))
    return closure.join(F.broadcast(starts), "q").join(F.broadcast(finals), ["nt", "q2"]).select("nt", "src", "dst").distinct()
