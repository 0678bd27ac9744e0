"""Pairs of a regular language over a graph of any size, in a number of rounds that grows with the logarithm of the longest walk.

The walks of an automaton are walks of the product graph, whose vertices are (state, vertex).  What is kept are the product vertices reached from the start state of each source, as facts
(state, source, vertex).  Rounds begin by steps: the last round's facts are extended by one edge.  That is the least work, but takes a round for each step of the longest
walk.  Where rounds go on and bring little next to what is known, powers take over: with all walks of up to L steps known and those of exactly m <= L + 1 steps as pairs of product vertices,
one join gives all walks of up to L + m steps, and squaring the power doubles m.  On long chains, and cycles of them, a power has no more pairs than the product has edges and each pair of
the result is derived about once.  Where a power outgrows ``power_factor`` times the facts and edges, as on dense graphs, rounds go on by steps, from the facts of the last round.

New facts and powers are measured, and broadcast while small; everything is written to the shared folder, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.annotations import REACH
from ..plans.automaton import RecursiveAutomaton
from .fixpoint import KEY, Known, Strategy, Trace, _measured, _new, small_table
from .rounds import Scratch


def useful_moves(automaton: RecursiveAutomaton) -> list[tuple[int, str, int]]:
    """Moves of the start box's states that lie between a start and a final state."""
    box = automaton.boxes[automaton.start]
    ahead, todo = set(box.starts), list(box.starts)
    while todo:
        q = todo.pop()
        for a, _, b in automaton.moves:
            if a == q and b not in ahead:
                ahead.add(b)
                todo.append(b)
    back = automaton.distances(box.finals)
    return [m for m in automaton.moves if m[0] in ahead and m[2] in back]


def _power(left: DataFrame, right: DataFrame) -> DataFrame:
    """(p, src, sym, dst): walks of ``left`` followed by walks of ``right``."""
    l = left.select("p", "src", F.col("sym").alias("r"), F.col("dst").alias("mid"))
    r = right.select(F.col("p").alias("r"), F.col("src").alias("mid"), "sym", "dst")
    return l.join(r, ["r", "mid"]).select("p", "src", "sym", "dst").distinct()


def _extended(facts: DataFrame, power: DataFrame, hint) -> DataFrame:
    """(sym, src, dst): facts followed by walks of a power."""
    l = facts.select(F.col("sym").alias("p"), F.col("src"), F.col("dst").alias("mid"))
    r = power.select("p", F.col("src").alias("mid"), "sym", "dst")
    return l.join(hint(r), ["p", "mid"]).select(*KEY).distinct()


def reached(edges: DataFrame, automaton: RecursiveAutomaton, strategy: Strategy, scratch: Scratch, trace: Trace | None = None) -> DataFrame:
    """(sym, src, dst): a walk from ``src`` to ``dst`` leads from a start state to state ``sym``; empty walks left out."""
    small = lambda size: F.broadcast if size <= strategy.broadcast_bytes else lambda df: df
    box, moves = automaton.boxes[automaton.start], useful_moves(automaton)
    rules = F.broadcast(small_table(edges.sparkSession, moves or [(-1, "", -1)], "p int, label string, sym int"))
    step = scratch.table(edges.join(rules, "label").select("p", "src", "sym", "dst").distinct(), "power-1")
    n_steps, step_bytes = _measured(step)
    delta = scratch.table(step.where(F.col("p").isin(sorted(box.starts))).select(*KEY).distinct(), "round-1")
    rows, _ = _measured(delta)
    known = Known(scratch, REACH)
    known.add("round-1", delta, rows)
    # walks of up to ``length`` steps are known; ``power`` has those of ``m``, and none once powers have grown too large
    length, m, power, power_bytes, by_steps = 1, 1, step, step_bytes, True
    count = 0
    if trace is not None:
        trace.counts.append(lambda: count)
    for k in range(2, strategy.max_rounds + 2):
        if not rows:
            return known.frame()
        count = k - 1
        if by_steps and power is not None and count >= strategy.square_after and 4 * rows <= 3 * known.rows:
            by_steps = False
        if not by_steps:
            while 2 * m <= length + 1:
                grown = scratch.table(_power(power, power), f"power-{2 * m}")
                n_grown, grown_bytes = _measured(grown)
                if n_grown > strategy.power_factor * (known.rows + n_steps):
                    scratch.drop(f"power-{2 * m}")
                    power, by_steps = None, True
                    break
                if m > 1:
                    scratch.drop(f"power-{m}")
                power, power_bytes, m = grown, grown_bytes, 2 * m
        if by_steps:
            found = _extended(delta, step, small(step_bytes))
        else:
            found = _extended(known.frame(), power, small(power_bytes))
            # walks of exactly m steps, which the known ones end before if m = length + 1
            found = found.unionByName(power.where(F.col("p").isin(sorted(box.starts))).select(*KEY)).distinct()
        delta = scratch.table(_new(found, known.frame(), REACH), f"round-{k}")
        rows, _ = _measured(delta)
        length += 1 if by_steps else m
        if rows:
            known.add(f"round-{k}", delta, rows)
    raise RuntimeError(f"no closure after {strategy.max_rounds} rounds")


def pairs(edges: DataFrame, automaton: RecursiveAutomaton, strategy: Strategy, scratch: Scratch, trace: Trace | None = None) -> DataFrame:
    """(src, dst) of all walks of the language that aren't empty."""
    finals = sorted(automaton.boxes[automaton.start].finals)
    return reached(edges, automaton, strategy, scratch, trace).where(F.col("sym").isin(finals)).select("src", "dst").distinct()
