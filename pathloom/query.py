"""The query façade: a graph, a language, and what is asked of them.

    q = PathQuery(Graph.from_text(spark, "edges.txt"), "S -> a S b | a b")
    q.reach().count(); q.shortest(); q.from_sources(some_vertices); q.all_paths(pairs, 5)
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.annotations import REACH, SHORTEST, SINGLE, Annotation, shorter
from .operators import closure, paths
from .operators.fixpoint import KEY, Known, Strategy, Trace, small_table, solve, solve_parts, solve_straight
from .operators.rounds import Scratch
from .operators.twins import Twins, class_walks, twins
from .plans.automaton import RecursiveAutomaton
from .plans.grammar import Grammar
from .plans.program import Program
from .sources.graphs import Graph

Language = Grammar | RecursiveAutomaton | str | Path


def parse(language: Language, start: str | None = None) -> Grammar | RecursiveAutomaton:
    """Text with an arrow is a grammar; without, a regular expression.  A path is a file: ``.cnf`` in normal form, with arrows a grammar, else an automaton."""
    if isinstance(language, Path):
        text = language.read_text(encoding="utf-8")
        if language.suffix == ".cnf":
            return Grammar.from_cnf_text(text)
        return Grammar.from_text(text, start) if "->" in text else RecursiveAutomaton.from_counted_text(text, start or "S")
    if not isinstance(language, str):
        return language
    return Grammar.from_text(language, start) if "->" in language else RecursiveAutomaton.from_regexes({start or "S": language})


@dataclass
class PathQuery:
    """``strategy.local_edges = 0`` sends everything through distributed rounds."""

    graph: Graph
    language: Language
    start: str | None = None
    strategy: Strategy = field(default_factory=Strategy)
    #: how the last evaluation went
    trace: Trace = field(default_factory=Trace, repr=False)
    _held: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        self.language = parse(self.language, self.start)
        self.start = self.start or self.language.start

    @cached_property
    def grammar(self) -> Grammar:
        return self.language if isinstance(self.language, Grammar) else self.language.to_grammar()

    def program(self, keep: set[str] = frozenset()) -> Program:
        return self.language.compile(self.start, keep)

    def _facts(self, program: Program, a: Annotation, sources: DataFrame | None = None) -> DataFrame:
        """All facts of the program, as tables of the shared folder; those that need no sources are kept for this query's other results."""
        key = (a, program.symbols, program.seeds, program.binary, program.unary)
        if sources is None and key in self._held:
            return self._held[key]
        spark, edges = self.graph.edges.sparkSession, self.graph.edges.select("src", "label", "dst")
        scratch, self.trace = Scratch(spark, "query"), Trace()
        if not program.labels:
            facts = solve(edges.where(F.lit(False)), program, a, sources, self.strategy, scratch, self.trace)
        elif a.local and self._in_tasks(program):
            facts = solve_parts(self.graph.edges, program, a, sources, self.graph.part, self.strategy, scratch, self.trace)
        elif sources is None and not program.recursive:
            facts = solve_straight(edges, program, a, scratch)
        else:
            facts = solve(edges, program, a, sources, self.strategy, scratch, self.trace)
            facts = scratch.table(facts, "best") if a.improves else facts
        if sources is None:
            self._held[key] = facts
        return facts

    def _by_classes(self, labels: list[str], share: int = 1) -> tuple[Twins, "PathQuery"] | None:
        """The classes of vertices with the same edges, and this query on their graph; None where that isn't much smaller."""
        if self.graph.part is not None or not labels:
            return None
        key = ("classes", tuple(labels), share)
        if key not in self._held:
            edges = self.graph.edges.where(F.col("label").isin(labels))
            found = twins(edges, Scratch(edges.sparkSession, "twins"), self.strategy.twin_edges // share)
            self._held[key] = found and (found, PathQuery(Graph(found.edges), self.language, self.start, self.strategy, _held={"edges": found.size}))
        return self._held[key]

    def _all(self, program: Program, a: Annotation, sources: DataFrame | None = None) -> DataFrame:
        """All facts, or those of the start symbol alone by classes of vertices where there are such, since few edges of twins may have more pairs than a task makes; from ``sources`` alone then."""
        regular = lambda q: a == REACH and sources is None and q._by_powers(program)
        # merges of several sums cost more than facts, so classes pay on fewer edges
        if found := self._by_classes(program.labels, 4 if a.least else 1) if a.uniform else None:
            classes, inner = found
            own = None if sources is None else classes.names(sources.where(F.col(sources.columns[0]).isNotNull()))
            facts = inner._regular(program) if regular(inner) else inner._facts(program, a, own)
            self.trace = inner.trace
            return classes.expanded(facts.where(F.col("sym") == program.names[self.start]).select("sym", "src", "dst", *a.values), sources=sources)
        return self._regular(program) if regular(self) else self._facts(program, a, sources)

    def _in_tasks(self, program: Program) -> bool:
        """Whether the graph comes in parts, or is found small itself: one row more than allowed is enough to know that it isn't."""
        most = self.strategy.local_edges
        if most <= 0 or self.graph.part is not None:
            return most > 0
        if self._held.get("edges", most + 1) <= most:  # a graph of classes was counted as it was made
            return True
        return self.graph.edges.where(F.col("label").isin(program.labels)).limit(most + 1).count() <= most

    @property
    def rounds(self) -> int:
        """Rounds of the last evaluation: of its longest part, the last one, which found nothing, included; 0 for a plan without rounds."""
        return self.trace.rounds

    def _result(self, facts: DataFrame, program: Program, name: str, a: Annotation, sources: DataFrame | None = None) -> DataFrame:
        """Facts of one nonterminal with its empty walks."""
        sym = program.names[name]
        found = facts.where(F.col("sym") == sym).select("src", "dst", *a.values)
        if sym not in program.nullable:
            return found
        domain = self.graph.domain()
        if sources is not None:
            domain = domain.join(sources.select(F.col(sources.columns[0]).alias("v")).distinct(), "v", "left_semi")
        nothing = [c for c, (n, _) in zip(a.empty(), a.columns) if n in a.values]
        empty = domain.select(F.col("v").alias("src"), F.col("v").alias("dst"), *nothing)
        if not nothing:
            return found.unionByName(empty).distinct()
        if a.gather:
            return a.gather(found.unionByName(empty), ["src", "dst"])
        if a.better and a.name != "shortest":  # a walk may be better than the empty one
            (value,) = a.values
            return found.unionByName(empty).groupBy("src", "dst").agg(*a.plus()).select("src", "dst", value)
        return found.join(empty, ["src", "dst"], "left_anti").unionByName(empty)

    def reach(self) -> DataFrame:
        """(src, dst) of all pairs that a walk of the language joins."""
        p = self.program()
        return self._result(self._all(p, REACH), p, self.start, REACH)

    def _by_powers(self, program: Program) -> bool:
        """Whether the pairs are those of one recursive regular box, on a graph that no task solves."""
        a = self.language
        return isinstance(a, RecursiveAutomaton) and a.regular and a.start == self.start and program.recursive and bool(program.labels) and not self._in_tasks(program)

    def _regular(self, program: Program) -> DataFrame:
        """The start symbol's facts, by steps and powers of the product graph."""
        if "pairs" not in self._held:
            edges = self.graph.edges.select("src", "label", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
            scratch, self.trace = Scratch(edges.sparkSession, "query"), Trace()
            found = closure.pairs(edges, self.language, self.strategy, scratch, self.trace)
            self._held["pairs"] = scratch.table(found.select(F.lit(program.start).alias("sym"), "src", "dst"), "pairs")
            scratch.drop_all_but("pairs")
        return self._held["pairs"]

    def reach_all(self, nonterminals: list[str] | None = None) -> DataFrame:
        """(nonterminal, src, dst) of several nonterminals, all by default."""
        own = self.language.nonterminals if isinstance(self.language, Grammar) else set(self.language.boxes)
        names = sorted(nonterminals or own)
        p = self.program(set(names))
        facts, out = self._facts(p, REACH), None
        for n in names:
            one = self._result(facts, p, n, REACH).select(F.lit(n).alias("nonterminal"), "src", "dst")
            out = one if out is None else out.unionByName(one)
        return out

    def nonterminal_counts(self) -> DataFrame:
        return self.reach_all().groupBy("nonterminal").agg(F.count("*").alias("n_pairs"))

    def shortest(self) -> DataFrame:
        """(src, dst, length) with the least number of edges; 0 for empty walks."""
        p = self.grammar.compile(self.start)
        return self._result(self._all(p, SHORTEST), p, self.start, SHORTEST)

    def annotated(self, a: Annotation) -> DataFrame:
        """(src, dst and the annotation's value) of the best walk under an annotation of one's own (``functions.annotations.semiring``)."""
        p = self.grammar.compile(self.start)
        return self._result(self._all(p, a), p, self.start, a)

    def single_path(self) -> DataFrame:
        """(src, dst, height, length) of one witness: least height, then least length."""
        p = self.grammar.compile(self.start)
        return self._result(self._facts(p, SINGLE), p, self.start, SINGLE)

    def single_path_edges(self, pairs: DataFrame | None = None) -> DataFrame:
        """(root_src, root_dst, pos, src, label, dst): the edges of the witnesses of ``pairs`` (src, dst), all pairs by default."""
        scratch = Scratch(self.graph.edges.sparkSession, "witness")
        p = self.grammar.compile(self.start)
        facts = self._facts(p, SINGLE)
        roots = facts.where(F.col("sym") == p.names[self.start])
        if pairs is not None:
            roots = roots.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
        return paths.witnesses(self.graph.edges, facts, roots.select("sym", "src", "dst"), p, scratch)

    def from_sources(self, sources: DataFrame) -> DataFrame:
        """(src, dst) of the pairs whose source is in the one-column table ``sources``; only what those need is derived."""
        p = self.program()
        restricted = p.restricted()
        facts = self._all(restricted, REACH, sources)
        if self._by_classes(restricted.labels):
            return self._result(facts, p, self.start, REACH, sources)
        own = sources.select(F.col(sources.columns[0]).alias("src")).distinct()
        found = self._result(facts, p, self.start, REACH, sources)
        return found.join(own, "src", "left_semi")

    def needed_facts(self, sources: DataFrame) -> DataFrame:
        """(src, dst) facts of the start nonterminal derived on the way, from sources or from vertices that they need."""
        p = self.program()
        facts = self._facts(p.restricted(), REACH, sources)
        return self._result(facts, p, self.start, REACH, sources)

    def _forest(self, pairs: DataFrame | None, max_len: int, scratch: Scratch) -> tuple[Program, DataFrame, DataFrame]:
        """The program and, as tables, the facts and derivations that walks of ``pairs`` with fewer than ``max_len`` edges can have; facts of longer walks alone are never derived."""
        p = self.grammar.compile(self.start)
        facts = self._facts(p, shorter(max_len))
        return p, *paths.forest(facts, p, self._roots(pairs, p) if pairs is not None else facts.where(F.col("sym") == p.names[self.start]), max_len, scratch, self.strategy.broadcast_bytes)

    def _roots(self, pairs: DataFrame, p: Program) -> DataFrame:
        return pairs.select("src", "dst").distinct().withColumn("sym", F.lit(p.names[self.start]))

    def _empty_walks(self, pairs: DataFrame | None, p: Program) -> DataFrame | None:
        if p.names[self.start] not in p.nullable:
            return None
        if pairs is None:
            return self.graph.domain().select(F.col("v").alias("src"), F.col("v").alias("dst"))
        return pairs.select("src", "dst").distinct().where(F.col("src") == F.col("dst")).join(self.graph.domain(), F.col("src") == F.col("v"), "left_semi")

    def all_paths(self, pairs: DataFrame | None, max_len: int) -> DataFrame:
        """(src, dst, length, path) of all distinct walks, of all pairs if None, with fewer than ``max_len`` edges."""
        scratch = Scratch(self.graph.edges.sparkSession, "walks")
        found = self._walks_by_classes(max_len, scratch) if pairs is None else None
        if found is None:
            p, need, ways = self._forest(pairs, max_len, scratch)
            found = paths.walks(self.graph.edges, need, ways, p, max_len, scratch).where(F.col("sym") == p.names[self.start])
            found = (found if pairs is None else found.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")).select("src", "dst", "length", "path")
        p = self.grammar.compile(self.start)
        if (empty := self._empty_walks(pairs, p)) is not None and max_len > 0:
            kind = found.schema["path"].dataType.simpleString()
            found = found.unionByName(empty.select("src", "dst", F.lit(0).cast("long").alias("length"), F.array().cast(kind).alias("path")))
        return found

    def _walks_by_classes(self, max_len: int, scratch: Scratch) -> DataFrame | None:
        """All walks of a deterministic automaton, from those between classes of vertices; None for other languages and graphs.  Runs are distinct, so walks needn't be compared."""
        a = self.language
        if not (isinstance(a, RecursiveAutomaton) and a.start == self.start and a.deterministic):
            return None
        moves, box = closure.useful_moves(a), a.boxes[a.start]
        found = self._by_classes(sorted({m[1] for m in moves}))
        if not found:
            return None
        out = None
        for n, walk in class_walks(found[0], moves, *box.starts, sorted(box.finals), max_len, scratch):
            each = found[0].expanded(walk, tuple(f"v{k}" for k in range(n + 1)))
            step = [F.struct(F.col(f"v{k - 1}").alias("src"), F.col(f"label{k}").alias("label"), F.col(f"v{k}").alias("dst")) for k in range(1, n + 1)]
            one = each.select(F.col("v0").alias("src"), F.col(f"v{n}").alias("dst"), F.lit(n).cast("long").alias("length"), F.array(*step).alias("path"))
            out = one if out is None else out.unionByName(one)
        return out

    def count_paths(self, pairs: DataFrame | None, max_len: int, unambiguous: bool = False) -> DataFrame:
        """(src, dst, n_paths) of the pairs, all if None, with a walk below the bound.

        For a regular language, and for a grammar that the caller knows to be ``unambiguous``, the walks are counted without being listed: by states, or as derivations.  Such counts are
        decimals of 38 digits, since they grow exponentially with the bound."""
        a = self.language
        if unambiguous and isinstance(a, Grammar):
            found = self.count_derivations(pairs, max_len).select("src", "dst", "n")
            if (empty := self._empty_walks(pairs, a.compile(self.start))) is not None and max_len > 0:
                found = found.unionByName(empty.select("src", "dst", F.lit(1).cast(paths.COUNT).alias("n")))
            return found.groupBy("src", "dst").agg(F.sum("n").cast(paths.COUNT).alias("n_paths"))
        if not (isinstance(a, RecursiveAutomaton) and a.start == self.start and a.deterministic):
            return self.all_paths(pairs, max_len).groupBy("src", "dst").agg(F.count("*").alias("n_paths"))
        scratch = Scratch(self.graph.edges.sparkSession, "walk-counts")
        if pairs is None and (own := self._by_classes(sorted({m[1] for m in closure.useful_moves(a)}))):
            found = own[0].expanded(scratch.table(paths.count_walks(own[0].edges, a, None, max_len, scratch, own[0].sizes), "class-counts"))
        else:
            found = paths.count_walks(self.graph.edges, a, pairs, max_len, scratch)
        if a.boxes[a.start].starts & a.boxes[a.start].finals and max_len > 0:
            own = self.graph.domain().select(F.col("v").alias("src"), F.col("v").alias("dst"))
            own = own if pairs is None else own.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi")
            found = found.unionByName(own.select("src", "dst", F.lit(1).cast(paths.COUNT).alias("n_paths"))).groupBy("src", "dst").agg(F.sum("n_paths").cast(paths.COUNT).alias("n_paths"))
        return found

    def count_derivations(self, pairs: DataFrame | None, max_len: int, _sizes: DataFrame | None = None) -> DataFrame:
        """(src, dst, length, n), of all pairs if None: derivations of the normalised grammar by length, as decimals of 38 digits; as many as walks if it is unambiguous."""
        if pairs is None and _sizes is None and (own := self._by_classes(self.grammar.compile(self.start).labels)):
            return own[0].expanded(own[1].count_derivations(None, max_len, own[0].sizes))
        scratch = Scratch(self.graph.edges.sparkSession, "counts")
        p, need, ways = self._forest(pairs, max_len, scratch)
        found = paths.derivation_counts(self.graph.edges, need, ways, p, max_len, scratch, _sizes)
        if pairs is None:
            return found.where(F.col("sym") == p.names[self.start]).select("src", "dst", "length", "n")
        return found.where(F.col("sym") == p.names[self.start]).join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_semi").select("src", "dst", "length", "n")

    def subgraph(self, pairs: DataFrame, max_height: int | None = None) -> DataFrame:
        """(src, label, dst) of the edges on accepted walks of any of ``pairs``; with ``max_height``, of walks with a derivation of at most that height, where an edge has
        height 1 and a binary rule of the normalised grammar one more than the higher of its parts."""
        scratch = Scratch(self.graph.edges.sparkSession, "subgraph")
        p = self.grammar.compile(self.start)
        facts = self._facts(p, REACH if max_height is None else SINGLE)
        need = paths.needed(facts, p, self._roots(pairs, p), scratch, max_height, self.strategy.broadcast_bytes)
        return paths.subgraph(self.graph.edges, need, p)

    def midpoint_rows(self) -> DataFrame:
        """(nonterminal, src, dst, mid): a row for each midpoint of every fact of a named nonterminal, and one with null for a fact that is an edge; nothing is gathered."""
        p = self.grammar.compile(self.start, self.grammar.nonterminals & self.grammar.productive())
        facts = self._facts(p, REACH)
        names = F.broadcast(small_table(facts.sparkSession, [(n, s) for n, s in p.names.items()], "nonterminal string, sym int"))
        # only facts of named nonterminals are split
        own = facts.where(F.col("sym").isin(sorted(p.names.values())))
        split = paths.derivations(facts, p, own).select("sym", "src", "dst", "mid").distinct()
        edge = paths._terminal(own, self.graph.edges, p).select("sym", "src", "dst", F.lit(None).cast(split.schema["mid"].dataType).alias("mid")).distinct()
        return split.unionByName(edge).join(names, "sym").select("nonterminal", "src", "dst", "mid")

    def midpoints(self) -> DataFrame:
        """(nonterminal, src, dst, mids): all midpoints of every fact of a named nonterminal in one array (``midpoint_rows`` has them as rows); null for a fact that is an edge."""
        return self.midpoint_rows().groupBy("nonterminal", "src", "dst").agg(F.sort_array(F.collect_list("mid")).alias("mids"), F.max(F.col("mid").isNull()).alias("is_edge"))


class SourceSession:
    """Multi-source queries that keep what earlier calls derived: the facts of all symbols, and what they need.

    A call adds its new sources to those needs and goes on from the facts, so rounds derive only what no earlier call has; sources whose needs an earlier call had on
    its way cost no round that finds anything.  A graph that tasks solve is solved there for the new sources alone.  Either way only new facts are written, as a few tables of
    geometrically growing size in the shared folder.
    """

    def __init__(self, query: PathQuery):
        self.query = query
        self.scratch = Scratch(query.graph.edges.sparkSession, "session")
        self.calls = 0
        self.reset()

    def reset(self, sources_only: bool = False) -> None:
        """Forget the sources that were solved and, unless ``sources_only``, all facts."""
        self.done: DataFrame | None = None
        if not sources_only:
            self.asked: DataFrame | None = None
            self.known: Known | None = None
            #: facts that the last call added
            self.added: DataFrame | None = None

    def _solve(self, new: DataFrame) -> DataFrame:
        """The facts that new sources add."""
        q = self.query
        program, edges = q.program().restricted(), q.graph.edges
        if self.known is None:
            return q._facts(program, REACH, new)
        if q._in_tasks(program):
            return q._facts(program, REACH, new).distinct().join(self.known.frame(), KEY, "left_anti")
        scratch, q.trace = Scratch(edges.sparkSession, "session-rounds"), Trace()
        none = edges.select("src", "label", "dst").where(F.lit(False))
        return solve(none, program, REACH, new, q.strategy, scratch, q.trace, known=self.known.frame())

    def solve(self, sources: DataFrame) -> DataFrame:
        """(src, dst) of the pairs from ``sources``."""
        kind = self.query.graph.edges.schema["src"].dataType
        own = sources.select(F.col(sources.columns[0]).cast(kind).alias("src")).where(F.col("src").isNotNull()).distinct()
        new = own if self.done is None else own.join(self.done, "src", "left_anti")
        new = self.scratch.table(new, f"new-{self.calls}")
        if not new.isEmpty() or self.known is None:
            name = f"facts-{self.calls}"
            self.added = self.scratch.table(self._solve(new).select(*KEY), name)
            self.known = self.known or Known(self.scratch, REACH)
            self.known.add(name, self.added, self.added.count())
            self.done = self.scratch.table(new if self.done is None else self.done.unionByName(new), f"done-{self.calls}")
            self.asked = self.scratch.table(new if self.asked is None else self.asked.unionByName(new).distinct(), f"asked-{self.calls}")
            self.calls += 1
        return self._pairs(own)

    def _pairs(self, own: DataFrame) -> DataFrame:
        p = self.query.program()
        return self.query._result(self.known.frame(), p, self.query.start, REACH, own).join(own, "src", "left_semi")

    def cached(self) -> DataFrame | None:
        """The pairs of all sources that calls have solved so far, those of before a reset of the sources only included."""
        return self._pairs(self.asked) if self.known is not None else None
