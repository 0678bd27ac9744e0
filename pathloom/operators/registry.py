"""Algorithms by name, as the benchmark command asks for them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..query import PathQuery

#: name: (kind, function of a query and, for multi-source ones, the sources)
ALGORITHMS: dict[str, tuple[str, Callable[..., DataFrame]]] = {
    "reach": ("index", lambda q: q.reach()),
    "automaton": ("index", lambda q: PathQuery(q.graph, q.language if not hasattr(q.language, "productions") else _automaton(q.language), q.start, q.strategy).reach()),
    "single": ("singlepaths", lambda q: q.single_path()),
    "shortest": ("singlepaths", lambda q: q.shortest()),
    "all_paths": ("allpaths", lambda q, pairs, max_len: q.count_paths(pairs, max_len)),
    "multi_source": ("msindex", lambda q, sources: q.from_sources(sources)),
}


def _automaton(grammar):
    from ..plans.automaton import RecursiveAutomaton

    return RecursiveAutomaton.from_grammar(grammar)


def register(name: str, kind: str, f: Callable[..., DataFrame]) -> None:
    ALGORITHMS[name] = (kind, f)
