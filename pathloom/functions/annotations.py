"""Annotations of facts: what a fact carries, how two facts' values combine, and which value is kept.

Three are built in; ``semiring`` makes others from three expressions, ``k_least`` keeps several values of a fact, ``shorter`` bounds lengths while facts are derived.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: the columns that name a fact's split; the others are values
SPLIT = ("mid", "r1", "r2")


@dataclass(frozen=True)
class Annotation:
    """``columns`` are (name, Spark type; ``vertex``: that of the graph's vertices).

    ``edge`` and ``empty`` give the columns of an edge's fact and of the empty walk's, ``times`` those of two facts that follow each other (as columns l_*, r_*,
    mid, r1 and r2), ``plus`` the aggregates that keep the best.  ``better``: a fact may be derived again, and takes the new value if this holds of (new, old).

    Where no value is better than all others, ``merge`` makes one of (new, old) and ``gather`` one row of all rows under the given key columns, instead of ``plus`` and ``better``.  A fact
    whose merged value differs from its old one is new again.  Merging must be associative and commutative and not count a value twice, since old values come back in merged ones.
    """

    name: str
    columns: tuple[tuple[str, str], ...] = ()
    edge: Callable[[], list[Column]] = list
    empty: Callable[[], list[Column]] = list
    times: Callable[[], list[Column]] = list
    plus: Callable[[], list[Column]] = list
    better: Callable[[Column, Column], Column] | None = None
    merge: Callable[[Column, Column], Column] | None = None
    gather: Callable[[DataFrame, list[str]], DataFrame] | None = None
    #: facts of a greater value are dropped when they are derived
    most: int | None = None
    #: known to the solver that works within one task
    local: bool = False
    #: the value is so many least sums, of 1 for each edge where ``local``
    least: int | None = None
    #: an edge's value depends on its label alone, so vertices with the same edges have the same values
    uniform: bool = False

    @property
    def values(self) -> list[str]:
        return [n for n, _ in self.columns if n not in SPLIT]

    @property
    def improves(self) -> bool:
        """Whether a known fact may be derived again with another value."""
        return self.better is not None or self.merge is not None


def semiring(name: str, kind: str, edge: Column, empty: Column, times: Callable[[Column, Column], Column], least: bool = True, column: str = "value") -> Annotation:
    """A value for each walk, of which the least (or greatest) is kept.

    ``edge`` is an expression over src, label and dst, ``times`` combines the values of two walks that follow each other, ``empty`` is the empty walk's value.
    A longer walk must not be better than each of its parts, or the rounds need not end.
    """
    best = F.min if least else F.max
    return Annotation(
        name, ((column, kind),),
        edge=lambda: [edge.cast(kind).alias(column)],
        empty=lambda: [empty.cast(kind).alias(column)],
        times=lambda: [times(F.col(f"l_{column}"), F.col(f"r_{column}")).cast(kind).alias(column)],
        plus=lambda: [best(column).alias(column)],
        better=(lambda new, old: new < old) if least else (lambda new, old: new > old),
    )


def k_least(k: int, edge: Column | None = None, column: str = "values") -> Annotation:
    """The ``k`` least distinct sums of ``edge`` (a whole number of an edge's src, label and dst; 1 by default, so lengths) over the walks of a fact, ascending, as an array.

    Sums may not be negative, or the rounds need not end.
    """
    step = (F.lit(1) if edge is None else edge).cast("long")
    cut = lambda c: F.slice(F.array_sort(F.array_distinct(c)), 1, k)

    def gather(facts: DataFrame, key: list[str]) -> DataFrame:
        # equal sums meet first, in as many groups as there are sums; then no task sees more than k of a fact from any other
        each = facts.select(*key, F.explode(column).alias(column)).distinct()
        order = F.row_number().over(Window.partitionBy(*key).orderBy(column))
        return each.withColumn("__k", order).where(F.col("__k") <= k).groupBy(*key).agg(F.sort_array(F.collect_list(column)).alias(column))

    return Annotation(
        f"least-{k}", ((column, "array<bigint>"),),
        edge=lambda: [F.array(step).alias(column)],
        empty=lambda: [F.array(F.lit(0).cast("long")).alias(column)],
        times=lambda: [cut(F.flatten(F.transform(f"l_{column}", lambda x: F.transform(f"r_{column}", lambda y: x + y)))).alias(column)],
        merge=lambda new, old: cut(F.concat(new, old)),
        gather=gather,
        local=edge is None and k > 0,
        least=k,
        uniform=edge is None,
    )


REACH = Annotation("reach", local=True, uniform=True)


#: least number of edges
SHORTEST = Annotation(
    "shortest", (("length", "long"),),
    edge=lambda: [F.lit(1).cast("long").alias("length")],
    empty=lambda: [F.lit(0).cast("long").alias("length")],
    times=lambda: [(F.col("l_length") + F.col("r_length")).alias("length")],
    plus=lambda: [F.min("length").alias("length")],
    better=lambda new, old: new < old,
    local=True,
    uniform=True,
)


def shorter(max_len: int) -> Annotation:
    """Least number of edges of the facts that have a walk of fewer than ``max_len``; longer ones are never derived."""
    return replace(SHORTEST, most=max(max_len - 1, 0))


def _single(one: int) -> list[Column]:
    none = F.lit(None)
    return [F.lit(one).cast("long").alias("height"), F.lit(one).cast("long").alias("length"), none.alias("mid"), none.cast("int").alias("r1"), none.cast("int").alias("r2")]


#: one witness, of least derivation height; ties by length, midpoint and rule
SINGLE = Annotation(
    "single", (("height", "long"), ("length", "long"), ("mid", "vertex"), ("r1", "int"), ("r2", "int")),
    edge=lambda: _single(1),
    empty=lambda: _single(0),
    times=lambda: [(F.greatest("l_height", "r_height") + 1).alias("height"), (F.col("l_length") + F.col("r_length")).alias("length"), F.col("mid"), F.col("r1"), F.col("r2")],
    plus=lambda: [F.min(F.struct("height", "length", "mid", "r1", "r2")).alias("value")],
    local=True,
)
