"""Semi-naive evaluation of rule programs over an edge table.

Distributed: a round joins the last round's new facts with what they can follow or precede, on the vertex between them, through broadcast rule tables (their
size is that of the query).  Where the other side of a rule is an edge, that is the table of edges alone, so a regular language never joins its growing facts.
New facts are measured: up to ``broadcast_bytes`` they are broadcast, and the known facts are scanned where they lie.  Beyond, they are shuffled, and
known tables of ``bucket_rows`` and more are kept bucketed by what rounds join on, so they are not; smaller ones are shuffled too.  In such rounds, vertices with more than ``heavy_rows`` facts on either side
are joined apart, in a grid of cells.  What is new is written as Parquet to the shared folder, which cuts lineage and survives lost executors.
Known facts are a few tables of geometrically growing size, merged as rounds go on, so neither files nor rewriting grow with the number of rounds.

A program without recursion is one plan of joins, without rounds.

Local: a graph, or the part of a graph under one key, whose edges are counted and found few is solved by the same rounds
within one task; a part whose facts outgrow the task is handed back and solved by the distributed rounds.  No way drops anything.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.annotations import REACH, SINGLE, Annotation
from ..plans.program import Program
from .layout import Layouts, heavy, salted
from .rounds import Scratch

KEY = ["sym", "src", "dst"]


@dataclass(frozen=True)
class Strategy:
    """``local_edges``: edges of a part that one task may solve; ``local_facts``: facts at which it gives up.  ``broadcast_bytes``: measured size up to which a round's
    facts are broadcast.  ``direct_facts``: known facts up to which a round's finds are compared with all of them at once, without being written and measured first.
    ``bucket_rows``: rows from which a known table is bucketed for larger rounds; ``heavy_rows``: facts of a vertex that meet in one task in them.
    ``twin_edges``: edges from which a graph is looked through for vertices with the same edges, before a task may solve it.
    ``square_after``: rounds by steps of a regular language before powers may take over; ``power_factor``: pairs of a power, against facts and edges, up to which they do."""

    local_edges: int = 100_000
    local_facts: int = 3_000_000
    broadcast_bytes: int = 32 << 20
    direct_facts: int = 2_000_000
    bucket_rows: int = 10_000_000
    heavy_rows: int = 65_536
    max_rounds: int = 100_000
    square_after: int = 8
    power_factor: int = 4
    twin_edges: int = 4096


@dataclass
class Trace:
    """How a query was evaluated."""

    counts: list[Callable[[], int]] = field(default_factory=list)

    @property
    def rounds(self) -> int:
        """Rounds of the longest part, the last one, which found nothing, included."""
        return max((c() for c in self.counts), default=0)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the query's own size (rules, states); broadcast by its users."""
    return spark.createDataFrame(rows, schema)


def _kinds(a: Annotation, vertex: T.DataType) -> dict[str, str]:
    return {n: vertex.simpleString() if k == "vertex" else k for n, k in a.columns}


def _values(columns, a: Annotation, vertex: T.DataType) -> list:
    kinds = _kinds(a, vertex)
    return [c.cast(kinds[n]).alias(n) for c, (n, _) in zip(columns, a.columns)]


def kept(facts: DataFrame, a: Annotation) -> DataFrame:
    """One row for each fact, with its best value."""
    if not a.columns:
        return facts.distinct()
    if a.gather:
        return a.gather(facts, KEY)
    out = facts.groupBy(*KEY).agg(*a.plus())
    return out.select(*KEY, "value.*") if "value" in out.columns and a == SINGLE else out


def seeds(edges: DataFrame, program: Program, a: Annotation) -> DataFrame:
    """Facts of edges: each edge under every symbol that is seeded by its label."""
    rules = small_table(edges.sparkSession, list(program.seeds), "sym int, label string")
    values = _values(a.edge(), a, edges.schema["src"].dataType)
    return kept(_within(edges.where(F.col("label").isin(program.labels)).join(F.broadcast(rules), "label").select("sym", "src", "dst", *values), a), a)


def _within(facts: DataFrame, a: Annotation) -> DataFrame:
    return facts if a.most is None else facts.where(F.col(a.values[0]) <= a.most)


def source_facts(sources: DataFrame, program: Program, a: Annotation) -> DataFrame:
    v = sources.columns[0]
    own = sources.select(F.col(v).alias("src")).where(F.col("src").isNotNull()).distinct()
    symbols = F.explode(F.array(*(F.lit(s).cast("int") for s in program.sources))).alias("sym")
    return own.select(symbols, "src", F.col("src").alias("dst"), *_values(a.empty(), a, sources.schema[v].dataType))


def _join(left: DataFrame, right: DataFrame, rules: list[tuple], a: Annotation, new_is_left: bool, hint: Callable[[DataFrame], DataFrame], cells: tuple = ()) -> DataFrame:
    """What facts of ``left`` followed by facts of ``right`` derive; the new ones are small if ``hint`` broadcasts.  ``cells``: columns that both sides have and that must be equal."""
    table = F.broadcast(small_table(left.sparkSession, rules, "head int, r1 int, r2 int"))
    firsts, seconds = sorted({r[1] for r in rules}), sorted({r[2] for r in rules})
    l = left.where(F.col("sym").isin(firsts)).select(F.col("sym").alias("r1"), F.col("src").alias("src"), F.col("dst").alias("mid"), *(F.col(n).alias(f"l_{n}") for n in a.values), *cells)
    r = right.where(F.col("sym").isin(seconds)).select(F.col("sym").alias("r2"), F.col("src").alias("mid"), F.col("dst").alias("dst"), *(F.col(n).alias(f"r_{n}") for n in a.values), *cells)
    both = r.join(hint(l.join(table, "r1")), ["r2", "mid", *cells]) if new_is_left else l.join(hint(r.join(table, "r2")), ["r1", "mid", *cells])
    return _within(both.select(F.col("head").alias("sym"), "src", "dst", *a.times()), a)


def _whole(df: DataFrame) -> DataFrame:
    return df


def _large_join(
    new: tuple[DataFrame, DataFrame | None], known: tuple[DataFrame, DataFrame | None], rules: list[tuple], a: Annotation, new_is_left: bool, strategy: Strategy, scratch: Scratch, name: str
) -> list[DataFrame]:
    """``_join`` of new facts that are too many to be broadcast with a table of known ones, both with their heavy vertices, None for none.

    Facts of vertices that are heavy on either side meet in a grid of cells, of about ``heavy_rows`` facts of each side; all others meet by vertex."""
    one, two = ("dst", "src") if new_is_left else ("src", "dst")
    (own, own_many), (other, other_many) = new, known
    follow = lambda x, y, *rest: _join(x, y, rules, a, True, _whole, *rest) if new_is_left else _join(y, x, rules, a, False, _whole, *rest)
    if own_many is None and other_many is None:
        return [follow(own, other)]
    # one copy of the rows that are joined by vertex and one of those that are dealt
    own = own.where(F.col("sym").isin(sorted({r[1 if new_is_left else 2] for r in rules})))
    other = other.where(F.col("sym").isin(sorted({r[2 if new_is_left else 1] for r in rules})))
    cells = lambda c: F.ceil(F.coalesce(F.col(c), F.lit(1)) / strategy.heavy_rows).cast("int")
    none = (own_many if own_many is not None else other_many).where(F.lit(False))
    both = [(none if m is None else m).withColumnRenamed("n", n) for m, n in ((own_many, "n1"), (other_many, "n2"))]
    split = scratch.table(both[0].join(both[1], "v", "full").select("v", cells("n1").alias("__i"), cells("n2").alias("__j")), name)
    _, size = _measured(split)
    split = F.broadcast(split) if size <= max(strategy.broadcast_bytes, 1 << 20) else split
    light = follow(own.join(split.select(F.col("v").alias(one)), one, "left_anti"), other.join(split.select(F.col("v").alias(two)), two, "left_anti"))
    return [light, follow(salted(own, one, split, "__i", "__j", two), salted(other, two, split, "__j", "__i", one), ("__i", "__j"))]


def _unary(facts: DataFrame, program: Program, a: Annotation, vertex: T.DataType) -> list[DataFrame]:
    """What unary rules derive from ``facts``."""
    out = []
    for want in (False, True):
        if rules := [(h, b) for h, b, loop in program.unary if loop == want]:
            own = facts.join(F.broadcast(small_table(facts.sparkSession, rules, "head int, sym int")), "sym")
            out.append(own.select(F.col("head").alias("sym"), F.col("dst" if want else "src").alias("src"), "dst", *(_values(a.empty(), a, vertex) if want else a.values)))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out


def _measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes in memory at most about) of a written table of facts."""
    text = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    lists = [f.name for f in df.schema if isinstance(f.dataType, T.ArrayType)]
    row = df.agg(F.count("*").alias("n"), *(F.sum(F.octet_length(c)).alias(c) for c in text), *(F.sum(8 * F.size(c)).alias(c) for c in lists)).first()
    return row["n"], row["n"] * 16 * len(df.columns) + 2 * sum(row[c] or 0 for c in [*text, *lists])


class Known:
    """All facts so far, as tables of the shared folder of which each is larger than all that came after it together."""

    MOST = 8

    def __init__(self, scratch: Scratch, a: Annotation):
        self.scratch, self.a, self.tables, self.rows, self.merges, self.old = scratch, a, [], 0, 0, []

    def add(self, name: str, table: DataFrame, rows: int) -> None:
        """A table that was just written; it is not dropped before the next one is added."""
        self.scratch.drop(*self.old)
        self.schema, self.old = table.schema, []
        self.tables.append((name, rows))
        self.rows += rows
        if len(self.tables) > self.MOST:
            own = [self.tables.pop()]
            while self.tables and self.tables[-1][1] <= 2 * sum(n for _, n in own):
                own.append(self.tables.pop())
            if len(own) > 1:
                self.merges += 1
                merged = self._read([n for n, _ in own])
                self.scratch.table(kept(merged, self.a) if self.a.improves else merged.coalesce(max(1, sum(n for _, n in own) // 1_000_000)), f"merged-{self.merges}")
                self.tables.append((f"merged-{self.merges}", sum(n for _, n in own)))
                self.old = [n for n, _ in own]
            else:
                self.tables.extend(own)

    def parts(self, least: int) -> tuple[list[tuple[str, DataFrame]], DataFrame | None]:
        """The tables of at least so many rows, by name, and all others as one."""
        rest = [n for n, rows in self.tables if rows < least]
        return [(n, self._read([n])) for n, rows in self.tables if rows >= least], self._read(rest) if rest else None

    def _read(self, names: list[str]) -> DataFrame:
        return self.scratch.spark.read.schema(self.schema).parquet(*(self.scratch.path(n) for n in names))

    def frame(self) -> DataFrame:
        """The facts; those whose value was improved are there with older ones too."""
        return self._read([n for n, _ in self.tables])


def _new(found: DataFrame, facts: DataFrame, a: Annotation) -> DataFrame:
    """What of ``found`` isn't among the facts, or is better than there."""
    if not a.improves:
        return found.join(facts, KEY, "left_anti")
    (value,) = a.values
    old = kept(facts, a).select(*KEY, F.col(value).alias("old"))
    if a.merge:
        both = found.join(old, KEY, "left").withColumn(value, F.when(F.col("old").isNull(), F.col(value)).otherwise(a.merge(F.col(value), F.col("old"))))
        return both.where(F.col("old").isNull() | (F.col(value) != F.col("old"))).drop("old")
    return found.join(old, KEY, "left").where(F.col("old").isNull() | a.better(F.col(value), F.col("old"))).drop("old")


def solve(
    edges: DataFrame, program: Program, a: Annotation = REACH, sources: DataFrame | None = None, strategy: Strategy = Strategy(), scratch: Scratch | None = None,
    trace: Trace | None = None, known: DataFrame | None = None,
) -> DataFrame:
    """(sym, src, dst and the annotation's columns): all facts of the program, by distributed rounds.

    With ``known``, facts of earlier edges under the same program, ``edges`` are new ones and only the facts that they add come back.
    """
    spark, vertex = edges.sparkSession, edges.schema["src"].dataType
    scratch = scratch or Scratch(spark, "facts")
    if a == SINGLE and program.unary:
        raise ValueError("heights are defined for grammars only")
    derived = {r[0] for r in program.binary} | {r[0] for r in program.unary}
    columns = [*KEY, *(n for n, _ in a.columns)]
    small = lambda size: F.broadcast if size <= strategy.broadcast_bytes else lambda df: df
    start = seeds(edges, program, a)
    if sources is not None and program.sources:
        start = start.unionByName(source_facts(sources, program, a))
    if known is not None:
        start = _new(start, known.select(*columns), a)
    facts, delta = Known(scratch, a), scratch.table(start.select(*columns), "round-0")
    rows, size = _measured(delta)
    facts.add("round-0", delta, rows)
    every = lambda: facts.frame() if known is None else facts.frame().unionByName(known.select(*columns))
    # what is no rule's head has only the facts of edges
    base = scratch.table(delta.where(~F.col("sym").isin(sorted(derived))), "base") if derived else delta
    if known is not None:
        base = base.unionByName(known.select(*columns).where(~F.col("sym").isin(sorted(derived))))
    base_rows = None
    with Layouts(scratch, strategy.heavy_rows) as layouts:
        for k in range(1, strategy.max_rounds + 1):
            if trace is not None and k == 1:
                trace.counts.append(lambda: rounds)
            rounds, found = k, _unary(delta, program, a, vertex) if rows else []
            large, news = size > strategy.broadcast_bytes and known is None, {}
            if large:
                layouts.keep([*(n for n, _ in facts.tables), "base"])
                parts, rest = facts.parts(strategy.bucket_rows)
                base_rows = base.count() if base_rows is None else base_rows
                # a table of no more rows has no heavy vertex
                whole = lambda t, n, v, name: (t, layouts.heavy(t, v, name) if n > strategy.heavy_rows else None)
                rest_rows = sum(n for _, n in facts.tables if n < strategy.bucket_rows)
            for one, new_is_left in ((1, True), (2, False)):
                if known is None and k == 1 and not new_is_left:
                    continue  # in the first round everything is new, so one side of the join sees all pairs
                own = [r for r in program.binary if k == 1 or r[one] in derived]
                for growing in (True, False):
                    rules = [r for r in own if (r[3 - one] in derived) == growing]
                    if not rules or not rows:
                        continue
                    if not large:
                        other = every() if growing else base
                        found.append(_join(delta, other, rules, a, True, small(size)) if new_is_left else _join(other, delta, rules, a, False, small(size)))
                        continue
                    layout, symbols = "right" if new_is_left else "left", sorted({r[3 - one] for r in program.binary})
                    vertex_of = ("dst", "src") if new_is_left else ("src", "dst")
                    if layout not in news:
                        news[layout] = whole(delta, rows, vertex_of[0], f"heavy-new-{layout}")
                    if growing:
                        others = [layouts.of(n, t, layout, symbols) for n, t in parts] + ([whole(rest, rest_rows, vertex_of[1], f"heavy-rest-{layout}")] if rest is not None else [])
                    elif base_rows >= strategy.bucket_rows:
                        others = [layouts.of("base", base, layout, symbols)]
                    else:
                        others = [whole(base, base_rows, vertex_of[1], f"heavy-base-{layout}")]
                    for i, other in enumerate(others):
                        found += _large_join(news[layout], other, rules, a, new_is_left, strategy, scratch, f"heavy-{layout}-{growing}-{i}")
            if not found:
                return facts.frame()
            new = kept(_union(found), a)
            if facts.rows > strategy.direct_facts or known is not None:
                # what was found is measured; if it is small the facts are scanned for it where they lie
                new = scratch.table(new, f"found-{k}")
                count, found_size = _measured(new)
                if not count:
                    return kept(facts.frame(), a) if a.improves else facts.frame()
                if found_size > strategy.broadcast_bytes and known is None and not a.improves:
                    parts, rest = facts.parts(strategy.bucket_rows)
                    for seen in [layouts.of(n, t, "fact", sorted(derived))[0] for n, t in parts] + ([rest] if rest is not None else []):
                        new = new.join(seen, KEY, "left_anti")
                else:
                    new = _new(new, every().join(small(found_size)(new.select(*KEY)), KEY, "left_semi"), a)
            else:
                new = _new(new, every(), a)
            delta = scratch.table(new.select(*columns), f"round-{k}")
            scratch.drop(f"found-{k}")
            rows, size = _measured(delta)
            if not rows:
                return kept(facts.frame(), a) if a.improves else facts.frame()
            facts.add(f"round-{k}", delta, rows)
    raise RuntimeError(f"no fixpoint after {strategy.max_rounds} rounds")


def solve_straight(edges: DataFrame, program: Program, a: Annotation, scratch: Scratch) -> DataFrame:
    """All facts of a program without recursion: every symbol once, after those it is made of.  Symbols that several rules use are written."""
    order, vertex = program.order(), edges.schema["src"].dataType
    columns = [*KEY, *(n for n, _ in a.columns)]
    uses: dict[int, int] = {}
    for r in program.binary:
        for s in r[1:]:
            uses[s] = uses.get(s, 0) + 1
    start, facts = seeds(edges, program, a), {}
    seeded = {s for s, _ in program.seeds}
    for s in order:
        own = [start.where(F.col("sym") == s).select(*columns)] if s in seeded else []
        for r in program.binary:
            if r[0] == s and r[1] in facts and r[2] in facts:
                own.append(_join(facts[r[1]], facts[r[2]], [r], a, True, lambda df: df).select(*columns))
        for h, b, loop in program.unary:
            if h == s and b in facts:
                own += [x.select(*columns) for x in _unary(facts[b], program.only_unary((h, b, loop)), a, vertex)]
        if own:
            made = kept(_union(own), a).select(*columns) if len(own) > 1 or s not in seeded else own[0]
            facts[s] = scratch.table(made, f"symbol-{s}") if uses.get(s, 0) > 1 and s not in seeded else made
    return scratch.table(_union(list(facts.values())), "facts") if facts else start.where(F.lit(False))


# ---- one task ------------------------------------------------------------------------------------------------------------


class TooLarge(Exception):
    """The facts of a part outgrow one task."""


def solve_local(edges: list[tuple], program: Program, a: Annotation, sources: list | None, most: int, rounds: list[int] | None = None) -> dict[tuple, tuple]:
    """The same rounds over (src, label, dst) tuples: facts (sym, src, dst) with their values; ``rounds`` gets their number.  ``most``: facts, and merges of several sums, at which it gives up."""
    by_label: dict[str, list[int]] = {}
    for s, t in program.seeds:
        by_label.setdefault(t, []).append(s)
    first: dict[int, list] = {}
    second: dict[int, list] = {}
    unary: dict[int, list] = {}
    for h, x, y in program.binary:
        first.setdefault(x, []).append((h, y))
        second.setdefault(y, []).append((h, x))
    for h, b, loop in program.unary:
        unary.setdefault(b, []).append((h, loop))
    single, shortest, least = a.name == "single", a.name == "shortest", a.least
    edge_value = (1, 1, None, None, None) if single else (1,) if shortest else ((1,),) if least else ()
    zero = (0, 0, None, None, None) if single else (0,) if shortest else ((0,),) if least else ()
    longest = float("inf") if a.most is None else a.most
    delta = {(s, u, v): edge_value for u, t, v in edges for s in by_label.get(t, ()) if longest >= 1}
    if sources is not None:
        delta |= {(s, v, v): zero for s in program.sources for v in sources}
    facts: dict[tuple, tuple] = {}
    out: dict[tuple, set] = {}
    into: dict[tuple, set] = {}
    empty: set = set()
    count, merges = 0, 0
    while delta:
        count += 1
        for (s, u, v), value in delta.items():
            facts[s, u, v] = value
            out.setdefault((s, u), set()).add(v)
            into.setdefault((s, v), set()).add(u)
        if len(facts) > most:
            raise TooLarge
        new: dict[tuple, tuple] = {}

        def offer(key: tuple, value: tuple) -> None:
            old = facts.get(key)
            if least:
                # several sums for each pair of facts: what is compared outgrows the task before the facts do
                nonlocal merges
                merges += 1
                if merges > most:
                    raise TooLarge
                value = (tuple(sorted({*value[0], *(new.get(key) or old or ((),))[0]})[:least]),)
                if value != old:
                    new[key] = value
                return
            if old is not None and (not shortest or old <= value) or shortest and value[0] > longest:
                return
            if (now := new.get(key)) is None or value < now:
                new[key] = value

        for (s, u, v), value in delta.items():
            for h, y in first.get(s, ()):
                for w in out.get((y, v), empty):
                    if single:
                        r = facts[y, v, w]
                        offer((h, u, w), (max(value[0], r[0]) + 1, value[1] + r[1], v, s, y))
                    elif least:
                        offer((h, u, w), ([x + z for x in value[0] for z in facts[y, v, w][0]],))
                    else:
                        offer((h, u, w), (value[0] + facts[y, v, w][0],) if shortest else ())
            for h, x in second.get(s, ()):
                for w in into.get((x, u), empty):
                    if single:
                        l = facts[x, w, u]
                        offer((h, w, v), (max(value[0], l[0]) + 1, value[1] + l[1], u, x, s))
                    elif least:
                        offer((h, w, v), ([z + t for z in facts[x, w, u][0] for t in value[0]],))
                    else:
                        offer((h, w, v), (value[0] + facts[x, w, u][0],) if shortest else ())
            for h, loop in unary.get(s, ()):
                offer((h, v if loop else u, v), zero if loop and (shortest or least) else value)
        delta = new
        if len(facts) + len(new) > most:
            raise TooLarge
    if rounds is not None:
        rounds.append(max(count, 1))
    return facts


def fact_schema(vertex: T.DataType, a: Annotation) -> T.StructType:
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "vertex": vertex, "array<bigint>": T.ArrayType(T.LongType())}
    return T.StructType([T.StructField("sym", T.IntegerType()), T.StructField("src", vertex), T.StructField("dst", vertex), *(T.StructField(n, kinds[k]) for n, k in a.columns)])


#: rows of a task's output that are no facts: a part that outgrew the task, and, that much lower, the number of rounds
OUTGROWN, ROUNDS = -1, -2


def solve_parts(edges: DataFrame, program: Program, a: Annotation, sources: DataFrame | None, part: str | None, strategy: Strategy, scratch: Scratch, trace: Trace | None = None) -> DataFrame:
    """All facts: parts that are small are solved in one task each, the others by distributed rounds.  Edges of a null part are a part.  Sources belong to every part that has them."""
    used = edges.where(F.col("label").isin(program.labels))
    vertex = edges.schema["src"].dataType
    keyed = used.withColumn("__part", F.col(part) if part else F.lit(0))
    columns = ["__part", "src", "label", "dst"]
    rows = keyed.select(*columns)
    if sources is not None:
        v = sources.columns[0]
        ends = keyed.select("__part", F.explode(F.array("src", "dst")).alias("src")).distinct() if part else None
        own = sources.select(F.col(v).cast(vertex).alias("src")).where(F.col("src").isNotNull()).distinct()
        own = ends.join(own, "src", "left_semi") if part else own.withColumn("__part", F.lit(0))
        rows = rows.unionByName(own.select("__part", "src", F.lit(None).cast("string").alias("label"), F.col("src").alias("dst")))
    if part or sources is not None:
        rows = scratch.table(rows, "parts")
        # parts are counted without being gathered
        large = scratch.table(rows.groupBy("__part").count().where(F.col("count") > strategy.local_edges).select(F.col("__part").alias("large")), "large")
        small = rows.join(large, rows["__part"].eqNullSafe(large["large"]), "left_anti")
    else:
        # the caller has counted the edges; the task reads them where they are
        large, small = rows.select(F.col("__part").alias("large")).where(F.lit(False)), rows
    schema = T.StructType([*fact_schema(vertex, a).fields, T.StructField("__part", rows.schema["__part"].dataType)])
    kinds = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema])
    most, with_sources, width = strategy.local_facts, sources is not None, len(schema) - 1
    # expressions stay here
    bare = Annotation(a.name, a.columns, most=a.most, least=a.least)

    def own_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[int] = []

        def remark(sym: int, key: object = None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([sym], pa.int32()), *(pa.nulls(1, f.type) for f in list(kinds)[1:width]), pa.array([key], kinds.field(width).type)], schema=kinds)

        def finish(key: object, own: list[tuple]) -> Iterator[pa.RecordBatch]:
            origin = [u for u, t, _ in own if t is None] if with_sources else None
            try:
                facts = solve_local([x for x in own if x[1] is not None], program, bare, origin, most, counts)
            except TooLarge:
                yield remark(OUTGROWN, key)
                return
            found = list(facts.items())
            for k in range(0, len(found), 100_000):
                step = found[k : k + 100_000]
                columns = [*zip(*(key for key, _ in step)), *zip(*(value for _, value in step)), [None] * len(step)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

        now, own = None, []
        for batch in batches:
            for key, u, t, v in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now and own:
                    yield from finish(now, own)
                    own = []
                now = key
                own.append((u, t, v))
        if own:
            yield from finish(now, own)
        if counts:
            yield remark(ROUNDS - max(counts))

    dealt = small.select(*columns).repartition("__part").sortWithinPartitions("__part") if part else small.select(*columns).repartition(1)
    made = scratch.table(dealt.mapInArrow(own_part, schema), "local")
    facts = made.where(F.col("sym") >= 0).drop("__part")
    if trace is not None:
        trace.counts.append(lambda: ROUNDS - (made.where(F.col("sym") < ROUNDS).agg(F.min("sym")).first()[0] or ROUNDS))
    over = large.select("large").unionByName(made.where(F.col("sym") == OUTGROWN).select(F.col("__part").alias("large")))
    if over.isEmpty():
        return facts
    rest = rows.join(over, rows["__part"].eqNullSafe(over["large"]), "left_semi")
    again = solve(rest.where(F.col("label").isNotNull()).select("src", "label", "dst"), program, a, rest.where(F.col("label").isNull()).select("src") if with_sources else None, strategy, scratch, trace)
    return facts.unionByName(again)
