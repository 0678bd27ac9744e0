"""What lies beneath facts: derivations, witnesses, walks, counts and subgraphs, all for whole tables of pairs at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.automaton import RecursiveAutomaton
from ..plans.program import Program
from .fixpoint import KEY, _measured, small_table
from .rounds import Scratch

RULES = "sym int, r1 int, r2 int"
WAY = ["sym", "src", "r1", "mid", "r2", "dst"]
#: counts grow exponentially with the length of walks; more than 38 digits fail
COUNT = "decimal(38,0)"


def _plain(df: DataFrame) -> DataFrame:
    return df


def _first(facts: DataFrame, program: Program, heads: DataFrame, hint: Callable = _plain, values: tuple = ()) -> DataFrame:
    """``heads`` (sym, src, dst and others) with each left part that a binary rule gives them: r1, mid, r2, and the part's ``values`` as l_*."""
    rules = small_table(facts.sparkSession, list(program.binary), RULES)
    l = facts.select(F.col("sym").alias("r1"), "src", F.col("dst").alias("mid"), *(F.col(v).alias(f"l_{v}") for v in values))
    return l.join(hint(heads.join(F.broadcast(rules), "sym")), ["r1", "src"])


def _second(facts: DataFrame, half: DataFrame, hint: Callable = _plain, values: tuple = ()) -> DataFrame:
    """Those of ``half`` whose right part is a fact too, with its ``values`` as r_*."""
    r = facts.select(F.col("sym").alias("r2"), F.col("src").alias("mid"), "dst", *(F.col(v).alias(f"r_{v}") for v in values))
    return r.join(hint(half), ["r2", "mid", "dst"])


def derivations(facts: DataFrame, program: Program, within: DataFrame | None = None) -> DataFrame:
    """(sym, src, r1, mid, r2, dst): every way a fact (of ``within``) splits by a binary rule into two facts."""
    heads = (facts if within is None else within).select(*KEY)
    return _second(facts, _first(facts, program, heads)).select(*WAY)


def _split(facts: DataFrame, program: Program, front: DataFrame, size: int, scratch: Scratch, name: str | None, broadcast_bytes: int, values: tuple = ()) -> DataFrame:
    """Every split of the facts of ``front``, a table of the measured size.  Its left halves are written under ``name`` and measured too: what is small is broadcast, so that the facts are scanned
    where they lie.  Without ``name`` the facts themselves are few, and halves aren't written."""
    small = lambda size: F.broadcast if size <= broadcast_bytes else _plain
    half = _first(facts, program, front, small(size * len(program.binary)), values)
    if name is None:
        return _second(facts, half, values=values)
    half = scratch.table(half, name)
    return _second(facts, half, small(_measured(half)[1]), values)


def needed(facts: DataFrame, program: Program, roots: DataFrame, scratch: Scratch, max_height: int | None = None, broadcast_bytes: int = 32 << 20, max_rounds: int = 10_000) -> DataFrame:
    """(sym, src, dst) of the facts beneath the given facts: a top-down closure.

    With ``max_height``, ``facts`` have their least heights, and only what derivations of at most that height use is kept.  A level may use one less than the level above, and a fact is first met
    where it may use most, so later needs of it add nothing.  Facts too high for a level are left out of its joins.
    """
    low = lambda h: facts if max_height is None else facts.where(F.col("height") <= h)
    front = scratch.table(low(max_height).select(*KEY).join(roots.select(*KEY).distinct(), KEY, "left_semi"), "need-0")
    paths, seen = [scratch.path("need-0")], front
    few = _measured(facts)[1] <= broadcast_bytes
    for k in range(1, max_rounds + 1):
        rows, size = _measured(front)
        if max_height is not None and k >= max_height or not rows:
            return seen
        way = _split(low((max_height or 0) - k), program, front, size, scratch, None if few else f"half-{k}", broadcast_bytes)
        ends = F.explode(F.array(F.struct(F.col("r1").alias("sym"), "src", F.col("mid").alias("dst")), F.struct(F.col("r2").alias("sym"), F.col("mid").alias("src"), "dst"))).alias("e")
        front = scratch.table(way.select(ends).select("e.*").distinct().join(seen, KEY, "left_anti"), f"need-{k}")
        if not few:
            scratch.drop(f"half-{k}")
        paths.append(scratch.path(f"need-{k}"))
        seen = facts.sparkSession.read.schema(front.schema).parquet(*paths)
    raise RuntimeError(f"no closure after {max_rounds} rounds")


def forest(facts: DataFrame, program: Program, roots: DataFrame, max_len: int, scratch: Scratch, broadcast_bytes: int = 32 << 20) -> tuple[DataFrame, DataFrame]:
    """The packed derivations of all walks of the given facts with fewer than ``max_len`` edges, as two written tables.

    Facts (sym, src, dst, most): ``most`` edges may a walk of the fact have within a walk of a root.  Derivations (sym, src, r1, mid, r2, dst, most).  ``facts`` have their least lengths: a part may be as
    long as its whole, less the least length of the part beside it.  So every level down allows less, and there are fewer than ``max_len`` levels, on cyclic graphs too.
    """
    spark = facts.sparkSession
    front = facts.where(F.col("length") < max_len).select(*KEY).join(roots.select(*KEY).distinct(), KEY, "left_semi")
    front = scratch.table(front.withColumn("most", F.lit(max_len - 1).cast("long")), "forest-0")
    few = _measured(facts)[1] <= broadcast_bytes
    tables, best = [scratch.path("forest-0")], lambda df: df.groupBy(*KEY).agg(F.max("most").alias("most"))
    for k in range(1, max(max_len, 1)):
        rows, size = _measured(front)
        if not rows:
            break
        fitting = _split(facts, program, front, size, scratch, None if few else f"half-{k}", broadcast_bytes, ("length",)).where(F.col("l_length") + F.col("r_length") <= F.col("most"))
        left = F.struct(F.col("r1").alias("sym"), "src", F.col("mid").alias("dst"), (F.col("most") - F.col("r_length")).alias("most"))
        right = F.struct(F.col("r2").alias("sym"), F.col("mid").alias("src"), "dst", (F.col("most") - F.col("l_length")).alias("most"))
        found = best(fitting.select(F.explode(F.array(left, right)).alias("e")).select("e.*"))
        old = best(spark.read.schema(front.schema).parquet(*tables)).withColumnRenamed("most", "old")
        front = scratch.table(found.join(old, KEY, "left").where(F.col("old").isNull() | (F.col("most") > F.col("old"))).drop("old"), f"forest-{k}")
        if not few:
            scratch.drop(f"half-{k}")
        tables.append(scratch.path(f"forest-{k}"))
    need = scratch.table(best(spark.read.schema(front.schema).parquet(*tables)), "forest")
    fitting = _split(facts, program, need, _measured(need)[1], scratch, None if few else "halves", broadcast_bytes, ("length",)).where(F.col("l_length") + F.col("r_length") <= F.col("most"))
    return need, scratch.table(fitting.select(*WAY, "most"), "derivations")


def _terminal(need: DataFrame, edges: DataFrame, program: Program) -> DataFrame:
    """(sym, src, label, dst): the edges that needed facts are seeded by."""
    rules = small_table(need.sparkSession, list(program.seeds), "sym int, label string")
    return need.join(F.broadcast(rules), "sym").join(edges.select("src", "label", "dst").distinct(), ["src", "label", "dst"]).select("sym", "src", "label", "dst")


def subgraph(edges: DataFrame, need: DataFrame, program: Program) -> DataFrame:
    """Distinct edges on accepted walks of the facts that ``need`` lies beneath."""
    return _terminal(need, edges, program).select("src", "label", "dst").distinct()


def walks(edges: DataFrame, need: DataFrame, ways: DataFrame, program: Program, max_len: int, scratch: Scratch) -> DataFrame:
    """(sym, src, dst, length, path): distinct walks of a forest's facts, shorter ones first; none that is too long to be part of a walk of a root."""
    step = F.array(F.struct("src", "label", "dst"))
    base = _terminal(need, edges, program).select("sym", "src", "dst", F.lit(1).cast("long").alias("length"), step.alias("path")).distinct()
    found = scratch.table(base.where(F.lit(max_len) > 1), "walks-1")
    paths = [scratch.path("walks-1")]
    for n in range(2, max_len):
        l = found.select(F.col("sym").alias("r1"), "src", F.col("dst").alias("mid"), F.col("length").alias("n1"), F.col("path").alias("p1"))
        r = found.select(F.col("sym").alias("r2"), F.col("src").alias("mid"), "dst", F.col("length").alias("n2"), F.col("path").alias("p2"))
        both = ways.where(F.col("most") >= n).join(l, ["r1", "src", "mid"]).withColumn("n2", n - F.col("n1")).join(r, ["r2", "mid", "dst", "n2"])
        both = both.select("sym", "src", "dst", F.lit(n).cast("long").alias("length"), F.concat("p1", "p2").alias("path")).distinct()
        scratch.table(both, f"walks-{n}")
        paths.append(scratch.path(f"walks-{n}"))
        found = edges.sparkSession.read.schema(base.schema).parquet(*paths)
    return found


def derivation_counts(edges: DataFrame, need: DataFrame, ways: DataFrame, program: Program, max_len: int, scratch: Scratch, sizes: DataFrame | None = None) -> DataFrame:
    """(sym, src, dst, length, n): number of derivations by length, up to the most that a forest's facts may have, as decimals; a length that no fact has ends nothing, lengths may have gaps.

    ``sizes`` (rep, n): vertices that stand for so many; a derivation counts once for each choice of those between its ends, each of which is one split's midpoint."""
    ways = ways.withColumn("times", F.lit(1)) if sizes is None else ways.join(sizes.select(F.col("rep").alias("mid"), F.col("n").alias("times")), "mid", "left").fillna(1, ["times"])
    base = _terminal(need, edges, program).groupBy("sym", "src", "dst").agg(F.lit(1).cast("long").alias("length"), F.count("*").cast(COUNT).alias("n"))
    found = scratch.table(base.where(F.lit(max_len) > 1), "counts-1")
    paths = [scratch.path("counts-1")]
    for k in range(2, max_len):
        l = found.select(F.col("sym").alias("r1"), "src", F.col("dst").alias("mid"), F.col("length").alias("n1"), F.col("n").alias("c1"))
        r = found.select(F.col("sym").alias("r2"), F.col("src").alias("mid"), "dst", F.col("length").alias("n2"), F.col("n").alias("c2"))
        both = ways.where(F.col("most") >= k).join(l, ["r1", "src", "mid"]).withColumn("n2", k - F.col("n1")).join(r, ["r2", "mid", "dst", "n2"])
        both = both.groupBy("sym", "src", "dst").agg(F.lit(k).cast("long").alias("length"), F.sum(((F.col("c1") * F.col("c2")).cast(COUNT) * F.col("times")).cast(COUNT)).cast(COUNT).alias("n"))
        scratch.table(both, f"counts-{k}")
        paths.append(scratch.path(f"counts-{k}"))
        found = edges.sparkSession.read.schema(base.schema).parquet(*paths)
    return found


def count_walks(edges: DataFrame, automaton: RecursiveAutomaton, pairs: DataFrame | None, max_len: int, scratch: Scratch, sizes: DataFrame | None = None) -> DataFrame:
    """(src, dst, n_paths) of the pairs, all if None, with an accepted walk of 1 to ``max_len`` - 1 edges, for a deterministic regular automaton.

    A word has one run there, so walks are counted without being listed: how many lead from each source to each (state, vertex), length by length.
    ``sizes`` (rep, n): vertices that stand for so many; a walk counts once for each choice of those between its ends.
    """
    spark, box = edges.sparkSession, automaton.boxes[automaton.start]
    to_go = automaton.distances(box.finals)
    wanted = (edges if pairs is None else pairs).select("src", "dst").distinct()
    step = edges.select("src", "label", "dst").distinct()
    (start,) = box.starts
    front = wanted.select("src").distinct().select("src", F.lit(start).alias("q"), F.col("src").alias("v"), F.lit(1).cast(COUNT).alias("n"))
    paths = []
    for k in range(1, max_len):
        # moves into states from which no final one can be reached within the bound are left out
        moves = [m for m in automaton.moves if to_go.get(m[2], max_len) + k < max_len]
        if not moves:
            break
        table = F.broadcast(small_table(spark, moves, "q int, label string, q2 int"))
        if sizes is not None and k > 1:
            more = front.join(sizes.select(F.col("rep").alias("v"), F.col("n").alias("times")), "v", "left")
            front = more.select("src", "q", "v", (F.col("n") * F.coalesce("times", F.lit(1))).cast(COUNT).alias("n"))
        ahead = front.join(table, "q").join(step.select(F.col("src").alias("v"), "label", "dst"), ["v", "label"])
        front = scratch.table(ahead.groupBy("src", F.col("q2").alias("q"), F.col("dst").alias("v")).agg(F.sum("n").cast(COUNT).alias("n")), f"ahead-{k}")
        paths.append(scratch.path(f"ahead-{k}"))
    if not paths:
        return wanted.where(F.lit(False)).withColumn("n_paths", F.lit(0).cast(COUNT))
    every = spark.read.schema(front.schema).parquet(*paths).where(F.col("q").isin(sorted(box.finals)))
    found = every.groupBy("src", F.col("v").alias("dst")).agg(F.sum("n").cast(COUNT).alias("n_paths"))
    return found if pairs is None else found.join(wanted, ["src", "dst"], "left_semi")


def witnesses(edges: DataFrame, facts: DataFrame, roots: DataFrame, program: Program, scratch: Scratch, max_rounds: int = 10_000, levels: int = 4) -> DataFrame:
    """(root_src, root_dst, pos, src, label, dst): the edges of the witness kept for each root pair, unfolded by ``levels`` levels a round.

    ``facts`` carry (mid, r1, r2); a fact without midpoint is an edge.  Positions come from the lengths of left parts.
    """
    key = ["sym", "src", "dst"]
    left = facts.select(F.col("sym").alias("r1"), "src", F.col("dst").alias("mid"), F.col("length").alias("left"))
    split = scratch.table(facts.select(*key, "mid", "r1", "r2").join(left, ["r1", "src", "mid"], "left"), "splits")
    front = roots.select(*key, F.col("src").alias("root_src"), F.col("dst").alias("root_dst"), F.lit(0).cast("long").alias("pos"))
    piece = lambda sym, src, dst, pos, leaf: F.struct(F.col(sym).alias("sym"), F.col(src).alias("src"), F.col(dst).alias("dst"), pos.alias("pos"), F.lit(leaf).alias("leaf"))
    whole = F.array(piece("sym", "src", "dst", F.col("pos"), True))
    halves = F.array(piece("r1", "src", "mid", F.col("pos"), False), piece("r2", "mid", "dst", F.col("pos") + F.col("left"), False))
    done = []
    for k in range(1, max_rounds + 1):
        for _ in range(levels):
            front = front.join(split, key).select("root_src", "root_dst", F.explode(F.when(F.col("mid").isNull(), whole).otherwise(halves)).alias("e")).select("root_src", "root_dst", "e.*")
        own = scratch.table(front, f"unfold-{k}")
        done.append(scratch.path(f"unfold-{k}"))
        front = own.where(~F.col("leaf")).drop("leaf")
        if front.isEmpty():
            leaves = edges.sparkSession.read.schema(own.schema).parquet(*done).where("leaf")
            rules = small_table(edges.sparkSession, list(program.seeds), "sym int, label string")
            labelled = leaves.join(F.broadcast(rules), "sym").join(edges.select("src", "label", "dst").distinct(), ["src", "label", "dst"])
            return labelled.groupBy("root_src", "root_dst", "pos", "src", "dst").agg(F.min("label").alias("label"))
    raise RuntimeError(f"witnesses are deeper than {levels * max_rounds} levels")
