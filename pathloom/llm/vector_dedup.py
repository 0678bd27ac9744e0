"""Embedding near-dedup: NN-descent over a neighbour graph, recall audit, threshold links, connected components.

1. Equal vectors of one label collapse to one weighted class before anything is compared.
2. The graph starts from random-hyperplane orders: in each of ``tables`` tables the classes of a label lie in order of their sign codes, and blocks of at
   most ``block`` neighbours in that order give each class its ``k`` best.
3. NN-descent rounds: a class meets, at every class that lists it or that it lists, the other neighbours there (neighbours of neighbours), and keeps
   the ``k`` best.  The join moves 2 k vectors a class and round; a hub's neighbours meet in blocks.  Rounds end when the lists hardly change.
4. Listed pairs of cosine >= ``threshold`` are links, and these give components.  A saturated list (every entry a link) has no room for more, so classes
   with one look in new tables for links to saturated classes of other components (a list that isn't saturated holds its links to both), until a round finds none.
5. What saturated lists leave out within a component: its lists are enlarged to the whole component, all its pairs are compared, in blocks of ``block``,
   and counted without being listed.  A component of several tiles is compared by tiles first: the angle between two tiles' means and the tiles' radii tell of most that all
   of their pairs are links, or none, and only the other tiles' vectors meet.
6. Audit: for a bounded set of queries, all links by brute force over the whole table; if under ``target`` of them are within components,
   the graph is seeded with twice the tables and refined again; if they still are after ``max_seedings``, the run fails.

Cosines are in double precision, so no pair below the threshold is linked.  Rows: null labels, null or zero vectors, and vectors with null, NaN or
infinite components link with nothing; vectors of different length never link; repeated rows count as further vectors; null ids are never the least id of a component; an empty table gives
no rows; extra columns aren't read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch, release


@dataclass(frozen=True)
class VectorParams:
    threshold: float = 0.93
    tables: int = 6
    k: int = 8
    leaf: int = 128
    block: int = 512
    #: rows of a component that travel together when its pairs are compared: each row is sent to the tiles that the bounds leave open
    tile: int = 2048
    #: classes of one bucket beyond which it is split by hash, so that a group of any size is spread over tasks
    bucket_rows: int = 32_768
    rounds: int = 3
    #: share of list entries that changes in the last round
    settled: float = 0.002
    audit_queries: int = 512
    target: float = 0.97
    max_seedings: int = 4
    seed: int = 11


def unit(values: np.ndarray, rows: int) -> np.ndarray:
    x = values.reshape(rows, -1).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str], cap: int) -> Iterator[tuple[pa.RecordBatch, int, int]]:
    """(batch, first, end) of runs of equal keys (long columns) in sorted input, in parts of at most ``cap`` rows."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for k in keys:
            v = batch.column(k).to_numpy()
            new[1:] |= v[1:] != v[:-1]
        edge = np.concatenate([[0], np.flatnonzero(new)])
        for a, b in zip(edge[:-1], edge[1:]):
            for x in range(a, b, cap):
                yield batch, x, min(x + cap, b)
        a = int(edge[-1])
        while n - a > cap:
            yield batch, a, a + cap
            a += cap
        held = batch.slice(a)
    if held is not None and held.num_rows:
        yield held, 0, held.num_rows


def matrix(batch: pa.RecordBatch, a: int, b: int) -> np.ndarray:
    column = batch.column("vec").slice(a, b - a)
    return unit(column.flatten().to_numpy(), b - a)


_LIST = "c long, near array<struct<s: double, u: long>>"
_LIST_TYPE = pa.list_(pa.struct([("s", pa.float64()), ("u", pa.int64())]))


def _best(ids: np.ndarray, x: np.ndarray, k: int, floor: np.ndarray | None = None, root: np.ndarray | None = None) -> pa.RecordBatch | None:
    """The k nearest of each row of a block among the others (those of another ``root``), those above the row's ``floor``."""
    n = len(ids)
    if n < 2:
        return None
    s = x @ x.T
    same = ids if root is None else root
    s[same[:, None] == same[None, :]] = -2
    k = min(k, n - 1)
    near = np.argpartition(-s, k - 1, axis=1)[:, :k]
    value = np.round(np.take_along_axis(s, near, 1), 7)
    keep = value > (floor[:, None] if floor is not None else -2)
    count = keep.sum(1)
    some = np.flatnonzero(count)
    if not len(some):
        return None
    flat = pa.StructArray.from_arrays([pa.array(value[keep]), pa.array(ids[near[keep]])], names=["s", "u"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count[some])]).astype(np.int32)), flat)
    return pa.RecordBatch.from_arrays([pa.array(ids[some]), lists], names=["c", "near"])


def _merge(lists: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct entries of each class over all its lists."""
    both = F.array_distinct(F.flatten(F.collect_list("near")))
    return lists.groupBy("c").agg(F.slice(F.sort_array(both, asc=False), 1, k).alias("near"))


def _sizes(v: DataFrame, p: VectorParams) -> DataFrame:
    """Bits of the buckets of each group."""
    return v.groupBy("grp").agg(F.greatest(F.lit(0), F.least(F.lit(24), F.ceil(F.log2(F.count("*") / p.leaf)))).cast("long").alias("bits"))


def _seeded(v: DataFrame, sizes: DataFrame, tables: range, p: VectorParams, across: bool = False) -> DataFrame:
    """Neighbour lists from blocks along random-hyperplane orders; with ``across``, of links to classes of another ``root`` only."""
    extra = ["root"] if across else []

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch, a, b in grouped(batches, ["dim"], 8192):
            x, dim = matrix(batch, a, b), batch.column("dim")[a].as_py()
            rows = batch.slice(a, b - a)
            bits = rows.column("bits").to_numpy()
            for t in tables:
                if (t, dim) not in planes:
                    planes[t, dim] = np.random.default_rng([p.seed, t, dim]).standard_normal((dim, 32))
                code = ((x @ planes[t, dim] > 0) @ (1 << np.arange(31, -1, -1, dtype=np.int64))).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(b - a, t, np.int64)), rows.column("grp"), pa.array(code >> (32 - bits)), pa.array(code), rows.column("c"), rows.column("vec"), *(rows.column(x) for x in extra)],
                    names=["t", "grp", "bucket", "code", "c", "vec", *extra],
                )

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b in grouped(batches, ["t", "grp", "bucket", "salt"], p.block):
            ids, root = batch.column("c").slice(a, b - a).to_numpy(), batch.column("root").slice(a, b - a).to_numpy() if across else None
            if (out := _best(ids, matrix(batch, a, b), p.k, np.full(b - a, p.threshold - 1e-6) if across else None, root)) is not None:
                yield out

    coded = v.join(sizes, "grp").select("grp", "dim", "bits", "c", "vec", *extra).mapInArrow(codes, "t long, grp long, bucket long, code long, c long, vec array<float>" + (", root long" if across else ""))
    # a bucket of very many classes (near copies have one code) is split; each part is a random subset in the same order
    own = coded.groupBy("t", "grp", "bucket").count().where(F.col("count") > p.bucket_rows)
    salted = coded.join(own, ["t", "grp", "bucket"], "left").withColumn("salt", F.pmod(F.xxhash64("c", "t"), F.coalesce(F.ceil(F.col("count") / p.bucket_rows), F.lit(1)).cast("long")))
    dealt = salted.repartition("t", "grp", "bucket", "salt").sortWithinPartitions("t", "grp", "bucket", "salt", "code", "c")
    return dealt.select("t", "grp", "bucket", "salt", "c", "vec", *extra).mapInArrow(lists, _LIST)


def _descend(graph: DataFrame, v: DataFrame, p: VectorParams) -> DataFrame:
    """Lists of what each class meets at its neighbours: pairs of the neighbours, and reverse neighbours, of one class."""

    def local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b in grouped(batches, ["at"], p.block):
            ids, floor = batch.column("c").slice(a, b - a).to_numpy(), batch.column("floor").slice(a, b - a).to_numpy()
            if (out := _best(ids, matrix(batch, a, b), p.k, floor)) is not None:
                yield out

    forward = graph.select(F.col("c").alias("at"), F.explode("near.u").alias("c"))
    edges = forward.unionByName(forward.select(F.col("c").alias("at"), F.col("at").alias("c"))).distinct()
    floor = graph.select("c", F.when(F.size("near") < p.k, F.lit(-2.0)).otherwise(F.element_at("near", -1)["s"]).alias("floor"))
    members = edges.join(v.join(floor, "c").select("c", "floor", "vec"), "c")
    return members.repartition("at").sortWithinPartitions("at", "c").select("at", "c", "floor", "vec").mapInArrow(local_join, _LIST)


def _bridged(graph: DataFrame, v: DataFrame, links: DataFrame, roots: DataFrame, first: int, scratch: Scratch, name: int, p: VectorParams) -> DataFrame:
    """``roots`` after links between saturated classes of different components are added, in rounds of new tables until one finds none."""
    full = scratch.table(graph.where((F.size("near") >= p.k) & (F.element_at("near", -1)["s"] >= p.threshold - 1e-6)).select("c").join(v.select("c", "grp"), "c"), f"full-{name}")
    for k in itertools.count():
        rooted = full.join(roots, F.col("c") == F.col("node"), "left").select("c", "grp", F.coalesce("root", "c").alias("root"))
        mixed = rooted.groupBy("grp").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("grp")
        open_ = scratch.table(rooted.join(mixed, "grp", "left_semi").select("c", "root"), f"open-{name}-{k}")
        if open_.isEmpty():
            return roots
        own = v.join(open_, "c")
        found = _seeded(own, _sizes(own, p), range(first + k * p.tables, first + (k + 1) * p.tables), p, across=True)
        fresh = scratch.table(_exact(found.select(F.col("c").alias("a"), F.explode("near.u").alias("b")), v, p), f"bridges-{name}-{k}")
        release(v.sparkSession)
        if fresh.isEmpty():
            return roots
        links = links.unionByName(fresh)
        roots = scratch.table(components(links, scratch), f"roots-{name}-{k}")


def _complete(v: DataFrame, roots: DataFrame, scratch: Scratch, name: int, p: VectorParams) -> DataFrame:
    """(c, links): the weight of the classes linked with each class of a component, all pairs compared in blocks."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b in grouped(batches, ["root", "x", "y"], 1 << 16):
            rows = batch.slice(a, b - a)
            x, y, own = rows.column("x")[0].as_py(), rows.column("y")[0].as_py(), rows.column("own").to_numpy()
            ids, weight, m = rows.column("c").to_numpy(), rows.column("w").to_numpy(), matrix(batch, a, b)
            left, right = np.flatnonzero(own == x), np.flatnonzero(own == y)
            links = np.zeros(len(ids), np.int64)
            for k in range(0, len(left), p.block):
                i = left[k : k + p.block]
                hit = m[i] @ m[right].T >= p.threshold
                if x == y:
                    hit &= i[:, None] != right[None, :]
                links[i] += hit @ weight[right]
                if x != y:
                    links[right] += hit.T @ weight[i]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links)], names=["c", "links"])

    size = scratch.table(roots.groupBy("root").agg(F.ceil(F.count("*") / p.tile).alias("blocks")), f"tiles-{name}")
    member = roots.join(size, "root").join(v.select("c", "w", "vec"), F.col("node") == F.col("c")).select("root", "blocks", F.pmod(F.xxhash64("c"), F.col("blocks")).alias("own"), "c", "w", "vec")
    zero = F.lit(0).cast("long")
    dealt, granted = member.where("blocks = 1").select("root", zero.alias("x"), zero.alias("y"), "own", "c", "w", "vec"), None
    large = member.where("blocks > 1")
    if not size.where("blocks > 1").isEmpty():
        pairs = scratch.table(_tile_pairs(large, p), f"tile-pairs-{name}")
        met, whole = pairs.where("fate = 'open'"), pairs.where("fate = 'all'")
        sides = met.select("root", "x", "y", F.col("x").alias("own")).unionByName(met.where("x < y").select("root", "x", "y", F.col("y").alias("own")))
        dealt = dealt.unionByName(large.drop("blocks").join(sides, ["root", "own"]).select("root", "x", "y", "own", "c", "w", "vec"))
        given = whole.select("root", F.col("x").alias("own"), F.col("wy").alias("links"), (F.col("x") == F.col("y")).cast("long").alias("self"))
        given = given.unionByName(whole.where("x < y").select("root", F.col("y").alias("own"), F.col("wx").alias("links"), zero.alias("self")))
        given = given.groupBy("root", "own").agg(F.sum("links").alias("links"), F.sum("self").alias("self"))
        granted = large.select("root", "own", "c", "w").join(given, ["root", "own"]).select("c", (F.col("links") - F.col("self") * F.col("w")).alias("links"))
    dealt = dealt.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y", "c")
    counted = dealt.mapInArrow(count, "c long, links long")
    return (counted if granted is None else counted.unionByName(granted)).groupBy("c").agg(F.sum("links").alias("links"))


def _tile_pairs(member: DataFrame, p: VectorParams) -> DataFrame:
    """(root, x, y, wx, wy, fate) of the pairs x <= y of a component's tiles; what the triangle inequality of angles leaves undecided is open."""

    def ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b in grouped(batches, ["root", "own"], 1 << 16):
            x, rows = matrix(batch, a, b), batch.slice(a, b - a)
            mean = x.mean(0)
            center = mean / np.linalg.norm(mean) if np.linalg.norm(mean) > 1e-6 else x[0]
            radius = float(np.arccos(np.clip(x @ center, -1, 1)).max())
            yield pa.RecordBatch.from_arrays(
                [rows.column("root")[:1], rows.column("blocks")[:1], rows.column("own")[:1], pa.array([center.tolist()], pa.list_(pa.float64())), pa.array([radius]), pa.array([int(rows.column("w").to_numpy().sum())])],
                names=["root", "blocks", "own", "center", "radius", "weight"],
            )

    tiles = member.repartition("root", "own").sortWithinPartitions("root", "own").select("root", "blocks", "own", "w", "vec").mapInArrow(ball, "root long, blocks long, own long, center array<double>, radius double, weight long")
    left = tiles.select("root", F.col("own").alias("x"), F.col("center").alias("cx"), F.col("radius").alias("rx"), F.col("weight").alias("wx"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"))
    right = tiles.select("root", F.col("own").alias("y"), F.col("center").alias("cy"), F.col("radius").alias("ry"), F.col("weight").alias("wy"))
    dot = F.aggregate(F.zip_with("cx", "cy", lambda a, b: a * b), F.lit(0.0), lambda s, a: s + a)
    angle = F.when(F.col("x") == F.col("y"), 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot))))
    # angles near zero are exact to about 1e-8
    theta, slack = float(np.arccos(p.threshold)), 1e-6
    fate = F.when(angle + F.col("rx") + F.col("ry") <= theta - slack, "all").when(angle - F.col("rx") - F.col("ry") > theta + slack, "none").otherwise("open")
    return left.join(right, ["root", "y"]).select("root", "x", "y", "wx", "wy", fate.alias("fate"))


def _recall(v: DataFrame, roots: DataFrame, p: VectorParams, total: int) -> float:
    """Share of the links of at most about ``audit_queries`` classes, by brute force over all classes, that lie within components."""
    every = max(1, total // p.audit_queries)
    ask = v.where(F.pmod(F.xxhash64("c", F.lit(p.seed)), F.lit(every)) == 0).limit(4 * p.audit_queries).join(roots, F.col("c") == F.col("node"), "left").select("grp", "c", F.coalesce("root", "c").alias("root"), "vec").collect()
    by: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for g in {r["grp"] for r in ask}:
        own = [r for r in ask if r["grp"] == g]
        by[g] = np.array([r["c"] for r in own]), np.array([r["root"] for r in own]), unit(np.array([r["vec"] for r in own], np.float64).ravel(), len(own))
    queries = v.sparkSession.sparkContext.broadcast(by)

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, a, b in grouped(batches, ["grp"], 4096):
            if (own := queries.value.get(batch.column("grp")[a].as_py())) is None:
                continue
            ids, root = batch.column("c").slice(a, b - a).to_numpy(), batch.column("root").slice(a, b - a).to_numpy()
            hit = (own[2] @ matrix(batch, a, b).T >= p.threshold) & (own[0][:, None] != ids[None, :])
            yield pa.RecordBatch.from_arrays([pa.array([int(hit.sum())]), pa.array([int((hit & (own[1][:, None] == root[None, :])).sum())])], names=["links", "found"])

    rooted = v.join(roots, F.col("c") == F.col("node"), "left").select("grp", "c", F.coalesce("root", "c").alias("root"), "vec")
    row = rooted.mapInArrow(brute, "links long, found long").agg(F.sum("links"), F.sum("found")).first()
    return 1.0 if not row[0] else row[1] / row[0]


def link(vectors: DataFrame, params: VectorParams = VectorParams()) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    return link_audited(vectors, params)[0]


def link_audited(vectors: DataFrame, params: VectorParams = VectorParams()) -> tuple[DataFrame, float]:
    """``link`` and the recall that its audit found: the share of the audited classes' links, by brute force, that lie within components."""
    p, spark = params, vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("vec"), F.col("label").cast("long").alias("label"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    # a component whose square underflows counts as it is: zero only if all are
    valid = F.col("label").isNotNull() & F.col("vec").isNotNull() & (F.size("vec") > 0) & finite & F.exists("vec", lambda x: x != 0)
    good = base.where(F.coalesce(valid, F.lit(False)))
    classes = good.groupBy("label", "vec").agg(F.count("*").alias("w"), F.min("vec_id").alias("least"))
    v = scratch.table(classes.withColumns({"c": F.monotonically_increasing_id(), "dim": F.size("vec").cast("long")}).withColumn("grp", F.xxhash64("label", "dim")), "classes")
    sizes = _sizes(v, p)
    n = v.count()
    graph, done, name = None, 0, 0
    for attempt in range(p.max_seedings):
        tables = range(done, max(p.tables, 2 * done))
        done = tables.stop
        seeded = _seeded(v, sizes, tables, p)
        graph = scratch.table(_merge(seeded if graph is None else seeded.unionByName(graph), p.k), f"graph-{name}")
        for _ in range(p.rounds):
            before = graph.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda t, x: t + x["s"])), F.sum(F.size("near"))).first()
            name += 1
            graph = scratch.table(_merge(graph.unionByName(_descend(graph, v, p)), p.k), f"graph-{name}")
            release(spark)
            after = graph.agg(F.sum(F.aggregate("near", F.lit(0.0), lambda t, x: t + x["s"])), F.sum(F.size("near"))).first()
            if not before[1] or (after[0] or 0) - (before[0] or 0) <= p.settled * before[1]:
                break
        links = graph.select("c", F.explode("near").alias("e")).where(F.col("e.s") >= p.threshold - 1e-6).select(F.col("c").alias("a"), F.col("e.u").alias("b"))
        links = scratch.table(_exact(links, v, p), f"links-{name}")
        roots = scratch.table(components(links, scratch), f"roots-{name}")
        roots = _bridged(graph, v, links, roots, done, scratch, name, p)
        name += 1
        if (recall := _recall(v, roots, p, n)) >= p.target:
            break
    else:
        raise RuntimeError(f"the audit finds {recall:.4f} of the links within components after {p.max_seedings} seedings, under {p.target}")
    counted = _complete(v, roots, scratch, name, p)
    least = v.select("c", "least").join(roots, F.col("c") == F.col("node")).groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = v.select("c", "label", "vec", "w", "least").join(roots, F.col("c") == F.col("node"), "left").join(least, "root", "left").join(counted, "c", "left").select(
        "label", "vec", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id")
    )
    judged = good.join(of_class, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    rest = base.where(~F.coalesce(valid, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = judged.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    out = Scratch(spark, "vectors-result").table(out, "vectors")
    scratch.drop("")
    return out, recall


def _exact(pairs: DataFrame, v: DataFrame, p: VectorParams) -> DataFrame:
    """The pairs of cosine >= threshold, computed anew from the two vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(k).flatten().to_numpy().astype(np.float64) for k in ("x", "y"))
            cut = np.concatenate([[0], np.cumsum(np.diff(batch.column("x").offsets.to_numpy()))])
            own = np.repeat(np.arange(batch.num_rows), np.diff(cut))
            dot, xx, yy = (np.bincount(own, weights=w, minlength=batch.num_rows) for w in (x * y, x * x, y * y))
            yield batch.select(["a", "b"]).filter(pa.array(dot / np.sqrt(xx * yy) >= p.threshold))

    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = pairs.join(v.select(F.col("c").alias("a"), F.col("vec").alias("x")), "a").join(v.select(F.col("c").alias("b"), F.col("vec").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")
