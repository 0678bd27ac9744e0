"""Suffix-array dedup: removes every byte that a repeated string of ``length`` bytes covers, exactly.

A corpus has too many suffixes to sort them all, and most share nothing.  So each window of ``length`` bytes is filed under its
anchor: the least of its ``gram``-byte hashes, leftmost.  Equal windows have equal anchors at equal offsets, and neighbouring windows mostly
share theirs, so a document of n bytes has about 2 n / length *runs*: an anchor and the windows it stands for.

* Texts are reduced to distinct ones first (partial aggregation before the shuffle); a text with copies is removed whole.
* Runs with equal bytes (128-bit hash) form a class: with two members or more, all their windows are repeated.
* Classes with one anchor but different bytes may still share windows.  Within an anchor's group the suffixes from the anchor, and the reversed
  prefixes before it, are put in order by deep-shallow sorting: multikey quicksort over 8-byte symbols to a shallow depth, then blind tries for
  the remaining groups with long common prefixes.  The neighbours' common prefixes give, for every offset, which classes agree on both sides.
* A group beyond ``group_limit`` classes (a passage in very many documents) isn't held in a task: each of its windows is hashed and counted by Spark, exactly.

Rows: null and empty texts, and texts under ``length`` bytes, lose nothing; ids are never used as keys, so null or repeated ones are fine; repeated
rows are copies of each other; an empty table gives no rows; extra columns aren't read by ``find`` and are kept by ``remove``.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import Scratch, release, small_batches


@dataclass(frozen=True)
class DedupParams:
    length: int = 400
    gram: int = 32
    group_limit: int = 20_000
    #: bytes that multikey quicksort looks at before blind tries take over
    shallow: int = 32
    #: a maximal repeated run that touches fewer words stays in its text
    min_words: int = 0


# ---- deep-shallow sorting ------------------------------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def _quick(strings: list[bytes], own: list[int], depth: int, limit: int, out: list[int]) -> None:
    """Multikey quicksort by 8-byte symbols from ``depth``; groups equal up to ``limit`` go to a blind trie."""
    stack = [(own, depth)]
    while stack:
        own, depth = stack.pop()
        if len(own) == 1:
            out.append(own[0])
            continue
        if depth >= limit:
            out.extend(_blind(strings, own))
            continue
        # a shorter string's symbol is padded and its length told apart: an end comes before any byte
        symbol = {i: (strings[i][depth : depth + 8].ljust(8, b"\0"), min(len(strings[i]) - depth, 8)) for i in own}
        pivot = symbol[own[len(own) // 2]]
        less, same, more = [], [], []
        for i in own:
            s = symbol[i]
            (less if s < pivot else more if s > pivot else same).append(i)
        if more:
            stack.append((more, depth))
        if pivot[1] < 8:
            stack.append((same[:1], depth)) if len(same) == 1 else stack.append((sorted(same), limit))
        else:
            stack.append((same, depth + 8))
        if less:
            stack.append((less, depth))


class _Node:
    __slots__ = ("skip", "kids", "leaf")

    def __init__(self, skip: int, leaf: int):
        self.skip, self.kids, self.leaf = skip, {}, leaf


def _blind(strings: list[bytes], own: list[int]) -> list[int]:
    """Order of ``own`` by a blind trie: a node knows how many bytes to skip and branches on the next (-1: the string ends)."""
    at = lambda s, k: s[k] if k < len(s) else -1
    first = own[0]
    root = _Node(len(strings[first]), first)
    ends: dict[int, list[int]] = {first: [first]}
    for i in own[1:]:
        s = strings[i]
        # descend blindly to some leaf; whatever branch is missing, any leaf below tells the true common prefix
        node = root
        while node.kids:
            node = node.kids.get(at(s, node.skip)) or next(iter(node.kids.values()))
        other = strings[node.leaf]
        n = common_prefix(s, other)
        if n == len(s) == len(other):
            ends[node.leaf].append(i)
            continue
        node, parent, edge = root, None, None
        while node.kids and node.skip < n:
            parent, edge = node, at(s, node.skip)
            node = node.kids[edge]
        ends[i] = [i]
        if node.kids and node.skip == n:
            node.kids[at(s, n)] = _Node(len(s), i)
            continue
        fork = _Node(n, node.leaf)
        fork.kids = {at(other, n): node, at(s, n): _Node(len(s), i)}
        if parent is None:
            root = fork
        else:
            parent.kids[edge] = fork
    out: list[int] = []
    stack = [root]
    while stack:
        node = stack.pop()
        if node.kids:
            stack.extend(node.kids[b] for b in sorted(node.kids, reverse=True))
        else:
            out.extend(ends[node.leaf])
    return out


def deep_shallow(strings: list[bytes], shallow: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """Order of the strings and the common prefix of each with the one before it in that order (the first: 0)."""
    order: list[int] = []
    _quick(strings, list(range(len(strings))), 0, shallow, order)
    lcp = [0] + [common_prefix(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return np.array(order, np.int64), np.array(lcp, np.int64)


# ---- anchors -------------------------------------------------------------------------------------------------------------


def runs(flat: np.ndarray, offsets: np.ndarray, p: DedupParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, anchor, windows, anchor hash) of every run of windows of one anchor; starts and anchors count from the buffer's begin."""
    n, w = len(flat), p.length - p.gram + 1
    none = np.zeros(0, np.int64)
    if n < p.length:
        return none, none, none, none, np.zeros(0, np.uint64)
    prefix = tk.prefix_hash(flat)
    _, down = tk.powers(n)
    h = tk.mix((prefix[p.gram :] - prefix[: n - p.gram + 1]) * down[: n - p.gram + 1])
    del prefix
    # the upper half of the hash, then the place: what a window's anchor is depends on the window's bytes alone
    mask = tk.U64(0xFFFFFFFF)
    packed = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
    size = -(-len(packed) // w) * w
    grid = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    grid[: len(packed)] = packed
    grid = grid.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - p.length + 1
    anchor = (np.minimum(back[:windows], ahead[w - 1 : w - 1 + windows]) & mask).astype(np.int64)
    del grid, ahead, back, packed
    first, last = offsets[:-1], np.maximum(offsets[1:] - p.length + 1, offsets[:-1])
    step = np.zeros(n + 2, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, last, -1)
    at = np.flatnonzero(np.cumsum(step)[:windows] > 0)
    if not len(at):
        return none, none, none, none, np.zeros(0, np.uint64)
    own = anchor[at]
    row = np.searchsorted(offsets, at, "right") - 1
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (row[1:] != row[:-1])]))
    return row[new], at[new], own[new], np.diff(np.append(new, len(at))), h[own[new]]


RUNS = "h long, ctx binary, key binary, x0 long, d int, m int"


def _runs(texts: DataFrame, p: DedupParams) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, flat, offsets in tk.chunks(batch.column(1)):
                row, x0, anchor, m, h = runs(flat, offsets, p)
                view = memoryview(flat)
                ctx = [xxhash.xxh3_128_digest(view[a : a + b]) for a, b in zip(x0.tolist(), (m + p.length - 1).tolist())]
                keys = batch.column(0).slice(first, end - first).take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h.view(np.int64)), pa.array(ctx, pa.binary()), keys, pa.array(x0 - offsets[row]), pa.array((anchor - x0).astype(np.int32)), pa.array(m.astype(np.int32))],
                    names=["h", "ctx", "key", "x0", "d", "m"],
                )
        tk.give_back()

    return texts.select("key", "text").mapInArrow(run, RUNS)


# ---- groups of one anchor ------------------------------------------------------------------------------------------------


def shared_windows(members: list[tuple[int, bytes]], p: DedupParams) -> list[tuple[int, int, int]]:
    """(member, first, last) of the windows that some other member has too, for distinct members (anchor offset, bytes) of one anchor."""
    right, left = [b[d + p.gram :] for d, b in members], [b[:d][::-1] for d, b in members]
    length = p.length
    if len(members) == 2:
        l, r = common_prefix(*left), common_prefix(*right) + p.gram
        lo, hi = max(length - r, 0), l
        return [(i, d - hi, d - lo) for i, (d, _) in enumerate(members)] if lo <= hi else []
    n = len(members)
    side = []
    for strings in (left, right):
        order, lcp = deep_shallow(strings, p.shallow)
        lcp[0] = -1
        side.append((order, lcp))
    (lo_, lcp_l), (ro, lcp_r) = side
    lcp_r = np.where(lcp_r >= 0, lcp_r + p.gram, -1)
    # offsets at which the classes of either side change
    edges = np.unique(np.concatenate([lcp_l[1:] + 1, length - lcp_r[1:], [0]]))
    top = int(lcp_l.max())
    edges = edges[(edges >= max(length - int(lcp_r.max()), 0)) & (edges <= top)]
    start = max(length - int(lcp_r.max()), 0)
    if start > top:
        return []
    edges = np.unique(np.append(edges, start))
    hit = np.zeros((len(edges), n), bool)
    a, b = np.empty(n, np.int64), np.empty(n, np.int64)
    for k, delta in enumerate(edges.tolist()):
        a[lo_] = np.cumsum(lcp_l < delta)
        b[ro] = np.cumsum(lcp_r < length - delta)
        _, inverse, count = np.unique(a * (n + 1) + b, return_inverse=True, return_counts=True)
        hit[k] = count[inverse] > 1
    out = []
    stop = np.append(edges[1:], top + 1)
    for i in np.flatnonzero(hit.any(0)).tolist():
        d = members[i][0]
        own = np.flatnonzero(hit[:, i])
        parts = np.split(own, np.flatnonzero(np.diff(own) > 1) + 1)
        out += [(i, d - int(stop[x[-1]]) + 1, d - int(edges[x[0]])) for x in parts]
    return out


FOUND = "h long, ctx binary, lo int, hi int, win binary"


def _shared(contexts: DataFrame, p: DedupParams) -> DataFrame:
    schema = pa.schema([("h", pa.int64()), ("ctx", pa.binary()), ("lo", pa.int32()), ("hi", pa.int32()), ("win", pa.binary())])

    def windows(h: int, ctx: bytes, data: bytes) -> pa.RecordBatch:
        k = len(data) - p.length + 1
        win = [xxhash.xxh3_128_digest(data[i : i + p.length]) for i in range(k)]
        at = pa.array(range(k), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([h] * k), pa.array([ctx] * k, pa.binary()), at, at, pa.array(win, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, large = None, [], False
        rows: list[tuple] = []

        def finish() -> None:
            if len(own) > 1 and not large:
                rows.extend((now, own[i][0], lo, hi, None) for i, lo, hi in shared_windows([(d, b) for _, d, b in own], p))

        for batch in batches:
            for h, ctx, d, data in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if h != now:
                    finish()
                    now, own, large = h, [], False
                if large:
                    yield windows(h, ctx, data)
                    continue
                own.append((ctx, d, data))
                if len(own) > p.group_limit:
                    for c, _, b in own:
                        yield windows(h, c, b)
                    own, large = [], True
            if len(rows) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        finish()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
        rows, own = [], []
        tk.give_back()

    found = contexts.repartition("h").sortWithinPartitions("h", "ctx").select("h", "ctx", "d", "data").mapInArrow(run, FOUND)
    return found


def _contexts(texts: DataFrame, wanted: DataFrame, p: DedupParams) -> DataFrame:
    """(h, ctx, d, data) of the runs in ``wanted`` (key, runs array<struct<x0, d, m, h, ctx>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = tk.text_buffer(batch.column(0))
            lists = batch.column(1)
            own = lists.flatten()
            count = np.diff(lists.offsets.to_numpy())
            begin = np.repeat(offsets[:-1], count) + own.field("x0").to_numpy()
            size = own.field("m").to_numpy() + p.length - 1
            data, view = [], memoryview(flat)
            data = [bytes(view[a : a + b]) for a, b in zip(begin.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([own.field("h"), own.field("ctx"), own.field("d"), pa.array(data, pa.binary())], names=["h", "ctx", "d", "data"])

    return texts.join(wanted, "key").select("text", "runs").mapInArrow(run, "h long, ctx binary, d int, data binary")


def _cut(texts: DataFrame, spans: DataFrame, with_text: bool, min_words: int = 0) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 and, if asked for, what is left as text (bytes of a cut character go) of the texts with spans of ``min_words``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = tk.text_buffer(batch.column(1))
            lists = batch.column(2)
            cut = lists.offsets.to_numpy() - lists.offsets.to_numpy()[0]
            own = lists.flatten()
            s, e = own.field("s").to_numpy(), own.field("e").to_numpy()
            lose, removed, spans, sha, kept_text = [], [], [], [], []
            for r in range(batch.num_rows):
                order = np.argsort(s[cut[r] : cut[r + 1]], kind="stable")
                a, b = s[cut[r] : cut[r + 1]][order], e[cut[r] : cut[r + 1]][order]
                reach = np.maximum.accumulate(b)
                new = np.concatenate([[True], a[1:] > reach[:-1]])
                a, b = a[new], reach[np.append(np.flatnonzero(new)[1:] - 1, len(reach) - 1)]
                data, parts, at = flat[offsets[r] : offsets[r + 1]].tobytes(), [], 0
                gone = [(x, y) for x, y in zip(a.tolist(), b.tolist()) if not min_words or len(data[x:y].split()) >= min_words]
                if not gone:
                    continue
                for x, y in gone:
                    parts.append(data[at:x])
                    at = y
                parts.append(data[at:])
                left = b"".join(parts)
                lose.append(r)
                removed.append(len(data) - len(left))
                spans.append(len(gone))
                sha.append(hashlib.sha256(left).hexdigest())
                if with_text:
                    kept_text.append(b"".join(x.decode("utf-8", "ignore").encode() for x in parts).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(lose, pa.int64())), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), *([pa.array(kept_text, pa.string())] if with_text else [])],
                names=["key", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])],
            )

    return texts.join(spans, "key").select("key", "text", "spans").mapInArrow(run, "key binary, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def _key(text) -> F.Column:
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def repeats(docs: DataFrame, params: DedupParams = DedupParams(), with_text: bool = False) -> DataFrame:
    """key, n_removed, n_spans, kept_sha256 (and kept) of every distinct text that loses bytes; ``key`` is the first half of the text's SHA-256."""
    p, spark = params, docs.sparkSession
    small_batches(spark)
    base = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where(F.octet_length("text") >= p.length).select(_key("text").alias("key"), "text")
    scratch, name, buckets = Scratch(spark, "suffix-dedup"), f"pathloom_texts_{uuid.uuid4().hex}", max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    try:
        # bucketed by key, so the two joins with texts below move only the narrow side; its files lie in the shared folder, whatever the warehouse is
        base.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies")).write.bucketBy(buckets, "key").sortBy("key").option("compression", "zstd").option("path", scratch.path("texts")).format("parquet").saveAsTable(name)
        release(spark)
        return _repeats(spark.table(name), scratch, p, with_text)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        scratch.drop("")


def _repeats(texts: DataFrame, scratch: Scratch, p: DedupParams, with_text: bool) -> DataFrame:
    """``repeats`` of distinct texts (key, text, copies)."""
    spark = texts.sparkSession
    run = scratch.table(_runs(texts, p), "runs")
    classes = run.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "x0", "d", "m")).alias("rep"))
    several = classes.groupBy("h").agg(F.count("*").alias("classes"), F.sum("n").alias("members")).where("members > 1")
    found = classes.join(several.select("h", "classes"), "h").where("classes > 1 or n > 1")
    found = scratch.table(found.select("h", "ctx", "n", "classes", "rep.*"), "classes")
    release(spark)
    wanted = found.where("classes > 1").groupBy("key").agg(F.collect_list(F.struct("x0", "d", "m", "h", "ctx")).alias("runs"))
    shared = scratch.table(_shared(_contexts(texts, wanted, p), p), "shared")
    release(spark)
    plain, counted = shared.where("win is null").select("h", "ctx", "lo", "hi"), shared.where("win is not null")
    twice = counted.groupBy("h", "win").agg(F.count("*").alias("k")).where("k > 1").select("h", "win")
    plain = plain.unionByName(counted.join(twice, ["h", "win"]).select("h", "ctx", "lo", "hi"))
    single = found.where("n = 1").select("h", "ctx", "key", "x0").join(plain, ["h", "ctx"]).select("key", (F.col("x0") + F.col("lo")).alias("s"), (F.col("x0") + F.col("hi") + p.length).alias("e"))
    many = run.select("h", "ctx", "key", "x0", "m").join(found.where("n > 1").select("h", "ctx"), ["h", "ctx"]).select("key", F.col("x0").alias("s"), (F.col("x0") + F.col("m") - 1 + p.length).alias("e"))
    copied = texts.where("copies > 1").select("key", F.lit(0).cast("long").alias("s"), F.octet_length("text").cast("long").alias("e"))
    spans = single.unionByName(many).unionByName(copied).groupBy("key").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    return Scratch(spark, "suffix-dedup-result").table(_cut(texts, spans, with_text, p.min_words), "texts")


def query(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha")).withColumn("key", F.substring(F.unhex("sha"), 1, 16))
    zero = F.lit(0).cast("long")
    return rows.join(repeats(docs, params), "key", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256")
    )


def remove(docs: DataFrame, params: DedupParams = DedupParams()) -> DataFrame:
    """``docs`` with repeated bytes removed from ``text`` (and ``n_chars`` to match, if there); documents that lose all their bytes go."""
    found = repeats(docs, params, with_text=True).select("key", "kept")
    # the row travels as one struct, so its column names can't clash with ours
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _key(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    rows = rows.join(found, "key", "left").where(F.col("kept").isNull() | (F.col("kept") != ""))
    changed = {"text": F.coalesce("kept", "row.text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("kept").isNull(), F.col("row.n_chars")).otherwise(F.char_length("kept").cast(docs.schema["n_chars"].dataType))
    return rows.select(*((changed[c] if c in changed else F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
