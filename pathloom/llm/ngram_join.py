"""N-gram Jaccard join: grouped prefix join over sets of word shingles, exact, with connected components.

1. *Order.*  Shingles that several distinct sets of an input split share are counted over all splits; the
   ``max_heavy`` commonest come last in the global order (by count), all others first, by hash.  Any fixed order gives right
   results; this one keeps common passages out of prefixes.  The broadcast order is bounded by ``max_heavy`` entries.
   The first prefixes are looked at once before any pair is made: shingles that two groups share there are marked in a bitmap and come after all unmarked ones, so texts
   that only chance phrases bind, whose pairs grow with the square of the input, seldom meet.  The bitmap has at most ``mark_bits`` bits; a fuller one marks too much and results stay the same.
2. *Groups.*  Documents of one set are one class; classes of one size and one prefix are one group (its hash is computed in place,
   and each split emits a group once, so copies are collapsed before anything is shuffled).
3. *Candidates.*  Prefix tokens travel as packed arrays to token buckets; groups that share a token are candidates if
   their sizes allow the threshold and they share enough of their prefixes for it.  Up to ``short_list`` groups a token, all pairs.  Longer lists that overlap form
   clusters, and a cluster's sets meet once in one task, where an inverted index compares each set with all others at once, and only sets that no link has reached yet need that.  So many
   near copies cost their number, not its square.  A cluster of more than ``cluster_shingles`` is not held in a task: its lists are compared by pairs, with
   their centres first and in rounds after that, for groups that are still in different components.  No pair that could join two components is skipped.
4. *Verification.*  Group pairs expand to classes; the classes' sets are rebuilt from the texts and compared exactly (64-bit shingle hashes).  Of the texts only those that a bitmap
   of the wanted rows lets through are shuffled.
5. *Components* of the verified links, carried back to every document of a class.

A document's set: distinct shingles of ``words`` words (runs of anything but space and 0x09-0x0D, A-Z lower-cased); with fewer words, the whole sequence as one;
without words, empty.  Two sets link when 100 * intersection >= percent * union.  Rows: null and empty texts have an empty set, link with nothing and are
their own component, copies included; a null id takes part in links but is never the least id (its component id is null if no id is reachable); repeated rows give repeated results;
an empty table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .components import components
from .scratch import Scratch, release, small_batches


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    percent: int = 75
    max_heavy: int = 1_000_000
    #: distinct sets of one split that must share a shingle for it to be counted
    heavy_local: int = 2
    short_list: int = 24
    #: text per token bucket
    bucket_bytes: int = 32 << 20
    #: most bits of the bitmaps of shared shingles and of wanted rows
    mark_bits: int = 1 << 28
    #: shingles of a cluster that one task may hold
    cluster_shingles: int = 16_000_000
    #: prefix tokens that a task holds before it packs them
    held_tokens: int = 500_000
    max_rounds: int = 40


def overlap_needed(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of a set of ``n`` that any partner must share: the least k with 100 k >= percent n."""
    return -(-percent * n // 100)


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return np.where(n > 0, n - overlap_needed(n, percent) + 1, 0)


#: bits of a bitmap that travel together
PART = 1 << 19


def _bits(least: int, most: int) -> int:
    """Size of a bitmap: a power of two, of one part at least."""
    return max(PART, min(1 << max(0, least - 1).bit_length(), 1 << max(1, most).bit_length() - 1))


def _places(place: np.ndarray) -> pa.RecordBatch:
    """(part, places) of distinct places in a bitmap, packed by its parts."""
    place = np.unique(place.astype(np.uint64))
    part, cut = np.unique(place // tk.U64(PART), return_index=True)
    within = (place % tk.U64(PART)).astype(np.uint32)
    return pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array([x.tobytes() for x in np.split(within, cut[1:])] if len(part) else [], pa.binary())], names=["part", "places"])


def _bitmap(places: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of packed ``places``: parts are put together by tasks, the driver gets ``bits`` bits at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, np.zeros(PART, bool)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["part", "places"])
        for batch in batches:
            for part, blob in zip(*(x.to_pylist() for x in batch.columns)):
                if part != now and now is not None:
                    yield done()
                    own[:] = False
                now = part
                own[np.frombuffer(blob, np.uint32)] = True
        if now is not None:
            yield done()
        tk.give_back()

    out = np.zeros(bits // 8, np.uint8)
    dealt = places.repartition("part").sortWithinPartitions("part").mapInArrow(run, "part int, places binary")
    for row in dealt.collect():
        out[row["part"] * (PART // 8) : (row["part"] + 1) * (PART // 8)] = np.frombuffer(row["places"], np.uint8)
    return out


def _marked(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
    return (bitmap[(place >> tk.U64(3)).astype(np.int64)] >> (place & tk.U64(7)).astype(np.uint8)) & 1 == 1


def _set_key(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes())


def _heavy(docs: DataFrame, p: JoinParams) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes sorted, their ranks from 1) of the commonest shingles."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(held), return_counts=True)
            keep = n >= p.heavy_local
            return pa.RecordBatch.from_arrays([pa.array(value[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], names=["h", "n"])

        for batch in batches:
            for first, end, flat, offsets in tk.chunks(batch.column(0)):
                h, cut = tk.shingle_sets(flat, offsets, p.words)
                fresh = np.zeros(end - first, bool)
                for r in range(end - first):
                    key = _set_key(h[cut[r] : cut[r + 1]])
                    if key not in seen:
                        seen.add(key)
                        fresh[r] = True
                own = h[np.repeat(fresh, np.diff(cut))]
                held.append(own)
                size += len(own)
                if size > 3_000_000:  # bounds the task's memory; each part counts on its own
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
        seen.clear()
        held.clear()
        tk.give_back()

    total = docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    top = total.orderBy(F.desc("n"), "h").limit(p.max_heavy).toArrow()
    h, n = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order]


def _pack(token: np.ndarray, group: np.ndarray, n: np.ndarray) -> bytes:
    """Entries of one bucket: distinct groups with their sizes, then tokens and places in the list of groups."""
    own, at = np.unique(group, return_inverse=True)
    size = np.empty(len(own), np.uint32)
    size[at] = n
    wide = np.uint16 if len(own) <= 0xFFFF else np.uint32
    return np.array([len(own), len(token), wide().itemsize], np.uint32).tobytes() + own.tobytes() + size.tobytes() + token.tobytes() + at.astype(wide).tobytes()


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    groups, tokens, width = (int(x) for x in np.frombuffer(blob, np.uint32, 3))
    at = 12
    own = np.frombuffer(blob, np.uint64, groups, at)
    size = np.frombuffer(blob, np.uint32, groups, at + 8 * groups)
    token = np.frombuffer(blob, np.uint32, tokens, at + 12 * groups)
    place = np.frombuffer(blob, np.uint16 if width == 2 else np.uint32, tokens, at + 12 * groups + 4 * tokens)
    return token, own[place], size[place]


INDEX = "row_key long, doc_id long, n long, class binary, grp long, bucket int, blob binary"


def _token_place(token: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """Place in the bitmap of shared shingles, from what a bucket keeps of a token."""
    return token % (tk.U64(buckets) << tk.U64(32)) % tk.U64(bits)


def _index(docs: DataFrame, heavy, shared, buckets: int, p: JoinParams) -> DataFrame:
    """Rows of documents (bucket null) and of packed prefix tokens (bucket set); without ``shared``, the bitmap of shared shingles, only the latter."""
    schema = pa.schema([("row_key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.binary()), ("grp", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, rank = heavy.value
        bitmap = shared.value if shared else None
        done: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, group, n = (np.concatenate(x) for x in zip(*held))
            own = (token % tk.U64(buckets)).astype(np.int64)
            short = (token // tk.U64(buckets)).astype(np.uint32)
            order = np.lexsort((short, own))
            own, short, group, n = own[order], short[order], group[order], n[order]
            cut = np.searchsorted(own, np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cut))
            blobs = [_pack(short[a:b], group[a:b], n[a:b]) for a, b in zip(cut[full], cut[full + 1])]
            void = [pa.nulls(len(full), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64())]
            return pa.RecordBatch.from_arrays([*void, pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], schema=schema)

        for batch in batches:
            for first, end, flat, offsets in tk.chunks(batch.column(2)):
                h, cut = tk.shingle_sets(flat, offsets, p.words)
                rows = end - first
                n = np.diff(cut)
                owner = np.repeat(np.arange(rows), n)
                weight = np.zeros(len(h), np.int64)
                if len(common) and len(h):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    weight = np.where(common[at] == h, rank[at] + 1, 0)
                if bitmap is not None and len(h):
                    weight = np.maximum(weight, _marked(bitmap, _token_place(h, buckets, 8 * len(bitmap))))
                order = np.lexsort((h, weight, owner))
                place = np.arange(len(h)) - np.repeat(cut[:-1], n)
                keep = place < np.repeat(prefix_length(n, p.percent), n)
                token, own = h[order][keep], owner[keep]
                tcut = np.searchsorted(own, np.arange(rows + 1))
                group = np.array([xxhash.xxh3_64_intdigest(token[tcut[r] : tcut[r + 1]].tobytes(), int(n[r])) for r in range(rows)], np.uint64)
                fresh = np.zeros(rows, bool)
                for r, g in enumerate(group.tolist()):
                    if n[r] and g not in done:
                        done.add(g)
                        fresh[r] = True
                pick = fresh[own]
                held.append((token[pick], group[own[pick]], n[own[pick]]))
                size += int(pick.sum())
                if bitmap is not None:
                    classes = [_set_key(h[cut[r] : cut[r + 1]]) if n[r] else None for r in range(rows)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(first, rows), batch.column(1).slice(first, rows), pa.array(n.astype(np.int64)), pa.array(classes, pa.binary()), pa.array(group.view(np.int64)), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary())],
                        schema=schema,
                    )
                if size > p.held_tokens:
                    yield flush()
                    held, size = [], 0
        if held and size:
            yield flush()
        held.clear()
        tk.give_back()

    return docs.select("row_key", "doc_id", "text").mapInArrow(run, INDEX)


def _by_bucket(index: DataFrame, buckets: int, finish: Callable[[int, list[bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``finish`` makes of each bucket and its packed tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs = None, []
        for batch in batches:
            for b, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if b != now and blobs:
                    yield from finish(now, blobs)
                    blobs = []
                now = b
                blobs.append(blob)
        if blobs:
            yield from finish(now, blobs)
        blobs.clear()
        tk.give_back()

    packed = index.where(F.col("bucket").isNotNull()).select("bucket", "blob")
    return packed.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)


def _shared(index: DataFrame, buckets: int, p: JoinParams) -> np.ndarray:
    """Bitmap of the tokens that several groups have in their prefixes."""
    bits = _bits(buckets << 19, p.mark_bits)

    def finish(bucket: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        token, group, _ = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
        order = np.lexsort((group, token))
        token, group = token[order], group[order]
        several = token[1:][(token[1:] == token[:-1]) & (group[1:] != group[:-1])]
        yield _places(_token_place(tk.U64(bucket) + tk.U64(buckets) * several.astype(np.uint64), buckets, bits))

    return _bitmap(_by_bucket(index, buckets, finish, "part int, places binary"), bits)


def _pairs(token: np.ndarray, group: np.ndarray, n: np.ndarray, p: JoinParams) -> tuple[list[np.ndarray], list[list]]:
    """Distinct candidate pairs (group, group, size, size, tokens) of the short lists of one bucket, and its distinct long lists (groups, sizes, tokens), sorted by size."""
    order = np.lexsort((group, n, token))
    token, group, n = token[order], group[order], n[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (group[1:] != group[:-1])
    token, group, n = token[new], group[new], n[new]
    edge = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]])) if len(token) else np.zeros(1, np.int64)
    length = np.diff(edge)
    long_lists = {}
    for k in np.flatnonzero(length > p.short_list):
        own = group[edge[k] : edge[k + 1]]
        held = long_lists.setdefault(xxhash.xxh3_128_digest(own.tobytes()), [own, n[edge[k] : edge[k + 1]], 0])
        held[2] += 1
    short = np.repeat((length > 1) & (length <= p.short_list), length)
    token, group, n = token[short], group[short], n[short]
    found = []
    for d in range(1, p.short_list):
        if len(token) <= d:
            break
        ok = (token[d:] == token[:-d]) & (100 * n[:-d].astype(np.int64) >= p.percent * n[d:].astype(np.int64))
        a, b = group[:-d][ok], group[d:][ok]
        if not len(a):
            if not (token[d:] == token[:-d]).any():
                break
            continue
        turn = a > b
        na, nb = n[:-d][ok].astype(np.uint64), n[d:][ok].astype(np.uint64)
        found.append(np.stack([np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)], 1))
    if found:
        both = np.concatenate(found)
        both = both[np.lexsort((both[:, 1], both[:, 0]))]
        first = np.flatnonzero(np.concatenate([[True], (both[1:, :2] != both[:-1, :2]).any(1)]))
        found = [np.concatenate([both[first], np.diff(np.append(first, len(both)))[:, None].astype(np.uint64)], 1)]
    return found, list(long_lists.values())


CANDIDATES = "a long, b long, na long, nb long, tokens long, list array<struct<g: long, n: long>>"


def _candidates(index: DataFrame, buckets: int, p: JoinParams, cap: int = 8192) -> DataFrame:
    """Pairs (a, b) of groups from short lists, and the long lists; a list over ``cap`` comes as every pair of its parts."""
    kind = pa.list_(pa.struct([("g", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([*((x, pa.int64()) for x in ("a", "b", "na", "nb", "tokens")), ("list", kind)])
    void = pa.nulls(1, pa.int64())

    def as_list(g: np.ndarray, n: np.ndarray) -> list[dict]:
        return [{"g": x, "n": y} for x, y in zip(g.view(np.int64).tolist(), n.tolist())]

    def finish(_: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        token, group, n = (np.concatenate(x) for x in zip(*map(_unpack, blobs)))
        pairs, lists = _pairs(token, group, n, p)
        for x in pairs:
            yield pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x[:, k]).view(np.int64)) for k in range(5)), pa.nulls(len(x), kind)], schema=schema)
        for g, m, times in lists:
            half = cap // 2
            parts = [slice(k, k + half) for k in range(0, len(g), half)] if len(g) > cap else [slice(0, len(g))]
            for i, x in enumerate(parts):
                for y in parts[i + 1 :] if len(parts) > 1 else [slice(0, 0)]:
                    yield pa.RecordBatch.from_arrays([void, void, void, void, pa.array([times]), pa.array([as_list(np.concatenate([g[x], g[y]]), np.concatenate([m[x], m[y]]))], kind)], schema=schema)

    return _by_bucket(index, buckets, finish, CANDIDATES)


def _let_through(docs: DataFrame, wanted: DataFrame, p: JoinParams) -> DataFrame:
    """The rows of ``docs`` whose row_key ``wanted`` may hold: all that it holds, and about a sixteenth of the others while the bitmap has room."""
    bits = _bits(16 * wanted.count(), p.mark_bits)
    place = lambda x: x.to_numpy().view(np.uint64) % tk.U64(bits)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _places(place(batch.column(0)))

    bitmap = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select("row_key").mapInArrow(places, "part int, places binary"), bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_marked(bitmap.value, place(batch.column(0)))))
        tk.give_back()

    return docs.select("row_key", "text").mapInArrow(run, "row_key long, text string")


def _sets(docs: DataFrame, wanted: DataFrame, p: JoinParams) -> DataFrame:
    """(class, cluster, set) of the classes in ``wanted`` (row_key, class, cluster), rebuilt from one document each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # repeated rows
        for batch in batches:
            keys, clusters = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, end, flat, offsets in tk.chunks(batch.column(0)):
                h, cut = tk.shingle_sets(flat, offsets, p.words)
                own = []
                for r in range(end - first):
                    key, data = keys[first + r], h[cut[r] : cut[r + 1]]
                    if key not in done and _set_key(data) == key:
                        done.add(key)
                        own.append((key, clusters[first + r], data.tobytes()))
                if own:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*own), (pa.binary(), pa.int64(), pa.binary()))], names=["class", "cluster", "set"])

    return _let_through(docs, wanted, p).join(wanted, "row_key").select("text", "class", "cluster").mapInArrow(run, "class binary, cluster long, set binary")


#: entries that a step beside a cluster's index looks at together
BLOCK = 1 << 18


def tree_links(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join each component of the sets, and no more than it takes, by one-against-all overlaps through an inverted index."""
    return _tree_links(iter(sets), np.array([len(x) for x in sets]), percent)


def _tree_links(sets: Iterator[np.ndarray], n: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """``tree_links`` of sets of known sizes, which are taken one by one, so the caller may let go of each.

    A task holds about 16 bytes for each shingle at once; comparing sets takes ``BLOCK`` entries of the index at a time, whatever their number."""
    g = len(n)
    start = np.concatenate([[0], np.cumsum(n)])
    flat = np.empty(int(start[-1]), np.uint64)
    for k, x in enumerate(sets):
        flat[start[k] : start[k + 1]] = x
    own, size = np.sort(flat), 0
    for k in range(0, len(own), BLOCK):  # distinct ones move to the front
        part = np.unique(own[k : k + BLOCK])
        part = part[1:] if size and part[0] == own[size - 1] else part
        own[size : size + len(part)] = part
        size += len(part)
    own = own[:size]
    code = np.empty(len(flat), np.int32)
    for k in range(0, len(flat), BLOCK):
        code[k : k + BLOCK] = np.searchsorted(own, flat[k : k + BLOCK])
    del flat, own
    first = np.zeros(size + 1, np.int32)
    for k in range(g):  # a set holds a shingle once
        first[code[start[k] : start[k + 1]] + 1] += 1
    np.cumsum(first, out=first)
    owners, filled = np.empty(len(code), np.int32), first[:-1].copy()
    for k in range(g):
        c = code[start[k] : start[k + 1]]
        owners[filled[c]] = k
        filled[c] += 1
    del filled

    def linked(k: int) -> np.ndarray:
        c = code[start[k] : start[k + 1]]
        size = (first[c + 1] - first[c]).astype(np.int64)
        end, both, a = np.cumsum(size), np.zeros(g, np.int64), 0
        while a < len(c):
            b = max(a + 1, int(np.searchsorted(end, (end[a - 1] if a else 0) + BLOCK, "right")))
            own = size[a:b]
            at = np.repeat(first[c[a:b]] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            both += np.bincount(owners[at], minlength=g)
            a = b
        return 100 * both >= percent * (n + n[k] - both)

    root = np.arange(g)
    out: list[tuple[int, int]] = []
    todo = np.ones(g, bool)
    # spread from one set while that pays: sets of one component needn't be compared with each other
    front, reached = [0], np.zeros(g, bool)
    reached[0] = True
    while front and not reached.all():
        k = front.pop()
        todo[k] = False
        new = np.flatnonzero(linked(k) & ~reached)
        out += [(k, int(x)) for x in new]
        reached[new] = True
        front += new.tolist()
        if len(new) < 2:
            break
    root[reached] = 0
    for k in np.flatnonzero(~reached).tolist():
        for x in np.flatnonzero(linked(k)).tolist():
            if root[x] != root[k]:
                out.append((k, x))
                root[root == root[k]] = root[x]
    return out


def _clustered(sets: DataFrame, p: JoinParams) -> DataFrame:
    """Links (a, b) that join the components of each cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, []

        def finish() -> pa.RecordBatch:
            keys, n = [key for key, _ in own], np.array([len(x) // 8 for _, x in own])
            own.reverse()
            found = _tree_links((np.frombuffer(own.pop()[1], np.uint64) for _ in keys), n, p.percent) if len(keys) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([keys[k] for k, _ in found], pa.binary()), pa.array([keys[k] for _, k in found], pa.binary())], names=["a", "b"])

        for batch in batches:
            for c, key, data in zip(*(x.to_pylist() for x in batch.columns)):
                if c != now and own:
                    yield finish()
                    own = []
                now = c
                own.append((key, data))
        if own:
            yield finish()
        own.clear()
        tk.give_back()

    dealt = sets.repartition("cluster").sortWithinPartitions("cluster", "class")
    return dealt.select("cluster", "class", "set").mapInArrow(run, "a binary, b binary")


def _verify(pairs: DataFrame, sets: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) of classes that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                common = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep[k] = 100 * common >= p.percent * (len(x) + len(y) - common)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = pairs.join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a")
    both = left.join(sets.select(F.col("class").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y")
    return both.mapInArrow(run, "a binary, b binary").distinct()


def _likely(pairs: DataFrame, lists: DataFrame, p: JoinParams) -> DataFrame:
    """The pairs (a, b) whose shared prefix tokens can make up the overlap that the threshold asks for.

    Of two prefixes one ends first; the set it belongs to can share with the other what both prefixes share and its own rest, no more.
    Tokens of long lists aren't counted by pair, so as many as either group has of them are taken as shared.
    """
    shared = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("tokens").alias("tokens"))
    common = lists.select("tokens", F.explode("list.g").alias("g")).groupBy("g").agg(F.sum("tokens").alias("more"))
    for side in ("a", "b"):
        shared = shared.join(common.select(F.col("g").alias(side), F.col("more").alias(f"more_{side}")), side, "left")
    rest = lambda n: F.expr(f"({p.percent} * {n} + 99) div 100 - 1")  # noqa: E731  shingles after the prefix
    most = F.col("tokens") + F.least(F.coalesce("more_a", F.lit(0)), F.coalesce("more_b", F.lit(0))) + F.greatest(rest("na"), rest("nb"))
    return shared.where((100 + p.percent) * most >= p.percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _centre_pairs(lists: DataFrame, p: JoinParams) -> DataFrame:
    """Pairs of each group of a long list with the list's centres: the least group, and the first that is too large for the centre before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                a, b, centre = [], [], None
                for x in own:
                    if centre is None or 100 * centre["n"] < p.percent * x["n"]:
                        centre = x
                    else:
                        a.append(min(centre["g"], x["g"]))
                        b.append(max(centre["g"], x["g"]))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return lists.select("list").mapInArrow(run, "a long, b long")


def _star(lists: DataFrame) -> DataFrame:
    """(a, b): each group of a long list with the list's first."""
    return lists.select(F.element_at("list.g", 1).alias("a"), F.explode("list.g").alias("b")).where("a != b").distinct()


def _row_key() -> Column:
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")))


def link(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id, class, row_key, root of every document; documents without shingles have no class and no root."""
    p, spark = params, docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "ngram-join", row_group=16 << 20)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row_key", _row_key())
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // p.bucket_bytes))
    heavy = spark.sparkContext.broadcast(_heavy(base, p))
    shared = spark.sparkContext.broadcast(_shared(_index(base, heavy, None, buckets, p), buckets, p))
    release(spark)
    index = scratch.table(_index(base, heavy, shared, buckets, p), "index")
    found = scratch.table(_candidates(index, buckets, p), "candidates")
    release(spark)

    rows = index.where(F.col("bucket").isNull() & (F.col("n") > 0)).select("row_key", "n", "class", "grp")
    classes = scratch.table(rows.groupBy("class", "grp", "n").agg(F.min("row_key").alias("row_key")), "classes")
    lists = scratch.table(found.where(F.col("list").isNotNull()).groupBy("list").agg(F.sum("tokens").alias("tokens")), "lists")
    member = classes.select("grp", "class")

    # clusters: groups that long lists bind, and the classes of one group
    several = member.groupBy("grp").agg(F.count("*").alias("k")).where("k > 1").select("grp")
    bound = components(_star(lists), scratch)
    cluster = several.unionByName(lists.select(F.explode("list.g").alias("grp"))).distinct().join(bound.withColumnRenamed("node", "grp"), "grp", "left").select("grp", F.coalesce("root", "grp").alias("cluster"))
    sized = cluster.join(classes.select("grp", "n"), "grp").groupBy("cluster").agg(F.sum("n").alias("shingles"))
    cluster = scratch.table(cluster.join(sized, "cluster").select("grp", "cluster", (F.col("shingles") > p.cluster_shingles).alias("large")), "clusters")

    def expand(pairs: DataFrame) -> DataFrame:
        x, y = member.select(F.col("grp").alias("a"), F.col("class").alias("ca")), member.select(F.col("grp").alias("b"), F.col("class").alias("cb"))
        both = pairs.join(x, "a").join(y, "b").where(F.col("ca") != F.col("cb"))
        return both.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct()

    large = cluster.where("large").select("grp")
    large_lists = lists.join(large, F.element_at("list.g", 1) == F.col("grp"), "left_semi")
    group_pairs = _likely(found.where(F.col("list").isNull()), lists, p).unionByName(_centre_pairs(large_lists, p)).distinct()
    small = cluster.where("not large").select("grp", "cluster")
    for side in ("a", "b"):  # what one cluster holds is compared there
        group_pairs = group_pairs.join(small.select(F.col("grp").alias(side), F.col("cluster").alias(f"c{side}")), side, "left")
    group_pairs = group_pairs.where(F.col("ca").isNull() | F.col("cb").isNull() | (F.col("ca") != F.col("cb"))).select("a", "b")
    large_inner = member.join(several, "grp", "left_semi").join(large, "grp", "left_semi")
    least = large_inner.groupBy("grp").agg(F.min("class").alias("a"))
    inner = large_inner.join(least, "grp").where(F.col("class") != F.col("a")).select("a", F.col("class").alias("b"))
    pairs = scratch.table(expand(group_pairs).unionByName(inner).distinct(), "pairs-0")

    # one pass over the texts gives the sets of whatever is compared now or in a later round
    compared = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).unionByName(member.join(cluster, "grp", "left_semi").select("class")).distinct()
    wanted = scratch.table(classes.select("class", "grp", "row_key").join(compared, "class", "left_semi").join(small, "grp", "left").select("row_key", "class", "cluster"), "wanted")
    sets = scratch.table(_sets(base.select("row_key", "text"), wanted, p), "sets")
    release(spark)
    links = scratch.table(_verify(pairs, sets, p).unionByName(_clustered(sets.where(F.col("cluster").isNotNull()), p)), "links-0")
    release(spark)
    # lists and groups of large clusters: what is still apart is compared in rounds
    tested, roots = pairs, components(links, scratch)
    for k in range(1, p.max_rounds + 1):
        if large.isEmpty():
            break
        more = scratch.table(_apart(large_lists, large_inner, classes, roots, tested, p), f"apart-{k}")
        if more.isEmpty():
            break
        fresh = scratch.table(_verify(more, sets, p), f"links-{k}")
        tested = tested.unionByName(more)
        if fresh.isEmpty():
            continue
        links = links.unionByName(fresh)
        roots = components(links, scratch)
    else:
        raise RuntimeError(f"lists are still apart after {p.max_rounds} rounds")

    named = index.where(F.col("bucket").isNull()).select("row_key", "doc_id", F.col("n").alias("n_shingles"), "class")
    least = named.where(F.col("class").isNotNull()).groupBy("class").agg(F.min("doc_id").alias("least"))
    of_root = least.join(roots, F.col("class") == F.col("node"), "left").select("class", "least", F.coalesce("root", "class").alias("root"))
    by_root = of_root.groupBy("root").agg(F.min("least").alias("component_id"))
    final = of_root.join(by_root, "root").select("class", "component_id", "root")
    out = named.join(final, "class", "left").select("doc_id", "n_shingles", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "class", "row_key", "root")
    out = Scratch(spark, "ngram-join-result").table(out, "documents")
    scratch.drop("")
    return out


#: pairs of a list that are handed on together
APART = 50_000


def _apart(lists: DataFrame, inner: DataFrame, classes: DataFrame, roots: DataFrame, tested: DataFrame, p: JoinParams) -> DataFrame:
    """All untested class pairs of long lists and groups that lie in different components and whose sizes allow a link."""
    sized = classes.select("class", "grp", "n").join(roots.withColumnRenamed("node", "class"), "class", "left").select("grp", "n", "class", F.coalesce("root", "class").alias("root"))
    by_list = lists.withColumn("id", F.xxhash64("list")).select("id", F.explode("list.g").alias("grp")).unionByName(inner.select(F.col("grp").alias("id"), "grp").distinct())
    member = by_list.join(sized, "grp").select("id", "n", "class", "root")
    open_ = member.groupBy("id").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 != r1").select("id")
    member = member.join(open_, "id", "left_semi")
    mixed = member.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("n", "class", "root"))).alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in batch.column(0).to_pylist():
                n = np.array([x["n"] for x in own])
                _, root = np.unique(np.array([x["root"].hex() for x in own]), return_inverse=True)
                size = np.bincount(root)
                a, b = [], []
                for k, x in enumerate(own):
                    # the smaller component asks, so a large one is met once by each outsider
                    ok = (root != root[k]) & (100 * np.minimum(n, n[k]) >= p.percent * np.maximum(n, n[k]))
                    ok &= (size[root] > size[root[k]]) | ((size[root] == size[root[k]]) & (np.arange(len(own)) > k))
                    for j in np.flatnonzero(ok):
                        a.append(min(x["class"], own[j]["class"]))
                        b.append(max(x["class"], own[j]["class"]))
                    if len(a) > APART:  # all pairs of a list are too many for a task
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])
                        a, b = [], []
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    return mixed.select("own").mapInArrow(run, "a binary, b binary").distinct().join(tested, ["a", "b"], "left_anti")


def query(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """doc_id, n_shingles, component_id of every document."""
    return link(docs, params).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, params: JoinParams = JoinParams()) -> DataFrame:
    """``docs`` with exactly one row of each component: of the least id the one with the least set of shingles, then the least row key; of rows alike in id and text any.

    Documents without shingles are a component for each id.
    """
    found = link(docs, params)
    component = F.coalesce("root", F.col("doc_id").cast("string").cast("binary"), F.lit("null").cast("binary"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "class", "row_key"))["row_key"].alias("__keep_one_row_key")
    kept = found.groupBy(F.col("root").isNull().alias("bare"), component.alias("component")).agg(first).select("__keep_one_row_key")
    repeated = found.groupBy(F.col("row_key").alias("__keep_one_row_key")).count().where("count > 1").select("__keep_one_row_key")
    keyed = docs.withColumn("__keep_one_row_key", _row_key())
    once = keyed.join(kept.join(repeated, "__keep_one_row_key", "left_anti"), "__keep_one_row_key", "left_semi")
    several = keyed.join(kept.join(repeated, "__keep_one_row_key", "left_semi"), "__keep_one_row_key", "left_semi").dropDuplicates(["__keep_one_row_key"])
    return once.unionByName(several).select(*docs.columns)
