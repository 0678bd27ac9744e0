"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

Test items are partitioned by the size of their set of distinct five-word shingles.  Of items with under 16, too few for signatures,
every shingle is looked up in the whole document, so none is missed.  In any other partition ``c``, with
sizes below ``2u``, a document is seen as windows of two neighbouring runs of ``2u`` shingles, so any contiguous
copy of an item lies within one window of like size, however long the document is.  Items and windows get
one-permutation MinHash signatures, with a bin for every four shingles of a window (64 bins at least), so that a shared shingle is its window's minimum
in one of four cases even where an item's sentences are scattered over a long document; a window whose minimum agrees with an item's in any bin makes the
document a candidate for that item, and the candidate stands if the document's set of shingles (words,
not hashes) holds at least ``threshold`` of the item's.

Documents are read once, in place, and nothing is shuffled.  The items' signatures are broadcast: items are taken in
blocks of at most ``block_bytes`` of text (one pass over the documents a block), so the broadcast is bounded however large the benchmark is.

Words are runs of anything but space and 0x09-0x0D, A-Z lower-cased; an item or document with fewer than five
words has its whole sequence as its one shingle.  Rows: null or empty texts match nothing; a null id is kept in the
result; repeated items and documents are matched row by row; a document of any length is looked at whole; a share of exactly the threshold matches; with no items or no
documents nothing matches; other columns aren't read by ``find``, and ``drop_contaminated`` keeps the documents' as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import small_batches

SCHEMA = "doc_id long, item_id long, n_item_shingles long, n_shared long, containment double"
MAX = np.iinfo(np.uint64).max
#: items with fewer distinct shingles are looked up shingle by shingle
FEW, LOW = 16, 1 << 20


@dataclass(frozen=True)
class DecontaminationParams:
    threshold: float = 0.75
    words: int = 5
    #: at least; items of 128 shingles or more have more
    bins: int = 64
    block_bytes: int = 16 << 20


def shingle_set(text: bytes, width: int) -> set[bytes]:
    """Distinct shingles of a text, as bytes."""
    w = text.translate(bytes(tk.LOWER)).split()
    w = [x for x in w if x]
    return {b" ".join(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()


@dataclass
class ItemIndex:
    """Signatures of a bounded block of items, by size partition."""

    params: DecontaminationParams
    ids: list = field(default_factory=list)
    sets: list = field(default_factory=list)
    #: partition: (run length, bins, sorted minima, their items)
    parts: dict = field(default_factory=dict)
    #: of items of few shingles: sorted hashes, their items, and by item how many must be shared
    few: tuple = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    need: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: places of the low bits of those hashes
    maybe: np.ndarray = field(default_factory=lambda: np.zeros(LOW, bool))

    @classmethod
    def build(cls, rows: list[tuple[object, str | None]], params: DecontaminationParams) -> "ItemIndex":
        self = cls(params)
        texts = []
        for i, t in rows:
            if s := shingle_set((t or "").encode(), params.words):
                self.ids.append(i)
                self.sets.append(s)
                texts.append(t)
        if not texts:
            return self
        found: dict[int, list[tuple[int, int]]] = {}
        few: list[tuple[np.ndarray, np.ndarray]] = []
        self.need = np.zeros(len(texts))
        h, cut = tk.shingle_sets(*tk.text_buffer(pa.array(texts, pa.large_string())), params.words)
        for k in range(len(texts)):
            own = h[cut[k] : cut[k + 1]]
            if len(own) < FEW:
                few.append((own, np.full(len(own), k, np.int64)))
                self.need[k] = params.threshold * len(own)
                continue
            part = int(np.log2(len(own)))
            bins = cls.bins(part, params)
            low = np.full(bins, MAX, np.uint64)
            np.minimum.at(low, cls.bin_of(own, bins), own)
            found.setdefault(part, []).extend((int(v), k) for v in low[low != MAX])
        if few:
            own, k = (np.concatenate(x) for x in zip(*few))
            order = np.argsort(own, kind="stable")
            self.few = own[order], k[order]
            self.maybe[(own & tk.U64(LOW - 1)).astype(np.int64)] = True
        for part, pairs in found.items():
            pairs.sort()
            self.parts[part] = (2 << part, cls.bins(part, params), np.array([v for v, _ in pairs], np.uint64), np.array([k for _, k in pairs], np.int64))
        return self

    @staticmethod
    def bins(part: int, params: DecontaminationParams) -> int:
        return max(params.bins, 1 << part)

    @staticmethod
    def bin_of(h: np.ndarray, bins: int) -> np.ndarray:
        # middle bits: the minimum within a bin is then independent of the bin
        return ((h >> tk.U64(20)) % tk.U64(bins)).astype(np.int64)

    def candidates(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of every signature agreement, and of every item of few shingles that shares enough of them."""
        n_rows = len(offsets) - 1
        h, rows = tk.shingles(*tk.words(flat, offsets), n_rows, self.params.words)
        if not len(h):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        out_rows, out_items = [], []
        if len(self.few[0]):
            r, k = self._few(h, rows)
            out_rows.append(r)
            out_items.append(k)
        count = np.bincount(rows, minlength=n_rows)
        place = np.arange(len(h)) - np.repeat(np.cumsum(count) - count, count)
        for run, bins, minima, items in self.parts.values():
            # a row of fewer shingles can't hold enough of any item here; so the signatures' size is in proportion to the text
            enough = count >= self.params.threshold * (run // 2)
            runs = np.where(enough, -(-count // run), 0)
            if not runs.any():
                continue
            own = enough[rows]
            base = np.cumsum(runs) - runs
            low = np.full(int(runs.sum()) * bins, MAX, np.uint64)
            np.minimum.at(low, (base[rows[own]] + place[own] // run) * bins + self.bin_of(h[own], bins), h[own])
            low = low.reshape(-1, bins)
            owner = np.repeat(np.arange(n_rows), runs)
            # a window is a run and the next one of the same row; the last run of a row is a window of its own
            window = low.copy()
            follows = owner[1:] == owner[:-1]
            window[:-1][follows] = np.minimum(low[:-1][follows], low[1:][follows])
            maybe = np.zeros(1 << 16, bool)
            maybe[(minima & tk.U64(0xFFFF)).astype(np.int64)] = True
            w, b = np.nonzero(maybe[(window & tk.U64(0xFFFF)).astype(np.int64)] & (window != MAX))
            values = window[w, b]
            first, last = np.searchsorted(minima, values, "left"), np.searchsorted(minima, values, "right")
            n = last - first
            at = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            out_rows.append(np.repeat(owner[w], n))
            out_items.append(items[at])
        key = np.unique((np.concatenate(out_rows) << 32) | np.concatenate(out_items)) if out_rows else np.zeros(0, np.int64)
        return key >> 32, key & 0xFFFFFFFF

    def _few(self, h: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of the items of few shingles of which a row has as many distinct ones as the threshold asks for."""
        hashes, items = self.few
        at = np.flatnonzero(self.maybe[(h & tk.U64(LOW - 1)).astype(np.int64)])
        first, last = np.searchsorted(hashes, h[at], "left"), np.searchsorted(hashes, h[at], "right")
        hit = last > first
        # a row meets a hash once, however often it repeats it
        place, row = first[hit], rows[at][hit]
        _, one = np.unique(row * len(hashes) + place, return_index=True)
        first, n, row = place[one], (last - first)[hit][one], row[one]
        k = items[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        key, shared = np.unique((np.repeat(row, n) << 32) | k, return_counts=True)
        key = key[shared >= self.need[key & 0xFFFFFFFF]]
        return key >> 32, key & 0xFFFFFFFF

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of every item that a text of the column holds to the threshold."""
        out = []
        for first, _, flat, offsets in tk.chunks(column):
            rows, items = self.candidates(flat, offsets)
            now, own = -1, set()
            for r, k in zip(rows.tolist(), items.tolist()):
                if r != now:
                    now, own = r, shingle_set(flat[offsets[r] : offsets[r + 1]].tobytes(), self.params.words)
                shared = len(self.sets[k] & own)
                if shared >= self.params.threshold * len(self.sets[k]):
                    out.append((first + r, k, shared))
        return out


def _blocks(items: DataFrame, p: DecontaminationParams) -> Iterator[list[tuple[object, str | None]]]:
    """The items in blocks of about ``block_bytes``."""
    small_batches(items.sparkSession)
    base = items.select("item_id", "text").where(F.octet_length("text") > 0)
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // p.block_bytes))
    for k in range(n):
        own = base if n == 1 else base.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r[0], r[1]) for r in own.collect()]


def find(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """One row per pair of a document and an item it holds to the threshold."""
    base, out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), None
    for rows in _blocks(items, params):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex.build(rows, params))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                if found := index.matches(batch.column(1)):
                    r, k, n = (list(x) for x in zip(*found))
                    sizes = [len(index.sets[i]) for i in k]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(r)), pa.array([index.ids[i] for i in k], pa.int64()), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([a / b for a, b in zip(n, sizes)])],
                        names=["doc_id", "item_id", "n_item_shingles", "n_shared", "containment"],
                    )

        part = base.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, params: DecontaminationParams = DecontaminationParams()) -> DataFrame:
    """``docs`` without the rows that hold any item; its columns as they were."""
    at, out = docs.columns.index("text"), docs
    for rows in _blocks(items, params):
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex.build(rows, params))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[[r for r, _, _ in shared.value.matches(batch.column(at))]] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, docs.schema)
    return out
