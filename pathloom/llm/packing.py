"""Packing: lexical retrieval fills fixed token windows with documents that share rare words.

Documents are dealt by hash into shards of about ``shard_bytes`` of text, so a shard fits one task at any
corpus size and a hot source or group of copies spreads evenly.  Each shard has its own BM25 inverted
index; how many documents hold a term, how many there are and how long they are is counted over the whole corpus first (terms by a hash of
``FREQUENCY_BITS`` bits, so the table that is broadcast has one size for every corpus).  A seed's neighbours are those of its shard.  A shard's first unused document opens a window; the index returns the seed's best unused neighbours one
after another, and each is placed whole or cut where the window ends, its rest opening the next window.
So only the last window of a shard is padded.

Token ids come from the named tokenizer.  A text is cut before runs of white space, where that tokenizer
always cuts too, and a worker encodes a distinct piece once while it remembers it.

Rows: null and empty texts are one end-of-document id; null ids and repeated rows are packed like any others;
a text longer than a window fills several, and one longer than a shard is a shard's all the same; of equally good neighbours the first in order of id and text is taken; an empty
table gives no rows; extra columns aren't read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import small_batches

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CACHES: dict[str, "UnitEncoder"] = {}
FREQUENCY_BITS = 22
#: what fills a 64-bit word of so many bytes up with 0xFF
_PAD = np.array([(0xFFFFFFFFFFFFFFFF << (8 * n)) & 0xFFFFFFFFFFFFFFFF for n in range(9)], np.uint64)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@dataclass(frozen=True)
class PackParams:
    tokenizer: str = ""
    window: int = 2048
    end_id: int = 1
    shard_bytes: int = 8 << 20
    k1: float = 1.2
    b: float = 0.75
    #: a seed asks with its rarest so many words
    query_words: int = 64


def words_of(flat: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 and the second 8 bytes of each piece, filled up with 0xFF."""
    padded = np.concatenate([flat, np.zeros(16, np.uint8)])
    word = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))
    low, high = word[starts] | _PAD[np.minimum(size, 8)], np.full(len(starts), _PAD[0])
    second = size > 8
    high[second] = word[starts[second] + 8] | _PAD[np.minimum(size[second] - 8, 8)]
    return low, high


def term_hash(low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The place of each piece in the table of document frequencies."""
    return (tk.mix(low * tk.U64(0x9E3779B97F4A7C15) ^ high * tk.U64(0xC2B2AE3D27D4EB4F) ^ size.astype(np.uint64)) >> tk.U64(64 - FREQUENCY_BITS)).astype(np.int32)


class PieceTable:
    """Token ids of pieces, found by the pieces' own bytes for whole arrays of them at once.

    A piece of up to 16 bytes is two 64-bit words, filled up with 0xFF, which no UTF-8 text holds; an open-addressed table finds its entry.  Longer
    pieces are rare and lie in a dictionary.  Entries that were not used for longest go when there are too many.
    """

    def __init__(self, most: int = 1_000_000):
        self.most, self.epoch, self.n, self.bits = most, 0, 0, 18
        self.long: dict[bytes, int] = {}
        self.low, self.high = np.empty(1 << 16, np.uint64), np.empty(1 << 16, np.uint64)
        self.start, self.length, self.last = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int32), np.empty(1 << 16, np.int32)
        self.term = np.empty(1 << 16, np.int32)
        self.pool, self.used = np.empty(1 << 20, np.uint32), 0
        self.slots = np.full(1 << self.bits, -1, np.int32)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        h = low * tk.U64(0x9E3779B97F4A7C15) ^ high * tk.U64(0xC2B2AE3D27D4EB4F)
        return (((h ^ (h >> tk.U64(31))) * tk.U64(0xBF58476D1CE4E5B9)) >> tk.U64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Entry of each short piece, -1 if it has none."""
        found = np.full(len(low), -1, np.int32)
        slot, left = self._slot(low, high), None
        while left is None or len(left):
            entry = self.slots[slot]
            same = (entry >= 0) & (self.low[entry] == low) & (self.high[entry] == high)
            more = (entry >= 0) & ~same
            if left is None:
                found[same] = entry[same]
                left = np.flatnonzero(more)
            else:
                found[left[same]] = entry[same]
                left = left[more]
            low, high, slot = low[more], high[more], (slot[more] + 1) & ((1 << self.bits) - 1)
        return found

    def _place(self, entries: np.ndarray) -> None:
        slot = self._slot(self.low[entries], self.high[entries])
        while len(entries):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entries[free]
            lost = self.slots[slot] != entries
            entries, slot = entries[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def add(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """New entries with ``count`` ids each; the caller names those of more than 16 bytes."""
        m, long = len(count), size > 16
        while self.n + m > len(self.start):
            for name in ("low", "high", "start", "length", "last", "term"):
                setattr(self, name, np.concatenate([getattr(self, name), np.empty_like(getattr(self, name))]))
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        entries = np.arange(self.n, self.n + m, dtype=np.int32)
        self.pool[self.used : self.used + len(ids)] = ids
        self.length[entries], self.term[entries] = count, term_hash(low, high, size)
        self.start[entries] = self.used + np.cumsum(count) - count
        self.used += len(ids)
        # no short piece has two words of 0xFF
        self.low[entries], self.high[entries] = np.where(long, _PAD[0], low), np.where(long, _PAD[0], high)
        self.n += m
        if 2 * self.n > 1 << self.bits:
            self._rebuild()
        else:
            self._place(entries[~long])
        return entries

    def _rebuild(self) -> None:
        while 3 * self.n > 1 << self.bits:
            self.bits += 1
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self._place(np.flatnonzero(self.low[: self.n] != _PAD[0]).astype(np.int32))

    def trim(self) -> None:
        """Begin a shard; drop the entries that were not used for longest, if there are too many."""
        self.epoch += 1
        if self.n <= self.most:
            return
        last = self.last[: self.n]
        kept = np.flatnonzero(last >= np.partition(last, self.n - self.most // 2)[self.n - self.most // 2])
        if len(kept) > self.most:  # all of one shard
            kept = kept[: self.most // 2]
        new = np.full(self.n, -1, np.int64)
        new[kept] = np.arange(len(kept))
        length = self.length[kept].astype(np.int64)
        at = np.repeat(self.start[kept] - (np.cumsum(length) - length), length) + np.arange(length.sum())
        ids = self.pool[at]
        self.pool[: len(ids)] = ids
        self.used = len(ids)
        for name in ("low", "high", "length", "last", "term"):
            column = getattr(self, name)
            column[: len(kept)] = column[kept]
        self.start[: len(kept)] = np.cumsum(length) - length
        self.long = {k: int(new[v]) for k, v in self.long.items() if new[v] >= 0}
        self.n = len(kept)
        self._rebuild()


class UnitEncoder:
    """Encodes texts through a table of their white-space-led pieces; ids as ``tokenizers`` gives for the whole text.

    New pieces go to the tokenizer by the hundred, one after another in one string: byte-level tokens tell by their number of bytes where each piece ends.
    A tokenizer that isn't a plain byte-level one gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        before = kind.get("pre_tokenizer") or {}
        self.plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not kind.get("normalizer")
        self.size = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.size[i] = len(token)
        self.table = PieceTable()

    @classmethod
    def shared(cls, path: str) -> "UnitEncoder":
        return _CACHES.setdefault(path, cls(path)) if path not in _CACHES else _CACHES[path]

    @staticmethod
    def units(flat: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Start of every piece: each row's first byte, and each white-space run that follows a character which can't be white space."""
        blank = tk.BLANK[flat]
        cut = blank.copy()
        cut[1:] &= ~blank[:-1] & (flat[:-1] >= 0x20)
        cut[:1] = False
        # white space beyond ASCII ends in C2 xx or in E1-E3 xx xx: no cut after anything that looks like it
        at = np.flatnonzero(cut)
        if len(at):
            two, three = flat[np.maximum(at - 2, 0)], flat[np.maximum(at - 3, 0)]
            odd = (flat[at - 1] >= 0x80) & ((two == 0xC2) | (three >= 0xE1) & (three <= 0xE3))
            cut[at[odd & (at >= 2)]] = False
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        return np.flatnonzero(cut)

    def _tokens(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ids a piece) of the pieces at ``start``; those that ``joined`` marks may stand one after another, and come first."""
        encode = lambda texts: [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        n = int(joined.sum())
        end = np.cumsum(size[:n])
        data = flat[np.repeat(start[:n] - (end - size[:n]), size[:n]) + np.arange(end[-1] if n else 0)].tobytes()
        edge = [0, *end[127:-1:128].tolist(), int(end[-1])] if n else [0]
        found = encode([data[a:b].decode() for a, b in zip(edge, edge[1:])])
        ids = np.concatenate([np.zeros(0, np.uint32), *found])
        reach = np.cumsum(self.size[ids])
        cut = np.searchsorted(reach, end)
        count = np.diff(cut + 1, prepend=0)
        if n and not (cut[-1] == len(ids) - 1 and (reach[cut] == end).all()):  # some token crosses pieces after all
            ids, n = np.zeros(0, np.uint32), 0
        view = memoryview(flat)
        rest = encode([bytes(view[a : a + k]).decode() for a, k in zip(start[n:].tolist(), size[n:].tolist())])
        return np.concatenate([ids, *rest]), np.concatenate([count[:n], np.array([len(x) for x in rest], np.int64)]).astype(np.int64)

    def encode(self, flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all rows, offsets of rows in them, table entry of every piece, row of every piece)."""
        table, starts = self.table, self.units(flat, offsets)
        size = np.diff(np.append(starts, len(flat)))
        low, high = words_of(flat, starts, size)
        entry = np.full(len(starts), -1, np.int32)
        is_short = size <= 16
        if is_short.all():
            entry = table.find(low, high)
        else:
            entry[is_short] = table.find(low[is_short], high[is_short])
            view = memoryview(flat)
            long = np.flatnonzero(~is_short)
            names = [bytes(view[a : a + n]) for a, n in zip(starts[long].tolist(), size[long].tolist())]
            entry[long] = [table.long.get(x, -1) for x in names]
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            new = missing[is_short[missing]]
            order = np.lexsort((new, high[new], low[new]))
            a, b = low[new][order], high[new][order]
            head = np.ones(len(order), bool)
            head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            first = new[order[head]]
            fresh_long: dict[bytes, int] = {}
            if len(new) < len(missing):
                for k, x in zip(long.tolist(), names):
                    if entry[k] < 0:
                        fresh_long.setdefault(x, k)
            at = np.concatenate([first, np.fromiter(fresh_long.values(), np.int64, len(fresh_long))]).astype(np.int64)
            e = starts[at] + size[at]
            # as in units(): a white-space-led piece may follow one whose end can't be white space
            joined = tk.BLANK[flat[starts[at]]] & ~tk.BLANK[flat[e - 1]] & (flat[e - 1] >= 0x20)
            two, three = flat[np.maximum(e - 2, 0)], flat[np.maximum(e - 3, 0)]
            joined &= ~((flat[e - 1] >= 0x80) & ((two == 0xC2) | (three >= 0xE1) & (three <= 0xE3)))
            turn = np.argsort(~joined, kind="stable")
            ids, count = self._tokens(flat, starts[at][turn], size[at][turn], joined)
            added = np.empty(len(at), np.int32)
            added[turn] = table.add(low[at][turn], high[at][turn], size[at][turn], ids, count)
            table.long.update(zip(fresh_long, added[len(first) :].tolist()))
            entry[new[order]] = added[: len(first)][np.cumsum(head) - 1]
            if fresh_long:
                entry[long] = [table.long[x] for x in names]
        table.last[entry] = table.epoch
        rows = np.searchsorted(offsets, starts, "right") - 1
        length = table.length[entry].astype(np.int64)
        before = np.concatenate([[0], np.cumsum(length)])
        if self.plain:
            ids = table.pool[np.repeat(table.start[entry] - before[:-1], length) + np.arange(before[-1])]
            return ids, before[np.searchsorted(rows, np.arange(len(offsets)))], entry, rows
        data = flat.tobytes()
        found = [e.ids for e in self.tokenizer.encode_batch_fast([data[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:])], add_special_tokens=False)]
        return np.array([i for x in found for i in x], np.uint32), np.concatenate([[0], np.cumsum([len(x) for x in found])]), entry, rows


@dataclass(frozen=True)
class Corpus:
    """Over all documents: how many there are, how many pieces they have on average, their bytes, and how many hold a term, by the term's hash."""

    documents: int
    mean_size: float
    octets: int
    frequency: np.ndarray


class Bm25:
    """An inverted index over the pieces of one shard's documents; ``hashes`` are the pieces' terms in the corpus."""

    def __init__(self, terms: np.ndarray, hashes: np.ndarray, docs: np.ndarray, n_docs: int, p: PackParams, corpus: Corpus):
        code, first = pd.factorize(terms)
        key = np.sort((code.astype(np.int64) << 32) | docs)
        at = np.flatnonzero(np.concatenate([np.ones(min(len(key), 1), bool), key[1:] != key[:-1]]))
        key, tf = key[at], np.diff(np.append(at, len(key)))
        term, doc = key >> 32, key & 0xFFFFFFFF
        here = np.bincount(term, minlength=len(first))
        hashed = np.empty(len(first), np.int64)
        hashed[code] = hashes
        df = corpus.frequency[hashed].astype(np.int64)
        size = np.bincount(docs, minlength=n_docs)
        keep = here[term] > 1  # a term of one document here leads to no other
        term, doc, tf = term[keep], doc[keep], tf[keep]
        idf = np.log(1 + (corpus.documents - df + 0.5) / (df + 0.5))
        norm = p.k1 * (1 - p.b + p.b * size / max(corpus.mean_size, 1))
        self.weight = idf[term] * tf * (p.k1 + 1) / (tf + norm[doc])
        self.doc, self.first = doc, np.searchsorted(term, np.arange(len(first) + 1))
        order = np.lexsort((term, -idf[term], doc))
        self.by_doc, self.doc_cut = term[order], np.searchsorted(doc[order], np.arange(n_docs + 1))
        self.n, self.words = n_docs, p.query_words

    def scores(self, seed: int) -> np.ndarray:
        terms = self.by_doc[self.doc_cut[seed] : self.doc_cut[seed + 1]][: self.words]
        at = np.concatenate([np.arange(self.first[t], self.first[t + 1]) for t in terms]) if len(terms) else np.zeros(0, np.int64)
        return np.bincount(self.doc[at], weights=self.weight[at], minlength=self.n)


def pack_shard(lengths: np.ndarray, index: Bm25, window: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece, documents in the order in which retrieval takes them."""
    n = len(lengths)
    unused, next_seed, out = np.ones(n, bool), 0, []
    sequence, room, seed, ranked, at = 0, window, -1, None, 0
    for _ in range(n):
        pick = -1
        if seed >= 0 and room < window:
            if ranked is None:
                s = index.scores(seed)
                found = np.flatnonzero((s > 0) & unused)
                ranked, at = found[np.lexsort((found, -s[found]))], 0
            while at < len(ranked) and not unused[ranked[at]]:
                at += 1
            if at < len(ranked):
                pick = int(ranked[at])
        if pick < 0:
            while not unused[next_seed]:
                next_seed += 1
            pick = next_seed
        if room == window:
            seed, ranked = pick, None
        unused[pick] = False
        start = 0
        while start < lengths[pick]:
            take = min(room, int(lengths[pick]) - start)
            out.append((pick, start, take, sequence, window - room))
            start += take
            room -= take
            if not room:
                sequence, room = sequence + 1, window
            if start < lengths[pick] and room == window:
                seed, ranked = pick, None
        # a document whose rest opened this window stays its seed
    return out


def count_corpus(base: DataFrame) -> Corpus:
    """One pass over the texts: every task counts its documents' terms, ranges of hashes are added up, and their sums come to the driver (8 bytes a hash)."""
    width, parts = 1 << FREQUENCY_BITS - 6, 64

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, documents, pieces, octets = np.zeros(width * parts, np.int64), 0, 0, 0
        held: list[np.ndarray] = []

        def add() -> None:
            found[:] += np.bincount(np.concatenate(held), minlength=width * parts)
            held.clear()

        for batch in batches:
            for first, end, flat, offsets in tk.chunks(batch.column(0)):
                starts = UnitEncoder.units(flat, offsets)
                size = np.diff(np.append(starts, len(flat)))
                h = term_hash(*words_of(flat, starts, size), size)
                key = np.sort(((np.searchsorted(offsets, starts, "right") - 1) << FREQUENCY_BITS) | h)
                new = np.ones(len(key), bool)
                new[1:] = key[1:] != key[:-1]
                held.append(key[new] & (width * parts - 1))
                documents, pieces, octets = documents + end - first, pieces + len(starts), octets + len(flat)
                if sum(map(len, held)) > width * parts // 2:
                    add()
        if held:
            add()
        if not documents:
            return
        own = [np.flatnonzero(found[k : k + width]) for k in range(0, width * parts, width)]
        blobs = [x.astype(np.uint16).tobytes() + found[k * width + x].astype(np.uint32).tobytes() for k, x in enumerate(own)]
        yield pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array(blobs, pa.binary()), *(pa.array([x] * parts, pa.int64()) for x in (documents, pieces, octets))], names=["part", "blob", "documents", "pieces", "octets"])
        tk.give_back()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for part, blob, *totals in zip(*(c.to_pylist() for c in batch.columns)):
                own, n = sums.setdefault(part, (np.zeros(width, np.int64), np.zeros(3, np.int64))), len(blob) // 6
                own[0][np.frombuffer(blob, np.uint16, n)] += np.frombuffer(blob, np.uint32, n, 2 * n)
                own[1][:] += totals
        for part, (n, totals) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n.tobytes()], pa.binary()), *(pa.array([int(x)]) for x in totals)], names=["part", "blob", "documents", "pieces", "octets"])

    schema = "part int, blob binary, documents long, pieces long, octets long"
    rows = base.select("text").mapInArrow(count, schema).repartition(min(parts, 16), "part").mapInArrow(total, schema).toArrow().to_pylist()
    frequency = np.zeros(width * parts, np.int64)
    for r in rows:
        frequency[r["part"] * width : (r["part"] + 1) * width] = np.frombuffer(r["blob"], np.int64)
    documents, pieces, octets = (rows[0][x] for x in ("documents", "pieces", "octets")) if rows else (0, 0, 0)
    return Corpus(documents, pieces / max(documents, 1), octets, frequency.astype(np.uint32 if documents < 1 << 32 else np.int64))


def pack(docs: DataFrame, params: PackParams = PackParams()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    p, path = params, params.tokenizer or default_tokenizer()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    small_batches(docs.sparkSession)
    corpus = count_corpus(base)
    shards = max(1, -(-corpus.octets // p.shard_bytes))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)))
    tasks = min(shards, 50_000)
    dealt = dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "doc_id", "text")
    shared = docs.sparkSession.sparkContext.broadcast(corpus)

    def finish(shard: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        encoder = UnitEncoder.shared(path)
        encoder.table.trim()
        ids, cuts, terms, owners, rows = [], [np.zeros(1, np.int64)], [], [], 0
        held = shared.value
        for part in parts:
            for first, end, flat, offsets in tk.chunks(part.column(1)):
                i, cut, h, own = encoder.encode(flat, offsets)
                ends = cut[1:]
                ids.append(np.insert(i, ends, p.end_id))
                cuts.append(cuts[-1][-1] + ends + np.arange(1, end - first + 1))
                terms.append(h)
                owners.append(own + rows)
                rows += end - first
        flat_ids, cut = np.concatenate(ids).astype("<u4"), np.concatenate(cuts)
        term = np.concatenate(terms)
        index = Bm25(term, encoder.table.term[term], np.concatenate(owners), rows, p, held)
        lengths = np.diff(cut)
        out = pack_shard(lengths, index, p.window)
        doc, start, length, seq, off = (np.array(x, np.int64) for x in zip(*out))
        crc = [zlib.crc32(flat_ids[a : a + b]) for a, b in zip((cut[doc] + start).tolist(), length.tolist())]
        own = pa.concat_arrays([x.column(0) for x in parts]).take(pa.array(doc))
        return pa.RecordBatch.from_arrays(
            [own, pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(lengths[doc]), pa.array((shard << 32) + seq), pa.array(off)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            shard = batch.column(2).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(shard[1:] != shard[:-1]) + 1, [len(shard)]])
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                if now is not None and shard[a] != now:
                    yield finish(now, parts)
                    parts = []
                now = int(shard[a])
                parts.append(batch.slice(a, b - a))
        if parts:
            yield finish(now, parts)
        parts.clear()
        tk.give_back()

    return dealt.mapInArrow(run, SCHEMA)
