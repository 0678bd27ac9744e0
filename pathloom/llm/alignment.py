"""Cross-tokenizer alignment: how the tokens of two tokenizers cover each other in every text.

A is a byte-level BPE over a blank and the text, B a sentencepiece BPE over the text, which adds that blank itself.  Where the white space after a word begins, neither can merge across: no
token of A and no piece of B holds white space after anything else (the vocabularies are read and checked; where one does, a text is one segment), and A's pattern always starts
anew there.  So a text falls into segments, most of them a blank and a word, whose tokens are the text's.

1. ``blocks``: texts are cut into segments, and every run of rows of about ``block_bytes`` becomes one written row with its distinct segments and the texts as codes of them.
2. ``segments``: the blocks' distinct segments, summed over all blocks, are tokenised and aligned once each; many are joined to one text for that, which the same argument allows.
3. ``pairs``: how many links of the corpus hold an A id and a B id linked: the links of each segment times its occurrences.
4. Each segment's own sums go back to the blocks that hold it, by a join on the segment, and a block's texts are composed from its segments in one task.

A segment whose tokens don't give back its bytes leaves its texts without tokens.  Those texts are set aside in their blocks before anything is counted.

Bounds: a task holds one block, its distinct segments and their alignments.  The pairs are broadcast if there are at most ``broadcast_pairs`` (17 bytes each), else joined.

Rows: null and empty texts, and texts whose tokens don't give back their bytes, have zeros and no groups; null ids and repeated rows are rows like any others; a text longer than a block is
a block, one without white space is one segment; other columns aren't read; no documents give no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import Scratch, release, small_batches

#: white space that may start a segment if something else is before it
_STARTS = " \n\t\r"
#: after these bytes nothing is cut: other white space, and the last bytes of characters that some pattern might take for white space
_NO_CUT_AFTER = np.zeros(256, bool)
_NO_CUT_AFTER[[0x00, *range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WIDE_BLANK = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f\u2060\u2581\u3000\ufeff]")
#: goes before joined segments, so that B's own blank is no part of any
_FILLER = " a"


@dataclass(frozen=True)
class AlignParams:
    byte_level: str = ""
    pieces: str = ""
    block_bytes: int = 32 << 20
    broadcast_pairs: int = 4_000_000
    #: bytes of segments that are tokenised at once
    joined_bytes: int = 1 << 18


class Tokenizers:
    """Both tokenizers of a worker, with the bytes of their tokens."""

    def __init__(self, byte_level: str, pieces: str):
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        path = byte_level or public_tokenizers.path("byte_bpe_50k.json")
        self.a = Tokenizer.from_file(path)
        self.a.encode_special_tokens = True
        # byte-level vocabularies write printable bytes as themselves and the others, in order, as characters from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(plain)))}
        self.a_bytes: list[bytes] = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, k in self.a.get_vocab().items():
            self.a_bytes[k] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces or public_tokenizers.path("piece_bpe_32k.model"))
        self.b_bytes = [
            bytes([int(self.b.id_to_piece(k)[3:5], 16)]) if self.b.is_byte(k) else self.b.id_to_piece(k).replace("▁", " ").encode() for k in range(self.b.get_piece_size())
        ]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        self.starts = self._starts(path)

    @property
    def separable(self) -> bool:
        return " " in self.starts

    def _starts(self, path: str) -> str:
        """The white space that no token of either holds after something else, so that neither merges across its beginning."""
        with open(path, encoding="utf-8") as f:
            own = json.load(f)
        cuts = own["pre_tokenizer"] or {}
        if own["normalizer"] or cuts.get("type") != "ByteLevel" or not cuts.get("use_regex", True) or cuts.get("add_prefix_space"):
            return ""
        special = {x["id"] for x in own["added_tokens"]}
        tokens = [x.decode("utf-8", "replace") for k, x in enumerate(self.a_bytes) if k not in special] + [x.decode("utf-8", "replace") for x in self.b_bytes]
        within = {c for x in tokens for before, c in zip(x, x[1:]) if c in _STARTS and not (ord(before) < 256 and _NO_CUT_AFTER[ord(before)] or _WIDE_BLANK.fullmatch(before))}
        return "".join(c for c in _STARTS if c not in within)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text that starts with a blank."""
        return np.array(self.a.encode(text, add_special_tokens=False).ids, np.int64), np.array(self.b.encode(text[1:]), np.int64)


@lru_cache(maxsize=2)
def tokenizers(byte_level: str = "", pieces: str = "") -> Tokenizers:
    return Tokenizers(byte_level, pieces)


# ---- segments ------------------------------------------------------------------------------------------------------------


def cut(flat: np.ndarray, offsets: np.ndarray, begins: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a blank before every text that isn't empty, segments' offsets in them, number of segments of each text); a segment starts with one of ``begins``."""
    size = np.diff(offsets)
    full = size > 0
    # where each text starts once every text before it has its blank
    begin = offsets[:-1] + np.concatenate([[0], np.cumsum(full)[:-1]]) if len(size) else offsets[:0]
    out = np.full(len(flat) + int(full.sum()), 0x20, np.uint8)
    place = np.arange(len(flat)) + np.repeat(np.cumsum(full), size)
    out[place] = flat
    starts = np.zeros(len(out) + 1, bool)
    if begins and len(out):
        blank = np.isin(out, np.frombuffer(begins.encode(), np.uint8))
        free = ~_NO_CUT_AFTER[out]
        # characters that may count as white space are rare: the places after them are taken back one by one
        if len(wide := np.flatnonzero((out == 0xC2) | (out == 0xE1) | (out == 0xE2) | (out == 0xE3) | (out == 0xEF))):
            length = np.where(out[wide] == 0xC2, 2, 3)
            inside = wide + length <= len(out)
            wide, length = wide[inside], length[inside]
            for n in (2, 3):
                own = wide[length == n]
                chars = np.stack([out[own + k] for k in range(n)], 1) if len(own) else np.zeros((0, n), np.uint8)
                kinds, back = np.unique(chars, axis=0, return_inverse=True) if len(own) else (chars, np.zeros(0, np.int64))
                bad = np.array([bool(_WIDE_BLANK.fullmatch(bytes(x).decode("utf-8", "replace"))) for x in kinds], bool)
                if len(own):
                    free[own[bad[back.reshape(-1)]] + n - 1] = False
        starts[1:-1] = blank[1:] & free[:-1]
    starts[begin[full]] = True
    starts[-1] = True
    where = np.flatnonzero(starts)
    number = np.zeros(len(size), np.int64)
    number[full] = np.diff(np.append(np.searchsorted(where, begin[full]), len(where) - 1)) if full.any() else 0
    return out, where, number


def _packed(codes: np.ndarray) -> bytes:
    """Codes in compressed planes of their bytes, since high bytes are mostly zeros."""
    return pa.compress(np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<i4").reshape(-1)


def blocks(docs: DataFrame, p: AlignParams, key: str, text: str) -> DataFrame:
    """One row for each run of rows: (block, keys, lengths, codes, segment, n): the texts' numbers of segments, their segments as codes, and the distinct segments with their occurrences."""
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    kind = base.schema["key"].dataType.simpleString()
    width = 1 << 33

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, number = TaskContext.get().partitionId(), 0
        starts = tokenizers(p.byte_level, p.pieces).starts
        held: list[tuple[pa.Array, np.ndarray, pa.DictionaryArray]] = []
        size = 0

        def send() -> pa.RecordBatch:
            nonlocal number
            keys = pa.concat_arrays([k for k, _, _ in held])
            lengths = np.concatenate([n for _, n, _ in held])
            own = pa.chunked_array([c for _, _, c in held]).unify_dictionaries().combine_chunks()
            own = own if isinstance(own, pa.DictionaryArray) else own.chunk(0)
            codes = own.indices.to_numpy(zero_copy_only=False).astype(np.int32)
            words = own.dictionary.cast(pa.string())
            n = np.bincount(codes, minlength=len(words)).astype(np.int64)
            number += 1
            one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
            return pa.RecordBatch.from_arrays(
                [pa.array([at * width + number]), one(keys), one(pa.array(lengths.astype(np.int32))), pa.array([_packed(codes)], pa.binary()), one(words), one(pa.array(n))],
                names=["block", "keys", "lengths", "codes", "segment", "n"],
            )

        for batch in batches:
            for first, end, flat, offsets in tk.chunks(batch.column(1), 4 << 20):
                data, where, lengths = cut(flat, offsets, starts)
                own = pa.LargeStringArray.from_buffers(len(where) - 1, pa.py_buffer(where.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
                held.append((batch.column(0).slice(first, end - first), lengths, own))
                size += len(flat)
                if size >= p.block_bytes:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()
        tk.give_back()

    return base.mapInArrow(run, f"block long, keys array<{kind}>, lengths array<int>, codes binary, segment array<string>, n array<long>")


# ---- alignment -----------------------------------------------------------------------------------------------------------


def _align(words: list[str], t: Tokenizers) -> list[tuple] | None:
    """(groups, links) of segments that are tokenised as one text; None if that text's bytes don't come back."""
    lead = _FILLER if t.separable else ""
    text = lead + "".join(words)
    data = text.encode()
    a, b = t.encode(text)
    if b"".join([t.a_bytes[k] for k in a.tolist()]) != data or b"".join([t.b_bytes[k] for k in b.tolist()]) != data:
        return None
    end_a, end_b = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    border = np.cumsum([len(lead), *(len(w.encode()) for w in words)])
    common = np.intersect1d(end_a, end_b, assume_unique=True)
    steps = np.union1d(end_a, end_b)
    if not np.isin(border[border > 0], common).all():
        raise RuntimeError("a token reaches across a segment's border")
    # links: between two cuts next to each other lies one A and one B token, and no other place has both
    links = (a[np.searchsorted(end_a, steps)] << 32) | b[np.searchsorted(end_b, steps)]
    at_group, at_link = (np.searchsorted(x, border, "right") for x in (common, steps))
    to_a, to_b = (np.searchsorted(x, common, "right").tolist() for x in (end_a, end_b))
    text_a, text_b = [str(k) for k in a.tolist()], [str(k) for k in b.tolist()]
    groups, x, y = [], 0, 0
    for i, j in zip(to_a, to_b):
        groups.append((text_a[x] if i == x + 1 else ",".join(text_a[x:i])) + "|" + (text_b[y] if j == y + 1 else ",".join(text_b[y:j])))
        x, y = i, j
    return [(";".join(groups[at_group[k] : at_group[k + 1]]), links[at_link[k] : at_link[k + 1]]) for k in range(len(words))]


def align_segments(words: list[str], t: Tokenizers, most: int) -> list[tuple]:
    """The alignment of each segment; a segment whose bytes don't come back has no tokens (null groups, no links)."""
    out: list[tuple] = [()] * len(words)

    def solve(own: list[int]) -> None:
        found = _align([words[k] for k in own], t)
        if found is not None:
            for k, x in zip(own, found):
                out[k] = x
        elif len(own) == 1:
            out[own[0]] = (None, np.zeros(0, np.int64))
        else:
            solve(own[: len(own) // 2])
            solve(own[len(own) // 2 :])

    own, size = [], 0
    for k, w in enumerate(words):
        if not t.separable or ord(w[-1]) < 0x21 or _WIDE_BLANK.fullmatch(w[-1]):
            solve([k])  # white space at its end would be one run with that of the next
            continue
        own.append(k)
        size += len(w)
        if size >= most:
            solve(own)
            own, size = [], 0
    if own:
        solve(own)
    return out


def aligned(segments: DataFrame, p: AlignParams) -> DataFrame:
    """(segment, n, groups, links) of distinct segments (segment, n)."""
    schema = "segment string, n long, groups string, links binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(p.byte_level, p.pieces)
        for batch in batches:
            found = align_segments(batch.column(0).to_pylist(), t, p.joined_bytes)
            groups, links = pa.array([x[0] for x in found], pa.string()), pa.array([x[1].astype("<i8").tobytes() for x in found], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), groups, links], names=["segment", "n", "groups", "links"])
            del found, groups, links
            tk.give_back()

    return segments.select("segment", "n").mapInArrow(run, schema)


def pair_counts(segments: DataFrame) -> DataFrame:
    """(pair, n, best): links of the corpus for each A id (high half) and B id (low half), and whether no other A id has more links with that B id; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            key, back = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, back, np.concatenate([n for _, n in held]))
            return key, total

        for batch in batches:
            n = batch.column(0).to_numpy(zero_copy_only=False)
            links = batch.column(1).to_pylist()
            held.append((np.frombuffer(b"".join(links), "<i8"), np.repeat(n, [len(x) // 8 for x in links])))
            del links
            if sum(len(k) for k, _ in held) > 1_000_000:
                held = [summed()]
                tk.give_back()
                if len(held[0][0]) > 500_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held.pop()], names=["pair", "n"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in summed()], names=["pair", "n"])

    found = segments.where("n > 0").select("n", "links").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    own = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    return found.select("pair", "n", (F.col("n") == F.max("n").over(own)).alias("best"))


def segment_sums(segments: DataFrame, pairs: DataFrame, p: AlignParams) -> DataFrame:
    """(segment, groups, n_best, count_sum): the other sums of a segment are counted in its groups."""
    keep = ["segment", "groups"]
    if pairs.count() > p.broadcast_pairs:
        def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                links = batch.column(1).to_pylist()
                owner = np.repeat(np.arange(len(links)), [len(x) // 8 for x in links])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(np.frombuffer(b"".join(links), "<i8"))], names=["segment", "pair"])

        link = segments.select("segment", "links").mapInArrow(exploded, "segment string, pair long").join(pairs, "pair")
        sums = link.groupBy("segment").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("n").alias("count_sum"))
        return segments.select(*keep).join(sums, "segment", "left").fillna(0, ["n_best", "count_sum"])
    table = pairs.orderBy("pair").toArrow()
    known = segments.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))
    schema = "segment string, groups string, n_best long, count_sum long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n, best = known.value
        for batch in batches:
            links = batch.column(2).to_pylist()
            flat = np.frombuffer(b"".join(links), "<i8")
            edge = np.cumsum([0, *(len(x) // 8 for x in links)])
            sums = []
            for values in (best.astype(np.int64), n):
                run_ = np.zeros(len(flat) + 1, np.int64)
                if len(pair):  # links of segments that only texts without tokens hold aren't counted
                    at = np.minimum(np.searchsorted(pair, flat), len(pair) - 1)
                    np.cumsum(np.where(pair[at] == flat, values[at], 0), out=run_[1:])
                sums.append(pa.array(np.diff(run_[edge])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *sums], names=[*keep, "n_best", "count_sum"])

    return segments.select(*keep, "links").mapInArrow(run, schema)


# ---- composition ---------------------------------------------------------------------------------------------------------


def _numbered(table: DataFrame) -> DataFrame:
    """(of, code, segment, n) of the distinct segments of each block ``of``."""
    return table.select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("segment", "n")).alias("code", "e")).select("of", "code", "e.segment", "e.n")


def _set_aside(table: DataFrame, lost: DataFrame) -> DataFrame:
    """The blocks with the texts that hold any of the ``lost`` (of, code) segments taken out of the occurrences; their lengths become negative."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for row in left.to_pylist():
            lengths, codes = np.array(row["lengths"], np.int64), _unpacked(row["codes"], sum(row["lengths"]))
            owner = np.repeat(np.arange(len(lengths)), lengths)
            bad = np.zeros(len(lengths), bool)
            bad[owner[np.isin(codes, right.column("code").to_numpy())]] = True
            n = np.bincount(codes[~bad[owner]], minlength=len(row["segment"])).astype(np.int64)
            out.append(row | {"lengths": np.where(bad, -lengths, lengths).tolist(), "n": n.tolist()})
        return pa.Table.from_pylist(out, left.schema)

    return table.groupBy("block").cogroup(lost.groupBy("of")).applyInArrow(run, table.schema)


def _counted(groups: pa.Array) -> dict[str, np.ndarray]:
    """n_a, n_b, n_groups and n_links of groups that all end with a semicolon."""
    flat, at = tk.text_buffer(groups)
    bar, end, comma = (np.flatnonzero(flat == ord(c)) for c in "|;,")  # arrays as long as there are tokens, not bytes
    in_b = np.searchsorted(bar, comma) > np.searchsorted(end, comma)
    total = lambda places: np.diff(np.searchsorted(places, at))
    n_groups = total(bar)
    n_a, n_b = n_groups + total(comma[~in_b]), n_groups + total(comma[in_b])
    return {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_a + n_b - n_groups}


def _composed(table: DataFrame, sums: DataFrame, digest: bool) -> DataFrame:
    """A row for each text, from its block's codes and the block's (of, code, ...) rows."""
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    last = "groups_sha256" if digest else "groups"
    kind = table.schema["keys"].dataType.elementType.simpleString()
    schema = f"key {kind}, {', '.join(f'{n} long' for n in names)}, {last} string"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        order = np.argsort(right.column("code").to_numpy())
        # a segment's groups with a semicolon after them: those of segments that follow each other are then one run of bytes
        groups = pc.fill_null(right.column("groups").combine_chunks().cast(pa.large_string()).take(pa.array(order)), "|")
        groups = pc.binary_join_element_wise(groups, pa.scalar("", pa.large_string()), pa.scalar(";", pa.large_string()))
        values = _counted(groups) | {n: right.column(n).to_numpy()[order].astype(np.int64) for n in names[4:]}
        for k in range(left.num_rows):
            keys = left.column("keys")[k].values
            lengths = left.column("lengths")[k].values.to_numpy()
            size, good = np.abs(lengths), lengths > 0
            some = np.flatnonzero(size)
            codes = _unpacked(left.column("codes")[k].as_py(), int(size.sum()))
            edge = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
            columns = []
            for n in names:
                sums = np.zeros(len(size), np.int64)
                if len(some):
                    sums[some] = np.add.reduceat(values[n][codes], edge[some])
                sums[~good] = 0
                columns.append(pa.array(sums))
            text = []
            for first in range(0, len(size), 256):  # the texts of some rows at once, so that the strings stay few
                end = min(first + 256, len(size))
                own = groups.take(pa.array(codes[edge[first] : edge[end]]))
                data, at = tk.text_buffer(own)
                at = at[edge[first : end + 1] - edge[first]]
                for j in range(first, end):
                    x = data[at[j - first] : max(at[j - first], at[j - first + 1] - 1)]
                    text.append("" if not good[j] else hashlib.sha256(x).hexdigest() if digest else x.tobytes().decode())
            parts.append(pa.table([keys, *columns, pa.array(text, pa.string())], names=["key", *names, last]))
        del groups, values
        tk.give_back()
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in empty], names=["key", *names, last])

    from pyspark.sql.pandas.types import to_arrow_type

    empty = [to_arrow_type(table.schema["keys"].dataType.elementType), *[pa.int64()] * len(names), pa.string()]
    return table.select("block", "keys", "lengths", "codes").groupBy("block").cogroup(sums.groupBy("of")).applyInArrow(run, schema)


def align(docs: DataFrame, params: AlignParams = AlignParams(), key: str = "doc_id", text: str = "text", digest: bool = False) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row: ``groups`` has the A and B ids of each group, ``a1,a2|b1;a3|b2``; with ``digest`` its SHA-256."""
    p, spark = params, docs.sparkSession
    scratch = Scratch(spark, "alignment")
    table = scratch.table(blocks(docs, p, key, text), "blocks")
    own = _numbered(table).groupBy("segment").agg(F.sum("n").alias("n"))
    found = scratch.table(aligned(own, p), "segments")
    if not (lost := found.where(F.col("groups").isNull()).select("segment")).isEmpty():
        held = _numbered(table).select("of", "code", "segment").join(lost, "segment", "left_semi").select("of", "code")
        table = scratch.table(_set_aside(table, held), "blocks-left")
        scratch.drop("blocks")
        n = _numbered(table).groupBy("segment").agg(F.sum("n").alias("n"))
        found = scratch.table(found.drop("n").join(n, "segment"), "segments-left")
        scratch.drop("segments")
    release(spark)
    pairs = scratch.table(pair_counts(found), "pairs")
    sums = scratch.table(segment_sums(found, pairs, p), "sums")
    scratch.drop("segments", "segments-left", "pairs")
    release(spark)
    back = _numbered(table).select("of", "code", "segment").join(sums, "segment").drop("segment")
    return _composed(table, back, digest).withColumnRenamed("key", key)


def query(docs: DataFrame, params: AlignParams = AlignParams()) -> DataFrame:
    """doc_id, the sums and the digest of the groups."""
    return align(docs, params, digest=True)
