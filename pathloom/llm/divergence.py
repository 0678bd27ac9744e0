"""Source divergence audit: how far each source's word use lies from the other sources of its language, and by which terms.

A term counts where at least ``min_docs`` documents of its language hold it, which few of all distinct terms do.  So document frequencies are sketched first: every task adds
its documents' distinct terms to a count-min sketch, the sketches are summed cell by cell, and a term one of whose cells stays below ``min_docs`` is impossible, since cells never
underestimate.  Impossible terms are discarded before anything is shuffled; the survivors are counted exactly, by whole terms, and those below ``min_docs`` go then.

Shares are integers: ``p = 1 + floor(SCALE * (count + 5) / (N + 5 V))``.  A term that a group lacks has the group's least share, so the sum of differences of two groups over all terms
is that of two constant vectors, corrected for the terms that one or both hold.  Terms that both hold are met by a join on the term, whose pairs are summed by sources in the
same stage; terms of one side only need the group's shares sorted once, with the other groups' least shares among them.

The sketch has a cell for every ``bytes_per_cell`` bytes of text, up to ``most_cells``, which bounds what is broadcast (a bit for each cell).  Beyond that it discards less; results
are the same.  Tables whose rows are a term and a group are cut by hash of both, so no task holds a whole term's or a whole group's unless it is sorted there.

Rows: null text, lang and source are ''; an empty text has no terms, its group is there; every row is a document, repeated ones and those of one id too; texts are read whole; ties of
value go by the item's bytes; other columns aren't read; no documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import Scratch, release, small_batches

#: separators of terms: ASCII characters that are no letters
NOT_LETTER = np.ones(256, bool)
NOT_LETTER[128:] = NOT_LETTER[65:91] = NOT_LETTER[97:123] = False
#: fixed values of the shares
SCALE, SMOOTH = 1_000_000_000, 5
#: cells of a block of the sketch
BLOCK = 1 << 14


@dataclass(frozen=True)
class DivergenceParams:
    min_docs: int = 30
    top: int = 50
    rows: int = 2
    bytes_per_cell: int = 64
    least_cells: int = 1 << 16
    most_cells: int = 1 << 28
    #: rows that a task gathers before it sums and sends them
    held_rows: int = 300_000


def terms(flat: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, code of each occurrence, its row), with A-Z lower-cased."""
    starts, ends, rows = tk.word_spans(flat, offsets, NOT_LETTER)
    data = tk.LOWER[flat[~NOT_LETTER[flat]]]
    cut = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=cut[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(cut), pa.py_buffer(data)).dictionary_encode()
    return words.dictionary, words.indices.to_numpy(zero_copy_only=False).astype(np.int64), rows


def _groups(batch: pa.RecordBatch, names: list[str]) -> tuple[np.ndarray, pa.Table]:
    """Number of each row's group by ``names``, and the groups."""
    key = pa.table({n: batch.column(n) for n in names})
    found = key.group_by(names).aggregate([])
    at = {tuple(r): k for k, r in enumerate(zip(*(found.column(n).to_pylist() for n in names)))}
    return np.array([at[r] for r in zip(*(batch.column(n).to_pylist() for n in names))], np.int64), found


def _cells(words: pa.Array, lang: np.ndarray, langs: pa.Table, codes: np.ndarray, p: DivergenceParams, cells: int) -> list[np.ndarray]:
    """The cell of each (language number, term code) in every row of the sketch."""
    flat, cut = tk.text_buffer(words)
    h = tk.span_hash(tk.prefix_hash(flat), cut[:-1], cut[1:])
    flat, cut = tk.text_buffer(langs.column("lang").combine_chunks())
    own = tk.span_hash(tk.prefix_hash(flat), cut[:-1], cut[1:])
    both = tk.mix(h[codes] * tk.U64(0xD6E8FEB86659FD93) + own[lang])
    return [(tk.mix(both + tk.U64((k + 1) * tk.BASE % (1 << 64))) & tk.U64(cells - 1)).astype(np.int64) + k * cells for k in range(p.rows)]


def _document_terms(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of rows: groups, distinct terms, and for each (group, term) there the group, the term's code, its documents and its occurrences."""
    group, found = _groups(batch, names)
    for first, end, flat, offsets in tk.chunks(batch.column("text"), 4 << 20):
        words, codes, rows = terms(flat, offsets)
        if not len(codes):
            continue
        width = len(words)
        pair, count = np.unique(rows * width + codes, return_counts=True)
        key = group[first:end][pair // width] * width + pair % width
        key, back, docs = np.unique(key, return_inverse=True, return_counts=True)
        yield found, words, key // width, key % width, docs, np.bincount(back, weights=count).astype(np.int64)


def sketch(docs: DataFrame, p: DivergenceParams, cells: int) -> DataFrame:
    """(block, cells): the summed sketch, a byte for each cell that says min(documents, min_docs)."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, much, held = [], [], 0

        def send() -> Iterator[pa.RecordBatch]:
            every, own = np.concatenate(where), np.concatenate(much)
            order = np.argsort(every, kind="stable")
            every, own = every[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            cell, n = every[first].astype(np.int64), np.minimum(np.add.reduceat(own, first), p.min_docs).astype(np.uint8)
            cut = np.searchsorted(cell, np.arange(int(cell[0]) // BLOCK, int(cell[-1]) // BLOCK + 2) * BLOCK)
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:]), int(cell[0]) // BLOCK):
                if a < b:  # places and counts of the cells that aren't zero
                    yield k, (cell[a:b] - k * BLOCK).astype("<u2").tobytes(), n[a:b].tobytes()

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["block", "places", "counts"])

        for batch in batches:
            for langs, words, lang, code, own, _ in _document_terms(batch, ["lang"]):
                for cell in _cells(words, lang, langs, code, p, cells):
                    where.append(cell.astype(np.int32))
                    much.append(np.minimum(own, p.min_docs).astype(np.int32))
                    held += len(cell)
                if held > 8 * p.held_rows:
                    yield batch_of(list(send()))
                    where, much, held = [], [], 0
            tk.give_back()
        if held:
            yield batch_of(list(send()))
        tk.give_back()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, places, counts in zip(*(c.to_pylist() for c in batch.columns)):
                own = total.setdefault(k, np.zeros(BLOCK, np.uint8))
                at = np.frombuffer(places, "<u2")
                own[at] = np.minimum(own[at] + np.frombuffer(counts, np.uint8).astype(np.int64), p.min_docs)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "cells"])

    found = docs.select("lang", "text").mapInArrow(add, "block long, places binary, counts binary")
    return found.repartition(max(1, min(512, p.rows * cells // BLOCK)), "block").mapInArrow(merge, "block long, cells binary")


def possible_cells(merged: DataFrame, p: DivergenceParams, cells: int) -> np.ndarray:
    """A bit for each cell: whether it reaches ``min_docs``; ``rows * cells`` bits, which ``most_cells`` bounds."""
    bits = np.zeros(p.rows * cells // 8, np.uint8)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.packbits(np.frombuffer(x, np.uint8) >= p.min_docs).tobytes() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.binary())], names=["block", "cells"])

    for k, own in zip(*(c.to_pylist() for c in merged.mapInArrow(pack, "block long, cells binary").toArrow().columns)):
        bits[k * BLOCK // 8 : (k + 1) * BLOCK // 8] = np.frombuffer(own, np.uint8)
    return bits


def counts(docs: DataFrame, p: DivergenceParams, cells: int, bits: np.ndarray) -> DataFrame:
    """(lang, source, term, n_docs, n) of every term whose cells all reach ``min_docs``, summed by each task."""
    possible = docs.sparkSession.sparkContext.broadcast(bits)
    names = ["lang", "source", "term", "n_docs", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        table = possible.value

        def summed(parts: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(parts).group_by(names[:3], use_threads=False).aggregate([("n_docs", "sum"), ("n", "sum")]).rename_columns(names)

        def send(own: pa.Table) -> Iterator[pa.RecordBatch]:
            yield from own.select(names).combine_chunks().to_batches(max_chunksize=200_000)

        for batch in batches:
            for groups, words, group, code, own, n in _document_terms(batch, ["lang", "source"]):
                keep = np.ones(len(group), bool)
                for cell in _cells(words, group, groups, code, p, cells):
                    keep &= (table[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
                g, c = pa.array(group[keep]), pa.array(code[keep])
                held.append(pa.table([groups.column("lang").combine_chunks().take(g), groups.column("source").combine_chunks().take(g), words.take(c).cast(pa.string()), pa.array(own[keep]), pa.array(n[keep])], names=names))
            if sum(x.num_rows for x in held) > p.held_rows:
                held = [summed(held)]
                if held[0].num_rows > p.held_rows // 2:
                    yield from send(held.pop())
            tk.give_back()
        if held:
            yield from send(summed(held))
        tk.give_back()

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n_docs long, n long")


def _share(n: str, total: str, terms_: str):
    """The integer share of a count, in decimals: a long can't hold the product at any size."""
    return F.expr(f"1 + ({SCALE}BD * (cast({n} as decimal(20,0)) + {SMOOTH})) div (cast({total} as decimal(20,0)) + {SMOOTH}BD * cast({terms_} as decimal(18,0)))")


def kept_counts(docs: DataFrame, p: DivergenceParams, scratch: Scratch) -> DataFrame:
    """(lang, source, term, n, lang_n, is_first) of every term in at least ``min_docs`` documents of its language; lang_n is its count there, and is_first marks one row of each term."""
    text_bytes = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    cells = p.least_cells
    while cells < p.most_cells and cells * p.bytes_per_cell < text_bytes:
        cells *= 2
    bits = possible_cells(sketch(docs, p, cells), p, cells)
    # first by group and term, so that a frequent term's rows of all tasks are summed in as many places as it has sources; then by term
    summed = counts(docs, p, cells, bits).groupBy("lang", "source", "term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n"))
    term = Window.partitionBy("lang", "term")
    every = summed.select(
        "lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("n_docs").over(term).alias("lang_docs"), (F.col("source") == F.min("source").over(term)).alias("is_first")
    )
    return scratch.table(every.where(F.col("lang_docs") >= p.min_docs).drop("lang_docs"), "kept")


def _one_sided(present: DataFrame, pairs: DataFrame) -> DataFrame:
    """(lang, a, b, v): over the terms that ``a`` holds, the sum of |share - least share of b| - |least share of a - least share of b|.

    ``a``'s distinct shares and the others' least ones are sorted together; running sums tell how many shares lie below each."""
    steps = present.groupBy("lang", F.col("source").alias("a"), "p").agg(F.count("*").alias("n"))
    events = steps.select("lang", "a", F.col("p").alias("x"), F.col("n"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("long").alias("least_a")).unionByName(
        pairs.select("lang", "a", F.col("least_b").alias("x"), F.lit(0).cast("long").alias("n"), "b", "least_a")
    )
    group = Window.partitionBy("lang", "a")
    below = group.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = events.select(
        "lang", "a", "b", "x", "least_a", F.sum("n").over(below).alias("n_low"), F.sum(F.col("n") * F.col("x")).over(below).alias("s_low"), F.sum("n").over(group).alias("n_all"),
        F.sum(F.col("n") * F.col("x")).over(group).alias("s_all"),
    )
    apart = (F.col("x") * F.col("n_low") - F.col("s_low")) + (F.col("s_all") - F.col("s_low") - F.col("x") * (F.col("n_all") - F.col("n_low")))
    return run.where(F.col("b").isNotNull()).select("lang", "a", "b", (apart - F.col("n_all") * F.abs(F.col("least_a") - F.col("x"))).alias("v"))


def audit(docs: DataFrame, params: DivergenceParams = DivergenceParams()) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language by its distance, part ``term`` the terms that a source uses
    more than its language does, by how much."""
    p, spark = params, docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "divergence")
    base = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = kept_counts(base, p, scratch)
    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("is_first").cast("long")).alias("v"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = base.select("lang", "source").distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.fillna(0, ["total", "lang_total", "v"]).withColumn("least", F.when(F.col("v") > 0, _share("0", "total", "v")).otherwise(0))
    groups = scratch.table(groups, "groups")
    release(spark)
    present = scratch.table(kept.join(groups, ["lang", "source"]).select("lang", "source", "term", _share("n", "total", "v").alias("p"), _share("lang_n", "lang_total", "v").alias("q"), "least"), "present")
    # every two sources of a language, once each way: as many rows as the result has
    a = groups.select("lang", F.col("source").alias("a"), F.col("least").alias("least_a"), "v")
    b = groups.select("lang", F.col("source").alias("b"), F.col("least").alias("least_b"))
    pairs = a.join(b, "lang").where(F.col("a") != F.col("b"))
    flat = pairs.where(F.col("a") < F.col("b")).select("lang", "a", "b", (F.col("v") * F.abs(F.col("least_a") - F.col("least_b"))).alias("v"))
    side = _one_sided(present, pairs).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "v")
    l = present.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("p_a"), F.col("least").alias("least_a"))
    r = present.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("least").alias("least_b"))
    apart = lambda x, y: F.abs(F.col(x) - F.col(y))
    both = l.join(r, ["lang", "term"]).where(F.col("a") < F.col("b")).groupBy("lang", "a", "b").agg(
        F.sum(apart("p_a", "p_b") - apart("p_a", "least_b") - apart("least_a", "p_b") + apart("least_a", "least_b")).alias("v")
    )
    value = flat.unionByName(side).unionByName(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    two = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    by_pair = value.select("lang", two, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    by_term = present.where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(by_pair).unionByName(ranked(by_term).where(F.col("rank") <= p.top)).select("lang", "source", "part", "item", "value", "rank")
