"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded sample of labelled rows is learnt from in one task: per-coordinate rates and L1 shrink the
2**bits hashed weights to a sparse vector, which is broadcast (at most 8 bytes for each of 2**bits
weights, whatever the corpus) and applied to whole texts in one Arrow pass without a shuffle.

Rows: null and empty texts get the score of the bias alone; a null id is not held out; repeated rows
are scored one by one; a text of any length is scored whole; examples of one id hash are learnt from in the order of label and first features, so ties and repeated rows don't depend
on partitions; an id with several labels counts with the greatest; an empty table gives no rows, and an empty or one-class training set the constant score of its smoothed label
rate; other columns of the documents stay (``score`` and ``predicted`` are replaced), those of the labels aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .labelled import held_out, scored_schema, training_rows

_PAIR, _SKIP = tk.U64(0xA0761D6478BD642F), tk.U64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class FtrlParams:
    """``max_train_rows`` bounds the labelled rows that are learnt from; ``min_rows`` is the least rows a feature is in;
    ``l1`` is the L1 strength per row of label 1, so that it means the same at every size of the sample."""

    bits: int = 22
    alpha: float = 4.0
    beta: float = 1.0
    l1: float = 0.018
    l2: float = 0.1
    epochs: int = 8
    min_rows: int = 3
    max_train_rows: int = 20_000
    threshold: float = 0.7


def features(flat: np.ndarray, offsets: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed index and row of every word, word pair and pair with one word between."""
    h, rows = tk.words(flat, offsets, tk.NOT_ALNUM)
    parts, owners = [h], [rows]
    for gap, mult in ((1, _PAIR), (2, _SKIP)):
        if len(h) > gap:
            same = rows[:-gap] == rows[gap:]
            parts.append(tk.mix(h[:-gap][same] * mult + h[gap:][same]))
            owners.append(rows[:-gap][same])
    return (np.concatenate(parts) >> tk.U64(64 - bits)).astype(np.int64), np.concatenate(owners)


def _distinct(index: np.ndarray, rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique((rows.astype(np.int64) << bits) | index)
    return key & ((1 << bits) - 1), key >> bits


def fit_arrays(examples: list[tuple[int, np.ndarray]], p: FtrlParams) -> tuple[np.ndarray, float]:
    """FTRL-proximal over (label, distinct feature indexes) in the given order: dense weights and bias."""
    size = 1 << p.bits
    seen = np.zeros(size, np.int32)
    for _, ix in examples:
        seen[ix] += 1
    positive = sum(y for y, _ in examples)
    l1 = p.l1 * positive
    rate = (positive + 0.5) / (len(examples) + 1.0)
    # the bias is one more coordinate, without penalties, that starts at the label rate's log odds
    bias, bias_n = float(np.log(rate / (1 - rate))), 0.0
    bias_z = -bias * p.beta / p.alpha
    dense = np.zeros(size)
    if not 0 < positive < len(examples):
        return dense, bias
    # only features in enough rows have a coordinate
    own = np.flatnonzero(seen >= p.min_rows)
    place = np.full(size, -1, np.int32)
    place[own] = np.arange(len(own))
    flat = np.concatenate([place[ix[seen[ix] >= p.min_rows]] for _, ix in examples])
    cut = np.concatenate([[0], np.cumsum([int((seen[ix] >= p.min_rows).sum()) for _, ix in examples])])
    del place, seen
    z, n = np.zeros(len(own)), np.zeros(len(own))
    for _ in range(p.epochs):
        for k, (y, _) in enumerate(examples):
            ix = flat[cut[k] : cut[k + 1]]
            zi, ni = z[ix], n[ix]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) > l1, (np.sign(zi) * l1 - zi) / ((p.beta + root) / p.alpha + p.l2), 0.0)
            g = 1.0 / (1.0 + np.exp(-np.clip(bias + w.sum(), -35, 35))) - y
            z[ix] = zi + g - (np.sqrt(ni + g * g) - root) / p.alpha * w
            n[ix] = ni + g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / p.alpha * bias
            bias_n += g * g
            bias = float(-bias_z * p.alpha / (p.beta + np.sqrt(bias_n)))
    dense[own] = np.where(np.abs(z) > l1, (np.sign(z) * l1 - z) / ((p.beta + np.sqrt(n)) / p.alpha + p.l2), 0.0)
    return dense, bias


def fit(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams(), label: str = "toxic") -> tuple[np.ndarray, np.ndarray, float]:
    """Sparse model (indexes, weights, bias) from at most ``params.max_train_rows`` labelled rows."""
    p = params

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int, bytes, np.ndarray]] = []
        for batch in batches:
            order, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, end, flat, offsets in tk.chunks(batch.column(2)):
                ix, rows = _distinct(*features(flat, offsets, p.bits), p.bits)
                ix, cut = ix.astype(np.int32), np.searchsorted(rows, np.arange(end - first + 1))
                for r in range(end - first):
                    own = ix[cut[r] : cut[r + 1]]
                    found.append((order[first + r], y[first + r], own[:16].tobytes(), own))
        found.sort(key=lambda x: x[:3])
        w, bias = fit_arrays([(y, ix) for _, y, _, ix in found], p)
        del found
        tk.give_back()
        nz = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(nz, -1), pa.int64()), pa.array(np.append(w[nz], bias), pa.float64())], names=["i", "w"])

    rows = training_rows(docs, labels, label, p.max_train_rows).repartition(1).mapInArrow(train, "i long, w double").toArrow()
    i, w = rows.column("i").to_numpy(), rows.column("w").to_numpy()
    if not len(i):  # an empty single partition can be planned away
        return np.zeros(0, np.int64), np.zeros(0), 0.0
    return i[i >= 0], w[i >= 0], float(w[i < 0][0])


def score_texts(column: pa.Array, dense: np.ndarray, bias: float, bits: int) -> np.ndarray:
    """Probability of label 1 for each text of an Arrow column."""
    out = np.empty(len(column))
    for first, end, flat, offsets in tk.chunks(column):
        ix, rows = features(flat, offsets, bits)
        hit = dense[ix] != 0
        ix, rows = _distinct(ix[hit], rows[hit], bits)
        total = np.bincount(rows, weights=dense[ix], minlength=end - first) if len(ix) else np.zeros(end - first)
        out[first:end] = 1.0 / (1.0 + np.exp(-np.clip(bias + total, -35, 35)))
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], params: FtrlParams = FtrlParams(), text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (int); columns of these names are replaced."""
    base = docs.drop("score", "predicted")
    sparse = docs.sparkSession.sparkContext.broadcast(model)
    bits, threshold, at = params.bits, params.threshold, base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, w, bias = sparse.value
        dense = np.zeros(1 << bits, np.float32)
        dense[i] = w
        for batch in batches:
            s = score_texts(batch.column(at), dense, bias, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return base.mapInArrow(run, scored_schema(base))


def drop_toxic(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; its columns as they were."""
    model = fit(docs, labels, params)
    sparse = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        i, w, bias = sparse.value
        dense = np.zeros(1 << params.bits, np.float32)
        dense[i] = w
        for batch in batches:
            yield batch.filter(pa.array(score_texts(batch.column(at), dense, bias, params.bits) < params.threshold))

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, labels: DataFrame, params: FtrlParams = FtrlParams()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    base = docs.select("doc_id", "text")
    scored = score(base, fit(base, labels, params), params)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
