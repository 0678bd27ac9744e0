"""Quality: supervised subword embeddings, averaged per document, with a softmax output.

Every word, pair of neighbouring words and character n-gram of a document has a learned vector in a
hashed table; a document is the mean of its vectors.  Plain numpy stochastic gradient descent learns
table and output together from a bounded sample of labelled rows, in one task.  A pair of equal words
shares one bucket whatever the word, so runs of a word are seen for what they are.  Since the output is linear in the mean,
the fitted model folds to one number per bucket (8 bytes for each of 2**bits buckets, whatever the corpus),
which is broadcast and applied in one Arrow pass.

Rows: null and empty texts get the score of the bias alone; a null id is not held out; repeated rows
are scored one by one; a text of any length is scored whole; ties, repeated rows and ids with several labels are learnt from as in ``toxicity``; an empty table gives no rows; with no or
one-class labels the score is the smoothed label rate; other columns of the documents stay (``score`` and ``predicted`` are replaced), those of the labels aren't read.
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

_PAIR = tk.U64(0x8EBC6AF09C88C6E3)


@dataclass(frozen=True)
class SubwordParams:
    """``max_train_rows`` bounds the labelled rows that are learnt from; ``grams`` are the n of the character n-grams, in bytes."""

    bits: int = 18
    dim: int = 12
    grams: tuple[int, ...] = (3,)
    rate: float = 0.5
    epochs: int = 4
    max_train_rows: int = 8_000
    seed: int = 7
    threshold: float = 0.5


def features(flat: np.ndarray, offsets: np.ndarray, p: SubwordParams) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of each word, neighbouring pair and character n-gram within a word (its borders included)."""
    shift = tk.U64(64 - p.bits)
    starts, ends, rows = tk.word_spans(flat, offsets)
    prefix = tk.prefix_hash(flat)
    h = tk.span_hash(prefix, starts, ends)
    parts, owners = [h >> shift], [rows]
    if len(h) > 1:
        same = rows[1:] == rows[:-1]
        pair = tk.mix(h[:-1] * _PAIR + h[1:])
        pair[h[:-1] == h[1:]] = _PAIR
        parts.append(pair[same] >> shift)
        owners.append(rows[:-1][same])
    if len(starts):
        solid = np.zeros(len(flat) + 1, np.int8)
        solid[starts] = 1
        for n in p.grams:
            # an n-gram starts at any byte from which n bytes stay within the word
            lengths = np.maximum(ends - starts - n + 1, 0)
            at = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            g = tk.span_hash(prefix, at, at + n)
            parts.append(tk.mix(g + tk.U64(n)) >> shift)
            owners.append(np.repeat(rows, lengths))
    return np.concatenate(parts).astype(np.int64), np.concatenate(owners)


def fit_arrays(examples: list[tuple[int, np.ndarray, np.ndarray]], p: SubwordParams) -> tuple[np.ndarray, float]:
    """SGD over (label, distinct buckets, their share of the document): folded scores per bucket and bias."""
    rng = np.random.default_rng(p.seed)
    positive = sum(y for y, _, _ in examples)
    rate = (positive + 0.5) / (len(examples) + 1.0)
    size = 1 << p.bits
    if not 0 < positive < len(examples):
        return np.zeros(size), float(np.log(rate / (1 - rate)))
    table = rng.uniform(-1 / p.dim, 1 / p.dim, (size, p.dim)).astype(np.float32)
    out = np.zeros((2, p.dim), np.float32)
    bias = np.log(np.array([1 - rate, rate], np.float32))
    # each class weighs the same: a rare class is learnt as well as a common one
    weight = np.array([0.5 / (1 - rate), 0.5 / rate], np.float32) ** 0.5
    steps, done = p.epochs * len(examples), 0
    for _ in range(p.epochs):
        for k in rng.permutation(len(examples)):
            y, ix, share = examples[k]
            lr = p.rate * (1 - done / steps)
            done += 1
            if not len(ix):
                continue
            own = table[ix]
            hidden = share @ own
            logit = out @ hidden + bias
            e = np.exp(logit - logit.max())
            g = e / e.sum()
            g[y] -= 1
            g *= weight[y] * lr
            back = g @ out
            out -= np.outer(g, hidden)
            bias -= 0.1 * g
            # shares are of the order 1/len(ix); scaled so that a step moves the mean as one vector would
            own -= np.outer(share / (share @ share), back)
            table[ix] = own
    fold = table @ (out[1] - out[0])
    return fold.astype(np.float64), float(bias[1] - bias[0])


def _documents(column: pa.Array, p: SubwordParams) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for first, end, flat, offsets in tk.chunks(column):
        ix, rows = features(flat, offsets, p)
        key, count = np.unique((rows << p.bits) | ix, return_counts=True)
        rows = key >> p.bits
        cut = np.searchsorted(rows, np.arange(end - first + 1))
        for r in range(end - first):
            c = count[cut[r] : cut[r + 1]].astype(np.float32)
            yield first + r, (key[cut[r] : cut[r + 1]] & ((1 << p.bits) - 1)).astype(np.int32), c / max(c.sum(), 1)


def fit(docs: DataFrame, labels: DataFrame, params: SubwordParams = SubwordParams(), label: str = "quality") -> tuple[np.ndarray, float]:
    """Folded model (one number per bucket, bias) from at most ``params.max_train_rows`` labelled rows."""
    p = params

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            order, y = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            found += [(order[r], y[r], ix.tobytes()[:64], ix, share) for r, ix, share in _documents(batch.column(2), p)]
        found.sort(key=lambda x: x[:3])
        fold, bias = fit_arrays([(y, ix, share) for _, y, _, ix, share in found], p)
        yield pa.RecordBatch.from_arrays([pa.array([fold.astype(np.float32).tobytes()], pa.binary()), pa.array([bias])], names=["fold", "bias"])

    rows = training_rows(docs, labels, label, p.max_train_rows).repartition(1).mapInArrow(train, "fold binary, bias double").collect()
    if not rows:
        return np.zeros(1 << p.bits), 0.0
    return np.frombuffer(rows[0][0], np.float32).astype(np.float64), rows[0][1]


def score_texts(column: pa.Array, fold: np.ndarray, bias: float, p: SubwordParams) -> np.ndarray:
    out = np.empty(len(column))
    for first, end, flat, offsets in tk.chunks(column):
        ix, rows = features(flat, offsets, p)
        n = np.bincount(rows, minlength=end - first)
        total = np.bincount(rows, weights=fold[ix], minlength=end - first)
        out[first:end] = 1.0 / (1.0 + np.exp(-np.clip(bias + total / np.maximum(n, 1), -35, 35)))
    return out


def score(docs: DataFrame, model: tuple[np.ndarray, float], params: SubwordParams = SubwordParams(), text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (double) and ``predicted`` (int); columns of these names are replaced."""
    base = docs.drop("score", "predicted")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, bias = shared.value
        for batch in batches:
            s = score_texts(batch.column(at), fold, bias, params)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= params.threshold).astype(np.int32))], names=[*batch.schema.names, "score", "predicted"])

    return base.mapInArrow(run, scored_schema(base))


def query(docs: DataFrame, labels: DataFrame, params: SubwordParams = SubwordParams()) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    base = docs.select("doc_id", "text")
    scored = score(base, fit(base, labels, params), params)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
