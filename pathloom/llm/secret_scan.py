"""Secret scans: spans of assigned passwords, access keys, hex keys and random strings in every text.

Three kinds are patterns.  The fourth, ``random``, is a token-efficiency test: a byte-pair vocabulary was learnt from language, so it spends few characters a token on a string that
isn't language.  Runs of key characters are looked at; known digests and identifiers are left out first, what has at most ``max_ratio`` characters a token is a span.

Everything is one pass over the texts, without a shuffle.  Runs and keywords are found on the flat bytes of a batch; only rows that have one become strings.

Rows: null and empty texts have no spans; null ids and repeated rows are scanned like any others; texts are looked at whole, whatever their length; other columns are
kept by ``redact`` and not read by ``scan``; no documents give no rows.
"""

from __future__ import annotations

import base64
import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .scratch import small_batches

#: fixed values: the kinds in their order, and the patterns of the first three
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KEYWORDS = (b"passw", b"secret", b"token", b"api")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

#: what a key is made of; a run of it may end in two signs of base64 padding
_KEY = np.zeros(256, bool)
_KEY[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"]] = True
#: lengths of MD5, SHA-1 and SHA-2 digests in hex
DIGESTS = (32, 40, 56, 64, 96, 128)
_DIGEST = re.compile("(?:" + "|".join(f"[0-9A-Fa-f]{{{n}}}" for n in DIGESTS) + ")|(?:md5|sha1|sha224|sha256|sha384|sha512)[-/][A-Za-z0-9+/]+", re.IGNORECASE)
_UUID = re.compile(r"(?:.*[-/_+])?[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?:[-/_+].*)?")
#: names, paths, dates and numbers: parts of letters and then digits, or digits and then a few letters
_NAME = re.compile(r"(?:[A-Za-z]*[0-9]*|[0-9]+[A-Za-z]{1,3}[0-9]*)(?:[-+/_]+(?:[A-Za-z]*[0-9]*|[0-9]+[A-Za-z]{1,3}[0-9]*))*")

_ENCODERS: dict[str, object] = {}


@dataclass(frozen=True)
class SecretParams:
    """``least``: characters of a run that is tested.  ``max_ratio``: characters a token up to which it is random; ``max_name_ratio``: the same for runs that look like names,
    a long word of an invented language has more than that.  ``slice``: characters encoded at once, so that a long run costs no more than its length."""

    vocabulary: str = ""
    least: int = 20
    max_ratio: float = 1.8
    max_name_ratio: float = 1.4
    slice: int = 256


def encoder(path: str = ""):
    """The byte-pair encoding of a tiktoken rank file, read once by each worker."""
    if path not in _ENCODERS:
        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def ratio(run: str, p: SecretParams) -> float:
    """Characters a token."""
    encode = encoder(p.vocabulary).encode_ordinary
    return len(run) / sum(len(encode(run[k : k + p.slice])) for k in range(0, len(run), p.slice))


def is_random(run: str, p: SecretParams) -> bool:
    """Whether a run of key characters is a random string: neither a digest nor an identifier, and the vocabulary has hardly a token for it."""
    if len(run) < p.least or run.isdigit() or _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return False
    return ratio(run, p) <= (p.max_name_ratio if _NAME.fullmatch(run) else p.max_ratio)


def spans_of(text: str, runs: list[tuple[int, int]], p: SecretParams) -> list[tuple[int, str, int]]:
    """(start, kind, end) of one text in code points, by start and kind; ``runs`` are its maximal runs of key characters that are long enough for anything."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_VALUE]
    for a, b in runs:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b) if m.end() - m.start() >= LEAST_ACCESS]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b) if m.end() - m.start() >= LEAST_HEX]
    found.sort()
    begins, reach = [a for a, _, _ in found], list(itertools.accumulate((b for _, _, b in found), max))
    for a, b in runs:
        # a run within a longer word of other letters, or within the data of a link, is no key of its own
        if text[a - 1 : a].isalnum() or text[b : b + 1].isalnum() or text.endswith("base64,", 0, a):
            continue
        before = bisect.bisect_right(begins, a)
        if before and reach[before - 1] >= b:  # it lies within a pattern's span
            continue
        if is_random(text[a:b], p):
            end = b + len(text[b : b + 2]) - len(text[b : b + 2].lstrip("="))
            found.append((a, 3, end))
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def column_spans(column: pa.Array, p: SecretParams) -> Iterator[list[tuple[int, str, int]]]:
    """The spans of each text of an Arrow column, in order."""
    least = min(p.least, LEAST_ACCESS, LEAST_HEX)
    for first, end, flat, offsets in tk.chunks(column):
        solid, edge = _KEY[flat], np.zeros(len(flat) + 1, bool)
        edge[offsets] = True  # a run ends with its row
        starts = np.flatnonzero(solid & (edge[:-1] | ~np.concatenate([[False], solid[:-1]])))
        ends = np.flatnonzero(solid & (edge[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
        long = ends - starts >= least
        starts, ends = starts[long], ends[long]
        rows = np.searchsorted(offsets, starts, "right") - 1
        lower, worded = tk.LOWER[flat].tobytes(), set()
        for word in KEYWORDS:
            at = lower.find(word)
            while at >= 0:
                r = int(np.searchsorted(offsets, at, "right")) - 1
                worded.add(r)
                at = lower.find(word, int(offsets[r + 1]))  # one is enough for the row
        cut = np.searchsorted(rows, np.arange(end - first + 1))
        for r in range(end - first):
            if cut[r] == cut[r + 1] and r not in worded:
                yield []
                continue
            own = flat[offsets[r] : offsets[r + 1]]
            place = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])  # code points before each byte
            runs = list(zip(place[starts[cut[r] : cut[r + 1]] - offsets[r]].tolist(), place[ends[cut[r] : cut[r + 1]] - offsets[r]].tolist()))
            yield spans_of(own.tobytes().decode(), runs, p)


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, params: SecretParams = SecretParams(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, spans): of every row the spans (kind, start, end) by start and kind, in code points with the end exclusive."""
    base = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for a, k, b in own] for own in column_spans(batch.column(1), params)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["key", "spans"])

    found = base.mapInArrow(run, f"key {base.schema['key'].dataType.simpleString()}, spans {SPANS}")
    return found.select(F.col("key").alias(key), "spans")


def redact(docs: DataFrame, params: SecretParams = SecretParams(), text: str = "text") -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in square brackets; overlapping spans by that of the first."""
    at = docs.columns.index(text)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for r, own in enumerate(column_spans(batch.column(at), params)):
                out, last = [], 0
                for a, kind, b in own:
                    if a >= last:
                        out += [texts[r][last:a], f"[{kind}]"]
                    last = max(last, b)
                if own:
                    texts[r] = "".join(out) + texts[r][last:]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def query(docs: DataFrame, params: SecretParams = SecretParams()) -> DataFrame:
    """doc_id, counts of the kinds, the digest of the patterns' spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return scan(docs, params).select("doc_id", *(count(k) for k in KINDS[:3]), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), count("random"))
