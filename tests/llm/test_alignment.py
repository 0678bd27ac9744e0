"""The alignment of two tokenizers against whole texts encoded and compared token by token."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import alignment
from pathloom.llm import textkit as tk
from pathloom.llm.alignment import AlignParams

SCHEMA = "doc_id long, text string, lang string, n_a string, segment string, block string, groups string"


def plain(texts, t):
    """(A tokens, B tokens, groups, links) of each whole text; None without tokens."""
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        a = t.a.encode(" " + text, add_special_tokens=False).ids
        b = t.b.encode(text)
        spans = []
        for ids, own in ((a, t.a_bytes), (b, t.b_bytes)):
            at, found = 0, []
            for k in ids:
                found.append((at, at + len(own[k]), k))
                at += len(own[k])
            spans.append(found)
        if any(b"".join(own[k] for k in ids) != (" " + text).encode() for ids, own in ((a, t.a_bytes), (b, t.b_bytes))):
            out.append(None)
            continue
        ends = {e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]}
        groups, x, y = [], [], []
        bs = iter(spans[1])
        for s, e, k in spans[0]:
            x.append(k)
            if e in ends:
                for _, f, m in bs:
                    y.append(m)
                    if f == e:
                        break
                groups.append(",".join(map(str, x)) + "|" + ",".join(map(str, y)))
                x, y = [], []
        links, j = [], 0
        for s, e, k in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            i = j
            while i < len(spans[1]) and spans[1][i][0] < e:
                links.append((k, spans[1][i][2]))
                i += 1
        out.append((len(a), len(b), groups, links))
    return out


def brute(rows, t):
    found = plain([x for _, x in rows], t)
    count = Counter(l for f in found if f for l in f[3])
    most = Counter()
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for (i, _), f in zip(rows, found):
        if f is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            a, b, groups, links = f
            out.append((i, a, b, len(groups), len(links), sum(count[l] == most[l[1]] for l in links), sum(count[l] for l in links), ";".join(groups)))
    return sorted(out, key=str)


def texts():
    rng = random.Random(8)
    odd = [" ", "  ", "\n", "\t", "\r\n", "\x0b", "\x85", "\xa0", " ", "　", "᠎", "​", "﻿", "\x1c", "\x00"]
    parts = ["the", "Donau", "dampf", "é", "ß", "日本語", "😀", "é", "<|endoftext|>", "</s>", "<0x41>", "<unk>", "'s", "12345", "...", "!!!", "_", "thationonen", "x" * 40, "▀", "क्षि", "�"]
    out = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  ", "  a", "a\n", "\na", "a\n\n b", "a \n b", " \n", "x y", "x  y", "x   y   ", "a b", "a b", "a　 b", "　 ", "a　", "a 　"]
    out += ["a▁b", "▁", "a ▁ b", "▁▁ x", "x ▁"]  # B takes it for a blank, so the bytes differ
    for _ in range(160):
        n = rng.randint(1, 30)
        out.append("".join(rng.choice(parts) + (rng.choice(odd) if rng.random() < 0.3 else rng.choice([" ", " ", "\n", ""])) for _ in range(n)))
    out += [rng.choice(odd) + out[k] + rng.choice(odd) for k in range(40, 80)]
    out += ["word " * 3000 + "end", "y" * 5000, "\n" * 300, " " * 300]
    return out


@pytest.fixture(scope="module")
def rows():
    own = list(enumerate(texts()))
    return own + [(None, "null id"), (None, None), (7, own[7][1]), (40, own[40][1]), (40, own[40][1]), (5, "another text of this id")]


@pytest.fixture(scope="module")
def want(rows):
    return brute(rows, alignment.tokenizers())


def frame(spark, rows, parts=4):
    return spark.createDataFrame([(i, t, "en", "x", "s", "b", "g") for i, t in rows], SCHEMA).repartition(parts)


def test_vocabularies_are_separable():
    t = alignment.tokenizers()
    assert t.separable and t.starts == " \n\t"  # pieces hold line ends after semicolons and the like


@pytest.mark.parametrize("p", [AlignParams(), AlignParams(block_bytes=1, joined_bytes=1), AlignParams(broadcast_pairs=0, joined_bytes=60, block_bytes=2000)])
def test_against_whole_texts(spark, rows, want, p):
    got = sorted((tuple(r) for r in alignment.align(frame(spark, rows), p).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups").collect()), key=str)
    assert got == want
    assert any(r[1] and "▁" not in (t or "") for r, (_, t) in zip(got, rows)) and sum(r[1] == 0 for r in got) >= 7


def test_query_digests(spark, rows, want):
    got = sorted((tuple(r) for r in alignment.query(frame(spark, rows)).collect()), key=str)
    digest = lambda g: hashlib.sha256(g.encode()).hexdigest() if g else ""
    assert got == sorted(((*r[:7], digest(r[7])) for r in want), key=str)


def test_without_separable_vocabularies_texts_are_whole(rows, want):
    flat, offsets = tk.text_buffer(pa.array([t for _, t in rows]))
    data, where, number = alignment.cut(flat, offsets, "")
    assert number.tolist() == [1 if t else 0 for _, t in rows]
    assert bytes(data) == "".join(" " + t for _, t in rows if t).encode() and len(where) - 1 == number.sum()


def test_segments_are_few_and_make_the_texts(rows):
    flat, offsets = tk.text_buffer(pa.array([t for _, t in rows]))
    data, where, number = alignment.cut(flat, offsets, alignment.tokenizers().starts)
    own = [bytes(data[a:b]).decode() for a, b in zip(where[:-1], where[1:])]
    edge = np.concatenate([[0], np.cumsum(number)])
    assert ["".join(own[a:b]) for a, b in zip(edge[:-1], edge[1:])] == [" " + t if t else "" for _, t in rows]
    assert len([w for w in own if w == " word"]) == 3000


def test_texts_without_tokens_change_no_counts(spark):
    """A segment of sound texts occurs in unsound ones too: only the sound ones' links are counted."""
    rows = [(1, "same words here"), (2, "same words ▁ here"), (3, "▁"), (4, "here")]
    got = sorted((tuple(r) for r in alignment.align(frame(spark, rows, 2)).collect()), key=str)
    assert sorted(((r[0], *r[1:]) for r in got), key=str) == brute(rows, alignment.tokenizers())


def test_empty_table(spark):
    assert alignment.query(frame(spark, [], 1)).collect() == []
    assert [tuple(r) for r in alignment.query(frame(spark, [(1, None)], 1)).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]
