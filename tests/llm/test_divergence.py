"""The divergence audit against plain counting, with odd rows, many thresholds and sketches that are far too small."""

import random
import re
from collections import Counter, defaultdict

import pytest

from pathloom.llm import divergence
from pathloom.llm.divergence import DivergenceParams

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, term string, value string, rank string, n string, item string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_audit(rows, min_docs=30, top=50):
    docs = [((s or ""), (l or ""), re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))) for _, t, l, s in rows]
    out = set()
    for lang in {l for _, l, _ in docs}:
        own = [(s, w) for s, l, w in docs if l == lang]
        df = Counter(t for _, w in own for t in set(w))
        kept = sorted(t for t, n in df.items() if n >= min_docs)
        by_source = defaultdict(Counter)
        for s, w in own:
            by_source[s].update(t for t in w if df[t] >= min_docs)
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}
        whole = share(sum(by_source.values(), Counter()))
        p = {s: share(c) for s, c in by_source.items()}
        for s in p:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in p if o != s]
            words = [(t, p[s][t] - whole[t]) for t in kept if by_source[s][t] > 0 and p[s][t] > whole[t]]
            for part, items, most in (("pair", pairs, None), ("term", words, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, v, k) for k, (i, v) in enumerate(items[:most], 1)}
    return out


def table(n=400, seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{''.join(rng.choice('abcdeé') for _ in range(rng.randint(1, 4)))}" for _ in range(150)] + ["Zürich", "ZÜRICH", "zürich", "ÄB", "x▁y", "日本"]
    rows = []
    for i in range(n):
        lang, source = rng.choice(["en", "en", "de", None]), rng.choice(["hot"] * 5 + ["s1", "s2", "s3", None, "", "é", "Z", "s10"])
        words = [vocabulary[int(len(vocabulary) * rng.random() ** (2 if source == "hot" else 1.4))] for _ in range(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", "-", "1", "\n", "."]).join(words), lang, source))
    rows += [(None, None, "en", "s1"), (n, "", "en", "only empty"), (n + 1, None, "xx", "a"), (n + 2, "few words", "xx", "b"), (n + 3, "1 2 3", "yy", "alone"), (n + 4, "wa " * 40_000, "en", "s1")]
    return rows + [rows[3]] * 3 + [(5, rows[5][1], "en", "s2")] * 2


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "t", "v", "r", "n", "i") for r in rows], SCHEMA).repartition(5)


def got(spark, rows, p):
    found = divergence.audit(frame(spark, rows), p)
    assert found.schema.simpleString() == "struct<lang:string,source:string,part:string,item:string,value:bigint,rank:int>"
    out = [tuple(r) for r in found.collect()]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize("p", [DivergenceParams(), DivergenceParams(min_docs=3, top=4), DivergenceParams(min_docs=1, held_rows=50), DivergenceParams(least_cells=1 << 14, most_cells=1 << 14, rows=1), DivergenceParams(min_docs=10_000)])
def test_against_plain_counting(spark, p):
    rows = table()
    assert got(spark, rows, p) == plain_audit(rows, p.min_docs, p.top)


def test_the_sketch_never_underestimates_and_discards(spark):
    rng = random.Random(9)
    rows = [(i, " ".join("u" + "".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(200)) + " common", "en", "s") for i in range(60)]
    p, cells = DivergenceParams(), 1 << 16
    docs = frame(spark, rows).select("lang", "source", "text")
    bits = divergence.possible_cells(divergence.sketch(docs, p, cells), p, cells)
    left = {r["term"]: r["n_docs"] for r in divergence.counts(docs, p, cells, bits).groupBy("term").sum("n_docs").withColumnRenamed("sum(n_docs)", "n_docs").collect()}
    assert left["common"] == 60 and len(left) < 100  # of 12,000 distinct terms
    tiny = DivergenceParams(min_docs=2)
    bits = divergence.possible_cells(divergence.sketch(docs, tiny, 1 << 14), tiny, 1 << 14)
    df = Counter(t for _, t, _, _ in rows for t in set(t.split()))
    left = {r["term"] for r in divergence.counts(docs, tiny, 1 << 14, bits).collect()}
    assert {t for t, n in df.items() if n >= 2} <= left


def test_empty_table(spark):
    assert got(spark, [], DivergenceParams()) == set()
