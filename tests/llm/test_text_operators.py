"""Text operators against brute force, on a table with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pathloom.llm import decontaminate, ngram_join, packing, quality, suffix_dedup, toxicity
from pathloom.llm import textkit as tk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score string, __key string"


def text_of(rng, n):
    return "".join(rng.choice(["Ab", "ba ", "ción", "x", "é\n", "qu", "the ", ". "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    base = [text_of(rng, 300) for _ in range(12)]
    passage = text_of(rng, 200)
    out = list(enumerate(base))
    out += [(20 + k, base[0]) for k in range(4)]  # copies
    out += [(30 + k, base[1][: 100 * k] + " edit " + base[1][100 * k :]) for k in range(4)]  # near copies
    out += [(40 + k, text_of(rng, 40) + passage + text_of(rng, 50)) for k in range(5)]  # a passage with other surroundings
    out += [(50, None), (51, ""), (52, None), (53, "one two"), (54, "One  two"), (55, "a" * 1500), (56, "ab " * 700), (57, "  \n"), (58, text_of(rng, 40_000)), (59, "x" * 399), (60, "x" * 400)]
    out += [(None, base[2]), (None, "null id"), (5, base[5]), (5, base[5])]  # null ids and repeated rows
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "z", "w") for i, t in rows], SCHEMA).repartition(3)


def shingle_set(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()


def test_words_and_shingles(rows):
    column = pa.array([t for _, t in rows])
    for _, _, flat, offsets in tk.chunks(column, 1 << 30):
        h, cut = tk.shingle_sets(flat, offsets)
    assert np.diff(cut).tolist() == [len(shingle_set(t)) for _, t in rows]
    assert [tk.chunks(column, 64)] and sum(e - f for f, e, _, _ in tk.chunks(column, 64)) == len(rows)


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[x][0] for x in range(len(rows)) if group[x] == group[k] and rows[x][0] is not None]
        out.append((i, len(sets[k]), min(ids) if ids else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("params", [ngram_join.JoinParams(), ngram_join.JoinParams(cluster_shingles=10, short_list=2, heavy_local=1000)])
def test_ngram_join(spark, docs, rows, params):
    found = ngram_join.query(docs, params)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_components(rows)


def test_ngram_join_chance_phrases_seldom_meet(spark, monkeypatch):
    """Texts that share only phrases that any text may have make few candidates, and near copies are found still."""
    from pathloom.llm.scratch import Scratch

    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=9))
    phrases = [[word() for _ in range(6)] for _ in range(100)]
    texts = [" ".join(w for _ in range(20) for w in (*(word() for _ in range(12)), *rng.choice(phrases))) for _ in range(60)]
    texts += [texts[0] + " more", texts[1] + " words"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    p, made, write = ngram_join.JoinParams(max_heavy=0), {}, Scratch.table

    def table(self, df, name):
        out = write(self, df, name)
        if name == "candidates":
            made[name] = out.where("list is null").select("a", "b").distinct().count()
        return out

    monkeypatch.setattr(Scratch, "table", table)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.query(df, p).collect()}
    assert found == {k: {60: 0, 61: 1}.get(k, k) for k in range(62)}
    assert 2 <= made["candidates"] < 300  # by hash alone over 1,000 of 1,891


def test_ngram_join_shuffles_compared_texts_only(spark):
    df = spark.range(20000).selectExpr("xxhash64(id) AS row_key", "concat('text ', id) AS text")
    wanted = df.limit(50)
    passed = ngram_join._let_through(df, wanted, ngram_join.JoinParams())
    assert passed.count() < 2000 and passed.join(wanted, "row_key", "left_semi").count() == 50
    assert ngram_join._let_through(df, wanted.limit(0), ngram_join.JoinParams()).count() == 0


def test_ngram_join_keeps_one(spark, docs, rows):
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    least = {c for _, _, c in brute_components(rows)}
    assert {r["doc_id"] for r in kept.collect()} == least


def test_ngram_join_keeps_one_row(spark):
    rng = random.Random(21)
    a, b, c = (text_of(rng, 200) for _ in range(3))
    # id 2 has a copy of id 1's text, its own text three times, and an empty one; rows without an id are linked by text alone
    own = [(1, a), (2, a), (2, b), (2, b), (2, b), (3, b + " x"), (4, c), (4, c), (None, c), (None, a[:-2]), (5, None), (5, ""), (2, ""), (None, ""), (None, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(own)], "doc_id long, text string, __key long")
    kept = ngram_join.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"] or "") for r in kept.collect()), key=str) == sorted([(1, a), (2, b), (4, c), (5, ""), (2, ""), (None, "")], key=str)


def test_tree_links_join_the_right_sets():
    rng = np.random.default_rng(1)
    for _ in range(20):
        base = rng.integers(0, 60, (4, 30)).astype(np.uint64)
        sets = [np.unique(np.concatenate([base[rng.integers(4)][: rng.integers(15, 30)], rng.integers(0, 500, 3).astype(np.uint64)])) for _ in range(15)]
        truth, own = list(range(15)), list(range(15))
        for a in range(15):
            for b in range(a):
                both = len(np.intersect1d(sets[a], sets[b]))
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    truth = [truth[b] if g == truth[a] else g for g in truth]
        for a, b in ngram_join.tree_links(sets, 75):
            own = [own[b] if g == own[a] else g for g in own]
        assert all((truth[a] == truth[b]) == (own[a] == own[b]) for a in range(15) for b in range(15))


def test_tree_links_hold_little_beside_the_sets():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 2000).astype(np.uint64)
    sets = []
    for _ in range(600):
        x = base.copy()
        x[rng.integers(0, 2000, 60)] = rng.integers(0, 2**63, 60).astype(np.uint64)
        sets.append(np.unique(x))
    tracemalloc.start()
    links = ngram_join.tree_links(sets, 75)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(links) == 599
    assert peak < 30 * sum(map(len, sets))


def test_pairs_of_lists_apart_come_in_parts(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(ngram_join, "APART", 1)
    got = ngram_join.query(docs, ngram_join.JoinParams(cluster_shingles=10, short_list=2, heavy_local=1000, held_tokens=50)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, ngram_join.query(docs).collect()), key=repr)


def brute_repeats(texts, length):
    where = {}
    for k, b in enumerate(texts):
        for i in range(len(b) - length + 1):
            where.setdefault(b[i : i + length], []).append((k, i))
    cover = [bytearray(len(b)) for b in texts]
    for own in where.values():
        if len(own) > 1:
            for k, i in own:
                cover[k][i : i + length] = b"\1" * length
    return cover


@pytest.mark.parametrize("params", [suffix_dedup.DedupParams(), suffix_dedup.DedupParams(length=64, gram=16, group_limit=2, shallow=8)])
def test_suffix_dedup(spark, docs, rows, params):
    texts = [(t or "").encode() for _, t in rows]
    cover = brute_repeats(texts, params.length)
    expected = []
    for (i, _), b, c in zip(rows, texts, cover):
        kept = bytes(x for x, m in zip(b, c) if not m)
        spans = sum(1 for k in range(len(c)) if c[k] and not (k and c[k - 1]))
        expected.append((i, len(b), sum(c), spans, hashlib.sha256(kept).hexdigest()))
    assert sorted((tuple(r) for r in suffix_dedup.query(docs, params).collect()), key=str) == sorted(expected, key=str)


def test_suffix_dedup_keeps_columns(spark, docs, rows):
    left = suffix_dedup.remove(docs)
    assert left.columns == docs.columns
    texts = [(t or "").encode() for _, t in rows]
    whole = [i for (i, t), b, c in zip(rows, texts, brute_repeats(texts, 400)) if not (b and all(c))]
    assert sorted(map(str, whole)) == sorted(str(r["doc_id"]) for r in left.collect())
    assert all(r["n_chars"] == len(r["text"] or "") for r in left.collect())


def test_deep_shallow_sorts():
    rng = random.Random(2)
    for _ in range(200):
        own = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(1, 20))]
        own += [own[0] + b"a", own[0], own[0] + b"\0"]
        order, lcp = suffix_dedup.deep_shallow(own, rng.choice([0, 8, 16]))
        assert [own[i] for i in order] == sorted(own)
        for a, b, n in zip(order, order[1:], lcp[1:]):
            assert n == suffix_dedup.common_prefix(own[a], own[b]) and own[a][:n] == own[b][:n]


ITEMS = [(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, "one two"), (3, None), (4, ""), (4, "alpha beta gamma delta epsilon zeta eta theta iota kappa")]


def test_decontamination(spark):
    rng = random.Random(8)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    long_item = noise(90)
    items = [*ITEMS, (7, long_item), (None, noise(30))]
    words = long_item.split()
    own = [(0, noise(5000) + " " + long_item.upper() + " " + noise(3000)), (1, noise(50) + " " + ITEMS[0][1].replace(" ", "\n") + " " + noise(20)), (2, "One TWO"), (3, None), (4, ""), (5, noise(200)), (6, " ".join(words[:60]) + " " + noise(40)), (7, " ".join(words[:75]) + " " + noise(900)), (7, " ".join(words[:75]) + " " + noise(900)), (None, items[-1][1])]
    docs = spark.createDataFrame([(i, t, 1) for i, t in own], "doc_id long, text string, item_id int")
    table = spark.createDataFrame(items, "item_id long, text string")
    expected = sorted(((i, k, len(shingle_set(q)), len(shingle_set(q) & shingle_set(t))) for i, t in own for k, q in items if shingle_set(q) and len(shingle_set(q) & shingle_set(t)) >= 0.75 * len(shingle_set(q))), key=str)
    for p in (decontaminate.DecontaminationParams(), decontaminate.DecontaminationParams(block_bytes=200)):
        assert sorted((tuple(r)[:4] for r in decontaminate.find(docs, table, p).collect()), key=str) == expected
        left = decontaminate.drop_contaminated(docs, table, p)
        assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert decontaminate.find(docs, table.where("false")).count() == 0


def test_decontamination_of_smallest_items(spark):
    rng = random.Random(22)
    noise = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    items = [(k, noise(n)) for k, n in enumerate([5, 5, 5, 6, 6, 7, 9, 12, 19])] + [(9, "only three words")]
    own = []
    for i in range(150):
        a, b = items[i % 9][1], items[(i * 4 + 1) % 9][1].split()
        own.append((i, " ".join([noise(2000), a, noise(1000), *b[: max(len(b) - 2, 5)], noise(20), a])))
    own += [(200, noise(3000)), (201, "Only three\tWORDS"), (202, noise(50) + " only three words"), (None, items[0][1])]
    docs, table = spark.createDataFrame(own, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    sets = [(k, shingle_set(q)) for k, q in items]
    expected = sorted(((i, k, len(q), len(q & t)) for i, t in ((i, shingle_set(t)) for i, t in own) for k, q in sets if len(q & t) >= 0.75 * len(q)), key=str)
    assert len(expected) > 150
    assert sorted((tuple(r)[:4] for r in decontaminate.find(docs, table).collect()), key=str) == expected
    left = {r["doc_id"] for r in decontaminate.drop_contaminated(docs, table).collect()}
    assert left == {i for i, _ in own} - {x[0] for x in expected}


def test_packing_round_trip(spark, docs, rows):
    from tokenizers import Tokenizer

    p = packing.PackParams(window=512, shard_bytes=20_000)
    found = packing.pack(docs, p).toPandas()
    tok = Tokenizer.from_file(packing.default_tokenizer())
    seq = found.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id").length.cumsum() - seq.length == seq.offset).all() and seq.groupby("sequence_id").length.sum().max() <= 512
    expected = sorted(zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for _, t in rows if len(t or "") < 1000)
    one = found[(found.start == 0) & (found.length == found.doc_tokens)]
    whole = {(i, zlib.crc32(np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes())) for i, t in rows}
    assert {(None if i != i else int(i), c) for i, c in zip(one.doc_id, one.ids_crc32)} <= whole and len(expected)
    lengths = sorted(len(tok.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in rows)
    assert sorted(found[found.start == 0].doc_tokens) == lengths and found.length.sum() == sum(lengths)
    long_ids = np.array(tok.encode(rows[-7][1] if rows[-7][0] == 58 else dict(rows)[58], add_special_tokens=False).ids + [1], "<u4")
    for _, r in found[found.doc_id == 58].iterrows():
        assert zlib.crc32(long_ids[int(r.start) : int(r.start + r.length)].tobytes()) == r.ids_crc32
    shards = found.sequence_id.nunique() * 512 - found.length.sum()
    assert shards <= 512 * (found.sequence_id // 2**32).nunique()


def test_unit_encoder_is_the_tokenizer():
    from tokenizers import Tokenizer

    tok, enc = Tokenizer.from_file(packing.default_tokenizer()), packing.UnitEncoder(packing.default_tokenizer())
    rng = random.Random(4)
    bits = ["a", "don't", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u3000", "\u0085", "é", "你好", "123", "...", "<|endoftext|>", "\x1c", "\x00", "🙂", "'s", " x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 25))) for _ in range(600)]
    flat, offsets = tk.text_buffer(pa.array(texts))
    ids, cut, _, _ = enc.encode(flat, offsets)
    for k, t in enumerate(texts):
        assert ids[cut[k] : cut[k + 1]].tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t)


def labelled(spark, word, rng, n=400):
    own = [(k, " ".join(f"w{rng.randrange(300)}" for _ in range(60)) + (f" {word} {word}" if k % 4 == 0 else ""), 9) for k in range(n)]
    docs = spark.createDataFrame([*own, (None, None, 1), (5000, "", 1), (5001, None, 1), (5002, word + " x" * 50_000, 1), (7, own[7][1], 9)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(k, int(k % 4 != 0), int(k % 4 == 0)) for k in range(n)] + [(None, 1, 1), (3, None, None), (0, 0, 1)], "doc_id long, quality int, toxic int")
    return docs, labels


@pytest.mark.parametrize("module,label", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers(spark, module, label):
    docs, labels = labelled(spark, "###vile###" if module is quality else "vile", random.Random(6))
    found = module.query(docs, labels).toPandas()
    assert list(found.columns) == ["doc_id", "held_out", "score", "predicted"] and len(found) == 405 and found.score.between(0, 1).all()
    own = found[found.doc_id < 400]
    assert (own.held_out == [zlib.crc32(str(int(i)).encode()) % 3 == 1 for i in own.doc_id]).all()
    truth = (own.doc_id % 4 == 0) == (label == "toxic")
    held = own.held_out
    assert ((own.predicted == 1) == truth)[held].mean() > 0.95
    # labels of held-out rows don't matter
    other = labels.withColumn(label, __import__("pyspark").sql.functions.expr(f"IF(crc32(CAST(doc_id AS STRING)) % 3 = 1, 1 - {label}, {label})"))
    assert np.allclose(module.query(docs, other).toPandas().sort_values("score").score, found.sort_values("score").score)
    nothing = module.query(docs, labels.where("false")).toPandas()
    assert len(nothing) == 405 and nothing.score.between(0, 1).all()
    assert module.query(docs.where("false"), labels).count() == 0


def test_toxic_documents_go(spark):
    docs, labels = labelled(spark, "vile", random.Random(6))
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    ids = {r["doc_id"] for r in left.collect()}
    assert len([i for i in ids if i is not None and i < 400 and i % 4 == 0]) <= 10 and len([i for i in ids if i is not None and i < 400 and i % 4]) >= 292


def test_empty_tables(spark, docs):
    none = docs.where("false")
    assert ngram_join.query(none).count() == 0 and suffix_dedup.query(none).count() == 0 and packing.pack(none).count() == 0
    assert decontaminate.find(none, spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_packing_ranks_by_bm25(spark):
    """Scores against the formula over sets of words, and the order of documents in windows against a plain greedy loop."""
    rng = random.Random(17)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7)) % 60}" for _ in range(rng.randint(1, 40))) for _ in range(40)]
    p, enc = packing.PackParams(query_words=10**6), packing.UnitEncoder(packing.default_tokenizer())
    flat, offsets = tk.text_buffer(pa.array(texts))
    ids, cut, entry, rows = enc.encode(flat, offsets)
    words = [[w if k == 0 else " " + w for k, w in enumerate(t.split(" "))] for t in texts]
    corpus = packing.count_corpus(spark.createDataFrame([(t,) for t in texts], "text string"))
    df = {w: sum(w in x for x in words) for x in words for w in x}
    assert corpus.documents == 40 and abs(corpus.mean_size - len(entry) / 40) < 1e-9
    for e, r, w in zip(entry, rows, [w for x in words for w in x]):
        assert corpus.frequency[enc.table.term[e]] == df[w]
    index = packing.Bm25(entry, enc.table.term[entry], rows, 40, p, corpus)

    def score(q, d):
        out = 0.0
        for w in set(words[q]):
            tf = words[d].count(w)
            if df[w] > 1 and tf:
                out += np.log(1 + (40 - df[w] + 0.5) / (df[w] + 0.5)) * tf * (p.k1 + 1) / (tf + p.k1 * (1 - p.b + p.b * len(words[d]) / corpus.mean_size))
        return out

    table = np.array([[score(q, d) for d in range(40)] for q in range(40)])
    assert np.allclose(np.array([index.scores(q) for q in range(40)]), table)
    lengths, window = np.diff(cut) + 1, 64
    order, left, room, seed = [], set(range(40)), window, None
    while left:
        near = sorted((d for d in left if seed is not None and room < window and table[seed][d] > 1e-12), key=lambda d: (-table[seed][d], d))
        pick = near[0] if near else min(left)
        order.append(pick)
        left.discard(pick)
        if room == window:
            seed = pick
        rest = int(lengths[pick])
        while rest:
            take = min(room, rest)
            rest, room = rest - take, room - take
            if not room:
                room = window
                if rest:
                    seed = pick
    assert list(dict.fromkeys(x[0] for x in packing.pack_shard(lengths, index, window))) == order


def test_ftrl_against_plain_loops():
    """Every coordinate by the update rule as it is written, one at a time."""
    rng = random.Random(23)
    p = toxicity.FtrlParams(bits=6, epochs=3, min_rows=2, l1=0.02, alpha=0.5)
    examples = []
    for _ in range(60):
        y = int(rng.random() < 0.3)
        examples.append((y, np.array(sorted({rng.randrange(40) for _ in range(5)} | ({41, 42} if y else {43})), np.int32)))
    w, bias = toxicity.fit_arrays(examples, p)
    positive, seen = sum(y for y, _ in examples), [sum(i in ix for _, ix in examples) for i in range(64)]
    rate = (positive + 0.5) / 61
    z, n = {i: 0.0 for i in range(64)}, {i: 0.0 for i in range(64)}
    b = math.log(rate / (1 - rate))
    bz, bn = -b * p.beta / p.alpha, 0.0
    weight = lambda i: 0.0 if abs(z[i]) <= p.l1 * positive else (math.copysign(p.l1 * positive, z[i]) - z[i]) / ((p.beta + math.sqrt(n[i])) / p.alpha + p.l2)
    for _ in range(p.epochs):
        for y, ix in examples:
            own = [int(i) for i in ix if seen[i] >= p.min_rows]
            now = {i: weight(i) for i in own}
            g = 1 / (1 + math.exp(-(b + sum(now.values())))) - y
            for i in own:
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / p.alpha * now[i]
                n[i] += g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / p.alpha * b
            bn += g * g
            b = -bz * p.alpha / (p.beta + math.sqrt(bn))
    assert np.allclose(w, [weight(i) for i in range(64)]) and abs(bias - b) < 1e-9 and 0 < (w != 0).sum() < 64
    assert w[41] > 0 > w[43]


def test_subword_sgd_against_plain_loops():
    """Forward and backward passes written out by hand give the same folded scores."""
    rng = random.Random(29)
    p = quality.SubwordParams(bits=5, dim=3, epochs=2)
    examples = []
    for _ in range(30):
        y = int(rng.random() < 0.4)
        ix = np.array(sorted({rng.randrange(24) for _ in range(4)} | {30 if y else 31}), np.int32)
        examples.append((y, ix, np.full(len(ix), 1 / len(ix), np.float32)))
    fold, bias = quality.fit_arrays(examples, p)
    gen = np.random.default_rng(p.seed)
    table = gen.uniform(-1 / p.dim, 1 / p.dim, (32, p.dim)).astype(np.float32).astype(float)
    rate = (sum(y for y, _, _ in examples) + 0.5) / 31
    out, b = np.zeros((2, p.dim)), np.log(np.array([1 - rate, rate], np.float32)).astype(float)
    weight = [math.sqrt(0.5 / (1 - rate)), math.sqrt(0.5 / rate)]
    done = 0
    for _ in range(p.epochs):
        for k in gen.permutation(30):
            y, ix, share = examples[k]
            lr = p.rate * (1 - done / (p.epochs * 30))
            done += 1
            hidden = sum(s * table[i] for i, s in zip(ix, share.astype(float)))
            e = np.exp(out @ hidden + b)
            g = (e / e.sum() - np.eye(2)[y]) * weight[y] * lr
            back = g[0] * out[0] + g[1] * out[1]
            for c in range(2):
                out[c] = out[c] - g[c] * hidden
                b[c] -= 0.1 * g[c]
            norm = sum(float(s) ** 2 for s in share)
            for i, s in zip(ix, share.astype(float)):
                table[i] = table[i] - s / norm * back
    assert np.allclose(fold, table @ (out[1] - out[0]), atol=1e-3) and abs(bias - (b[1] - b[0])) < 1e-3
    assert fold[30] > 0 > fold[31]


def test_decontamination_of_scattered_copies(spark):
    """Items whose sentences lie far apart in long documents, by size: what of all pairs above the threshold is found."""
    rng = random.Random(37)
    text = lambda n: [f"q{rng.randrange(50_000)}" for _ in range(n)]
    items, docs = [], []
    for k in range(60):
        item = text(rng.choice([9, 14, 24, 60, 150]))
        items.append((k, " ".join(item)))
        whole = k % 2 == 0  # whole, or in two halves with 300 words between them
        cut = len(item) if whole else len(item) // 2
        docs.append((k, " ".join(text(400) + item[:cut] + text(300) + item[cut:] + text(2000))))
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    expected = {(d, i) for d, t in docs for i, x in items if len(shingle_set(t) & shingle_set(x)) >= 0.75 * len(shingle_set(x))}
    assert found <= expected and {(k, k) for k in range(0, 60, 2)} <= found
    assert len(found) >= 0.9 * len(expected), (len(found), len(expected))


def test_decontamination_of_large_scattered_items(spark):
    """Long items of which each sentence of 25 words stands far from the next one."""
    rng = random.Random(53)
    text = lambda n: [f"q{rng.randrange(10**6)}" for _ in range(n)]
    items, docs = [], []
    for k in range(24):
        item = text([500, 1200, 3000][k % 3])
        items.append((k, " ".join(item)))
        docs.append((k, " ".join(w for a in range(0, len(item), 25) for w in item[a : a + 25] + text(200))))
    docs += [(100 + k, " ".join(text(n))) for k, n in enumerate([3, 40, 300, 5000])] + [(200, items[0][1][: len(items[0][1]) // 2])]
    found = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(k, k) for k in range(24)}


def test_suffix_dedup_of_so_many_words(spark):
    """Repeated runs of fewer words than ``min_words`` stay, and so does the length of a text that loses nothing."""
    rng = random.Random(54)
    word = lambda n: "".join(rng.choice("abcdefgh") for _ in range(n))
    many, few = " ".join(word(4) for _ in range(60)), " ".join(word(11) for _ in range(25))
    alone = lambda: "-".join(word(6) for _ in range(20))
    own = [(1, f"{alone()} {many} {alone()}", 7), (2, f"{alone()} {many}", 7), (3, f"{alone()} {few} {alone()}", 7), (4, f"{few} {alone()}", 7), (5, f"{few} {alone()} {many}", 7), (6, None, 7)]
    docs = spark.createDataFrame(own, "doc_id long, text string, n_chars long")
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in suffix_dedup.remove(docs, suffix_dedup.DedupParams(length=250, min_words=51)).collect()}
    assert {i: v for i, v in left.items() if i in (3, 4, 6)} == {i: (t, n) for i, t, n in own if i in (3, 4, 6)}
    for i, t, _ in own:
        if i in (1, 2, 5):
            assert many[20:-20] not in left[i][0] and left[i][1] == len(left[i][0]) and (few in left[i][0]) == (i == 5)


def test_suffix_texts_lie_in_the_shared_folder(spark, docs, monkeypatch):
    """The bucketed table of texts is no table of the warehouse, which may be local to a machine."""
    inner, seen = suffix_dedup._repeats, []

    def watched(texts, scratch, *rest):
        seen.extend(texts.inputFiles())
        return inner(texts, scratch, *rest)

    monkeypatch.setattr(suffix_dedup, "_repeats", watched)
    suffix_dedup.query(docs).count()
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert seen and all(f.removeprefix("file://").startswith(root) for f in seen)
