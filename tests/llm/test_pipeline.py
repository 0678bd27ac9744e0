"""The pipeline's stages, each against brute force on what the stage before kept."""

import itertools
import random
import zlib

import numpy as np
import pytest
from test_text_operators import brute_components, brute_repeats, shingle_set

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def passages(text, cover, words):
    """``cover`` without its runs of fewer words."""
    out, at = bytearray(len(text)), 0
    for gone, own in itertools.groupby(cover):
        n = len(list(own))
        if gone and len(text[at : at + n].split()) >= words:
            out[at : at + n] = b"\1" * n
        at += n
    return out


def build(spark, folder):
    rng = random.Random(12)
    word = lambda: f"w{rng.randrange(4000)}"
    text = lambda n: " ".join(word() for _ in range(n))
    items = [text(40) for _ in range(4)]
    passage = text(120)
    docs = [(k, text(80) + (" vile vile" if k % 5 == 0 else "")) for k in range(300)]
    docs += [(400 + k, docs[1][1]) for k in range(6)] + [(410 + k, docs[2][1] + f" tail{k}") for k in range(4)]
    docs += [(420 + k, text(60) + " " + passage + " " + text(60)) for k in range(5)]
    short = [text(51 + 3 * k) for k in range(4)]
    docs += [(450 + k, text(70) + " " + short[k % 4] + " " + text(40 + k)) for k in range(12)]
    docs += [(430 + k, text(300) + " " + items[k] + " " + text(100)) for k in range(4)]
    phrase = " ".join(word() + "longer" for _ in range(40))
    docs += [(470 + k, f"{text(60)} {phrase} {text(50)}") for k in range(2)]
    docs += [(440, None), (441, ""), (442, text(9000))]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items, short, phrase


def test_stages(spark, tmp_path):
    docs, items, short, phrase = build(spark, str(tmp_path))
    first = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, before = first.columns, {i: t for i, t in docs}
    kept = [before]
    frame = first
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        frame = stage(spark, frame, str(tmp_path))
        assert frame.columns == columns, name
        path = f"{tmp_path}/stage-{k}"
        frame.write.parquet(path)
        frame = spark.read.parquet(path)
        kept.append({r["doc_id"]: r["text"] for r in frame.collect()})
    toxic, near, cut, clean = kept[1:]
    assert len(kept[1]) == frame.sparkSession.read.parquet(f"{tmp_path}/stage-0").count()
    vile = {i for i, t in docs if "vile" in (t or "")}
    assert len(vile & set(toxic)) <= 6 and len(set(before) - vile - set(toxic)) <= 6
    assert set(near) == {c for _, _, c in brute_components(sorted(toxic.items()))}
    ids = sorted(near)
    texts = [(near[i] or "").encode() for i in ids]
    cover = [passages(b, c, corpus_pipeline.PASSAGE_WORDS) for b, c in zip(texts, brute_repeats(texts, corpus_pipeline.PASSAGE_BYTES))]
    left = {i: bytes(x for x, m in zip(b, c) if not m).decode() for i, b, c in zip(ids, texts, cover) if not (b and all(c))}
    assert phrase in left[470] and phrase in left[471]
    assert {i: t or "" for i, t in cut.items()} == left
    assert all(len(x.encode()) < 400 for x in short) and not any(x in (t or "") for t in cut.values() for x in short)
    hit = {i for i, t in cut.items() if any(len(shingle_set(q) & shingle_set(t)) >= 0.75 * len(shingle_set(q)) for q in items)}
    assert hit and set(clean) == set(cut) - hit

    from tokenizers import Tokenizer

    from pathloom.llm import packing

    tok = Tokenizer.from_file(packing.default_tokenizer())
    found = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).toPandas()
    for i, own in found.groupby("doc_id"):
        tokens = np.array(tok.encode(clean[i] or "", add_special_tokens=False).ids + [1], "<u4")
        own = own.sort_values("start")
        assert own.length.sum() == len(tokens) and all(zlib.crc32(tokens[a : a + n].tobytes()) == c for a, n, c in zip(own.start, own.length, own.ids_crc32))
    assert set(found.doc_id) == set(clean)
    whole = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(map(tuple, whole[found.columns].to_numpy())) == sorted(map(tuple, found.to_numpy()))


def test_stages_odd_rows(spark, tmp_path):
    """Nulls in every column, repeated rows, an id with two texts, columns whose names the operators use themselves; then no rows at all."""
    docs, *_ = build(spark, str(tmp_path))
    names = ["key", "row", "runs", "kept", "score", "predicted", "class", "root", "row_key", "shard", "component_id"]
    rows = [(i, t, "en", None if i % 2 else "s", None, *("x" for _ in names)) for i, t in docs[1:60:5]]
    rows += [rows[0]] * 3 + [(rows[1][0], rows[2][1], *rows[1][2:]), (None, rows[3][1], *[None] * (3 + len(names))), (None, None, *[None] * (3 + len(names))), (7001, "", "en", "s", 0, *names), (7002, " \n ", "en", "s", 3, *names)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    odd = spark.createDataFrame(rows, schema)
    for given in (odd, odd.limit(0)):
        frame = given
        for name, stage in corpus_pipeline.STAGES[:-1]:
            frame = stage(spark, frame, str(tmp_path))
            assert frame.columns == odd.columns, name
        kept = frame.collect()
        packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in kept}
        if given is odd:
            # of one text under ids 6 and 11 the row of 6 stays, beside the other text of 6; the null id's copy goes, its null text stays
            assert sorted(r["doc_id"] for r in kept if r["doc_id"] is not None) == sorted([*({r[0] for r in rows if r[0] is not None} - {11}), 6])
            assert sum(r["doc_id"] is None for r in kept) == 1
            assert all(r["key"] in (None, "x", "key") for r in kept)
    assert not kept and not packed
