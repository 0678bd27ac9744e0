"""WARC, chat, vectors and urls against brute force, edge cases included."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from pathloom.llm import chat, url_rules, vector_dedup, warc
from pathloom.llm.components import components
from pathloom.llm.scratch import Scratch


def test_components(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(35)] + [(300, 300 + k) for k in range(50)] + [(5, 5)]
    root = {x: x for e in links for x in e}
    for _ in range(100):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    for most in (500_000, 10):
        found = components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test"), task_links=most)
        assert {r["node"]: r["root"] for r in found.collect()} == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in links)}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "test")).count() == 0


def pages(spark):
    big, other = "<html>" + "é" * 600, "<p>" + "z" * 2000
    rows = [(k, f"http://h{k}/a", f"<html>{k}" + "y" * 1500) for k in range(30)]
    rows += [(100, "http://x\r\n/", big), (90, "http://y", big), (95, None, big), (101, "u", "small"), (102, "u", "small"), (103, "u", None), (104, "u", ""), (200, "a", other), (200, "a", other), (201, "b", "q" * 3_000_000), (None, "n", big), (None, None, None)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, shard int")


def test_warc_round_trip(spark):
    rows, df = pages(spark)
    p = warc.WarcParams(shard_bytes=20_000, file_bytes=600)
    out = [Scratch(spark, "warc-test").root for _ in range(2)]
    manifests = [warc.write(df.repartition(k + 2), o, p).toPandas().sort_values("name") for k, o in enumerate(out)]
    assert (manifests[0].sha1.to_numpy() == manifests[1].sha1.to_numpy()).all() and len(manifests[0]) > 3
    assert not [f for f in __import__("os").listdir(out[0].removeprefix("file://")) if f.startswith("_temporary")]
    got = [tuple(r) for r in warc.query(df, p).collect()]
    key = lambda i, h: (i, len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest())
    assert sorted((g[:3] for g in got), key=str) == sorted((key(i, h) for i, _, h in rows), key=str)
    largest = {}
    for i, _, h in rows:
        if h and len(h.encode()) >= 1000 and i is not None:
            largest[h] = max(largest.get(h, -1), i)
    digest = {hashlib.sha1(h.encode()).hexdigest(): i for h, i in largest.items()}
    for i, n, d, kind, to in got:
        if n >= 1000 and digest[d] != i:
            assert (kind, to) == ("revisit", digest[d])
        elif i != 200:
            assert (kind, to) == ("response", None)
    assert sorted((g[3], g[4]) for g in got if g[0] == 200) == [("response", None), ("revisit", 200)]
    assert warc.query(df.where("false")).count() == 0


def test_warc_records_are_gzip_members(spark):
    import gzip
    import os

    _, df = pages(spark)
    out = Scratch(spark, "warc-test").root
    warc.write(df, out, warc.WarcParams())
    path = out.removeprefix("file://")
    names = [n for n in os.listdir(path) if n.endswith(".warc.gz")]
    with open(f"{path}/{names[0]}", "rb") as f:
        own = list(warc.members(f))
    assert b"".join(own) == gzip.decompress(open(f"{path}/{names[0]}", "rb").read())
    fields, block = warc.parse(own[-1])
    assert fields["WARC-Type"] in ("response", "revisit") and len(block) == int(fields["Content-Length"])


def cheapest(roles, costs):
    """Least cost over every choice of action, by exhaustion."""
    best = None
    ways = [("keep",), ("merge",), *(("relabel", q) for q in range(1, 4))]
    for pick in itertools.product(ways, repeat=len(roles)):
        states = {0: 0}  # state to cost, over choices of insertions
        for role, way in zip(roles, pick):
            own = chat.ROLES.index(role) + 1 if role in chat.ROLES else 0
            after = {}
            for s, c in states.items():
                if way[0] == "merge":
                    if s:
                        after[s] = min(after.get(s, 99), c + (costs.merge if own == s else costs.merge_other))
                    continue
                q = own if way[0] == "keep" else way[1]
                if not q:
                    continue
                c += 0 if q == own else costs.relabel
                for z in (None, 1, 2, 3):
                    if (z is None and chat.follows(s, q)) or (z and chat.follows(s, z) and chat.follows(z, q)):
                        after[q] = min(after.get(q, 99), c + (costs.insert if z else 0))
            states = after
        for s, c in states.items():
            total = c + chat.endings(costs)[s][0]
            best = total if best is None or total < best else best
    return best


def legal(text):
    roles = [x.split("|>")[0] for x in text.split("<|")[1:] if not x.startswith("end|>")]
    state = 0
    for r in roles:
        if not chat.follows(state, chat.ROLES.index(r) + 1):
            return False
        state = chat.ROLES.index(r) + 1
    return state == 3


def test_chat_repair_is_cheapest_and_legal():
    rng = random.Random(3)
    costs = chat.RepairCosts()
    for _ in range(60):
        roles = [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.randint(1, 5))]
        out = chat.repair([(r, "t<|user|>") for r in roles], costs)
        assert sum(x[4] for x in out) == cheapest(roles, costs)
        assert legal("".join(x[5] for x in out)), roles
    assert chat.repair([], costs) == []


def test_chat_over_partitions(spark):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["system", "user", "assistant", "x", None]), rng.choice(["", None, "hello", "y" * 3000]), "k") for c in range(12) for t in range(rng.randint(1, 5))]
    rows += [(99, t, rng.choice(["user", "assistant", "user", "system"]), f"m{t}", "k") for t in range(200)]  # one conversation over many partitions
    rows += [(None, 1, "user", "n", "k"), (None, None, "user", "n", "k"), (3, 0, "user", "dup", "k"), (3, 0, "user", "dup", "k")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string")
    order = lambda r: tuple((x is not None, x if x is not None else 0) if k == 1 else (x is not None, x or "") for k, x in enumerate(r[:4]) if k)
    expected = []
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=order)
        expected += [(c, r[1], r[2], *x) for r, x in zip(own, chat.repair([(r[2], r[3]) for r in own]))]
    found = [tuple(r) for r in chat.format_chats(df).collect()]
    assert sorted(map(str, found)) == sorted(map(str, expected))
    assert chat.format_chats(df.where("false")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    rows = [(k, base[k], k % 3) for k in range(40)]
    rows += [(100 + k, base[1] + 0.05 * rng.standard_normal(16), 1) for k in range(30)] + [(200 + k, base[2], 2) for k in range(5)] + [(300, base[2], 0), (301, base[2], None)]
    rows += [(400, None, 1), (401, np.zeros(16), 1), (402, np.full(16, np.nan), 1), (403, np.full(16, np.inf), 1), (404, base[1][:8], 1), (405, np.array([]), 1), (200, base[2], 2), (None, base[2], 2)]
    df = spark.createDataFrame([(i, None if v is None else [float(x) for x in v], lab, "z") for i, v, lab in rows] + [(406, [1.0, None], 1, "z")], "vec_id long, embedding array<float>, label int, kept string")
    own = [(i, None if v is None else np.array(v, np.float32).astype(float), lab) for i, v, lab in rows] + [(406, None, 1)]
    ok = [v is not None and lab is not None and len(v) and np.isfinite(v).all() and v.any() for _, v, lab in own]
    n, links = len(own), np.zeros((len(own), len(own)), bool)
    for a in range(n):
        for b in range(n):
            if a != b and ok[a] and ok[b] and own[a][2] == own[b][2] and len(own[a][1]) == len(own[b][1]):
                x, y = own[a][1], own[b][1]
                links[a, b] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93
    reach = links | np.eye(n, dtype=bool)
    for _ in range(8):
        reach = reach @ reach
    expected = []
    for a in range(n):
        ids = [own[b][0] for b in np.flatnonzero(reach[a]) if own[b][0] is not None]
        c = min(ids) if ids else None
        expected.append((own[a][0], int(links[a].sum()), c, own[a][0] == c))
    for p in (vector_dedup.VectorParams(), vector_dedup.VectorParams(block=8, k=3), vector_dedup.VectorParams(block=8, k=3, tile=4)):
        assert sorted((tuple(r) for r in vector_dedup.link(df, p).collect()), key=str) == sorted(expected, key=str)
    assert vector_dedup.link(df.where("false")).count() == 0


URLS = ["http://a.example.com/en/x", "https://WWW.Example.com/en/1?q=2", "http://www.example.com/de/", "http://b.net/es/1", "http://b.net/fr", "http://net/fr/", "http://x.org/p#f", "nothing", None, "", "http://example.com", "ftp://Host.COM/a/b?c://d", "http://notexample.com/en/", "://net/es/", "http://a.net/es/\nx"]


def judged(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:cut].translate(str.maketrans(url_rules.UPPER, url_rules.LOWER)), rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])]
    fits = [(len(h + p), h + p, v) for h, p, v in url_rules.GIVEN_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))


def test_urls(spark):
    extra = [(100 + k, f"http://spam{k % 3}.test.org/buy/{k}" if k % 2 else f"http://fine.test.org/read/{k}") for k in range(40)]
    rows = [*enumerate(URLS), *extra, (0, URLS[0]), (None, URLS[6]), (7000, "https://a.b/" + "x/" * 50_000)]
    df = spark.createDataFrame([(i, u, None, 1, "x", "y", "z") for i, u in rows], "page_id long, url string, html string, host int, items string, basket string, rule string")
    labels = spark.createDataFrame([(u, bool(i % 2)) for i, u in extra[:30]] + [(None, True), (URLS[0], None), ("no url", True)], "url string, blocked boolean")
    found = url_rules.filter_urls(df, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        url = dict(rows)[r["page_id"]] if r["page_id"] is not None else URLS[6]
        host, path, rule, verdict = judged(url)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), url
        if verdict:
            assert r["verdict"] == verdict
        elif "spam" in host:
            assert r["verdict"] == "block" and r["mined_rule"] is not None, url
        elif "fine" in host or not host:
            assert r["verdict"] == "allow", url
    for none in (labels.where("false"), None):
        assert all(r["verdict"] == (judged(dict(rows)[r["page_id"]])[3] or "allow") for r in url_rules.filter_urls(df, none).collect() if r["page_id"] is not None)
    assert url_rules.filter_urls(df.where("false"), labels).count() == 0 and url_rules.filter_urls(df.where("false")).count() == 0


def brute_rules(baskets, p):
    """All rules by trying every set of tokens of every bad basket, then those that are more confident than each rule on a part of them."""
    total, bad = len(baskets), sum(b for _, b in baskets)
    need = max(-(-p.min_support * total // 1), p.min_count)
    sets = {frozenset(c) for items, b in baskets if b for n in range(1, len(items) + 1) for c in itertools.combinations(items, n)}
    rules = {}
    for x in sets:
        hold = [b for items, b in baskets if x <= set(items)]
        if sum(hold) >= need and sum(hold) >= p.min_confidence * len(hold) and sum(hold) * total >= p.min_lift * bad * len(hold):
            rules[x] = sum(hold) / len(hold)
    return rules, {x: c for x, c in rules.items() if all(c > d for y, d in rules.items() if y < x)}


def test_mined_rules_against_brute_force(spark):
    rng = random.Random(21)
    for p in (url_rules.RuleParams(min_count=3), url_rules.RuleParams(min_support=0.05, min_confidence=0.7, min_lift=1.1)):
        baskets = []
        for _ in range(150):
            items = sorted({f"t{min(rng.randrange(9), rng.randrange(9))}" for _ in range(rng.randint(1, 6))})
            baskets.append((items, rng.random() < (0.85 if {"t1", "t4"} <= set(items) or "t7" in items else 0.15)))
        every, expected = brute_rules(baskets, p)
        df = spark.createDataFrame(baskets + [([], True), (["t1"], None)], "items array<string>, blocked boolean")
        rules = url_rules.mine(df, p)
        found = {frozenset(r["items"]): r["confidence"] for r in rules.collect()}
        assert found.keys() == expected.keys() and all(abs(found[x] - c) < 1e-12 for x, c in expected.items()) and len(expected) > 2
        own = spark.createDataFrame([(k, items) for k, (items, _) in enumerate(baskets)], "basket long, items array<string>")
        judged_ = {r["basket"]: r["confidence"] for r in url_rules.judge(own, rules).collect()}
        for k, (items, _) in enumerate(baskets):
            best = max((c for x, c in every.items() if x <= set(items)), default=None)
            assert (judged_.get(k) is None) == (best is None) and (best is None or abs(judged_[k] - best) < 1e-12)


def test_url_rules_keep_company_with_topic_words(spark):
    """Words that go along with topic words are learnt, and block where no topic word is; words that go along with anything are not."""
    rows = [(k, f"https://casino-win{'.example' if k % 2 else ''}.org/en/{k}") for k in range(20)] + [(100 + k, f"https://quiet-place{k % 7}.org/en/{k}") for k in range(300)] + [(900, "https://lucky-win.org/de/1"), (901, "http://place.org/en/3")]
    found = {r["page_id"]: r for r in url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(found[k]["verdict"] == "block" for k in [*range(20), 900]) and all(found[k]["verdict"] == "allow" for k in [*range(100, 400), 901])


def test_url_rules_beyond_the_given_ones(spark):
    # thousands of sets of tokens hold the pair that a given rule blocks; the mined rules on other urls are less confident than those
    rows = [(k, "http://a.b.net/es/" + "/".join("one two three four five six seven eight nine ten".split())) for k in range(60)]
    rows += [(100 + k, f"https://shop.trash.org/buy/{k}") for k in range(20)] + [(200 + k, f"https://fine.org/read/{k}") for k in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(u, True) for _, u in rows[:60]] + [(rows[60 + k][1], k > 0) for k in range(10)] + [(rows[80 + k][1], False) for k in range(100)], "url string, blocked boolean")
    found = {r["page_id"]: r for r in url_rules.filter_urls(df, labels, url_rules.RuleParams(min_lift=1.2)).collect()}
    assert all(found[k]["verdict"] == "block" and abs(found[k]["confidence"] - 0.9) < 1e-9 for k in range(100, 120))
    assert all(found[k]["verdict"] == "allow" for k in range(200, 400))


def test_vectors_of_tight_groups_in_a_loose_one(spark):
    # each list is full of its own group of 12, all groups are linked
    rng = np.random.default_rng(6)
    axes = np.linalg.qr(rng.standard_normal((64, 21)))[0].T
    group = np.sqrt(0.95) * axes[0] + np.sqrt(0.05) * axes[1:]
    noise = rng.standard_normal((20, 12, 64))
    x = (group[:, None] + np.sqrt(0.001) * noise / np.linalg.norm(noise, axis=2, keepdims=True)).reshape(240, 64).astype(np.float32)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (y @ y.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], 0) for k in range(240)], "vec_id long, embedding array<float>, label int")
    found = vector_dedup.link(df).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in found} == {(k, int(links[k]), 0, k == 0) for k in range(240)}


def test_url_rules_of_long_urls(spark):
    # the token that tells is far down in text order; the words before it are of one url each
    words = lambda k: "/".join(f"{chr(97 + j)}{'abcdefghij'[k % 10]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k // 100]}" for j in range(26))
    rows = [(k, f"https://x.org/{words(k)}?{'zspam' if k % 2 else 'zfine'}={k}") for k in range(400)]
    labels = spark.createDataFrame([(u, bool(k % 2)) for k, u in rows[:300]], "url string, blocked boolean")
    found = url_rules.filter_urls(spark.createDataFrame(rows, "page_id long, url string"), labels, url_rules.RuleParams(min_support=0.02)).collect()
    assert all(r["verdict"] == ("block" if r["page_id"] % 2 else "allow") for r in found)


def test_vectors_recall_near_the_threshold(spark):
    """Thousands of planted pairs just above and just below the threshold: those above are found, none below is, and the audit's recall is reported."""
    rng = np.random.default_rng(31)
    def pair(cosine):
        a, b = rng.standard_normal(48), rng.standard_normal(48)
        a /= np.linalg.norm(a)
        b -= a * (a @ b)
        b /= np.linalg.norm(b)
        return a, cosine * a + np.sqrt(1 - cosine**2) * b

    rows, linked = [], []
    for k in range(3000):
        cosine = 0.931 + 0.02 * rng.random() if k % 2 else 0.929 - 0.02 * rng.random()
        a, b = pair(cosine)
        rows += [(2 * k, a.astype(np.float32).tolist(), k % 3), (2 * k + 1, b.astype(np.float32).tolist(), k % 3)]
        if k % 2:
            linked.append(2 * k)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found, recall = vector_dedup.link_audited(df, vector_dedup.VectorParams(bucket_rows=300, tile=64))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in found.collect()}
    hit = sum(got[i + 1] == (1, i) and got[i] == (1, i) for i in linked)
    assert recall >= 0.97 and hit >= 0.97 * len(linked)
    assert all(got[i] == (0, i) for k in range(0, 3000, 2) for i in (2 * k, 2 * k + 1))


def test_vectors_fail_below_the_target(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((200, 16))
    rows = [(i, (base[i % 200] + 0.1 * rng.standard_normal(16)).tolist(), 0) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    with pytest.raises(RuntimeError, match="audit"):
        vector_dedup.link(df, vector_dedup.VectorParams(k=1, tables=1, rounds=0, leaf=2, block=2, target=1.01, max_seedings=1))


def test_warc_of_a_very_long_page(spark):
    long = "<p>" + "lorem ipsum \u00e4 " * 300_000
    df = spark.createDataFrame([(1, "http://a.b/", long, "x", "y"), (2, "http://a.b/2", long, None, None), (3, None, "short", "x", "y")], "page_id long, url string, html string, record string, shard string")
    found = {r["page_id"]: r for r in warc.query(df).collect()}
    digest = hashlib.sha1(long.encode()).hexdigest()
    assert [(found[k]["payload_bytes"], found[k]["payload_digest"]) for k in (1, 2)] == [(len(long.encode()), digest)] * 2
    assert (found[1]["record_type"], found[1]["refers_to"], found[2]["record_type"], found[3]["record_type"]) == ("revisit", 2, "response", "response")


def test_vectors_of_components_of_several_tiles(spark):
    """A tight group with repeated rows, and a chain along a circle whose ends are far apart: counts from tiles' bounds are those of all pairs."""
    rng = np.random.default_rng(61)
    tight = np.eye(24)[0] + 0.01 * rng.standard_normal((150, 24))
    turn = np.arange(120) * 0.05
    chain = np.zeros((120, 24))
    chain[:, 1], chain[:, 2] = np.cos(turn), np.sin(turn)
    x = np.concatenate([tight, tight[:40], chain]).astype(np.float32)
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    links = (y @ y.T >= 0.93).sum(1) - 1
    df = spark.createDataFrame([(k, [float(v) for v in x[k]], 0) for k in range(len(x))], "vec_id long, embedding array<float>, label int")
    found = vector_dedup.link(df, vector_dedup.VectorParams(tile=16)).collect()
    assert {(r["vec_id"], r["n_links"], r["component_id"]) for r in found} == {(k, int(links[k]), 0 if k < 190 else 190) for k in range(len(x))}


def test_tile_bounds(spark):
    """A tile of its own direction decides pairs with tight ones; wide ones stay open."""
    axis = np.eye(8)
    tiles = [axis[0] + 0.01 * axis[2], axis[0] - 0.01 * axis[2]], [axis[0] + 0.02 * axis[3], axis[0]], [axis[1], axis[1] + 0.01 * axis[2]], [axis[0], axis[1]]
    rows = [(7, 4, k, 10 * k + i, 1 + i, [float(a) for a in v]) for k, own in enumerate(tiles) for i, v in enumerate(own)]
    member = spark.createDataFrame(rows, "root long, blocks long, own long, c long, w long, vec array<float>")
    found = {(r["x"], r["y"]): (r["fate"], r["wx"], r["wy"]) for r in vector_dedup._tile_pairs(member, vector_dedup.VectorParams()).collect()}
    fate = {(0, 0): "all", (0, 1): "all", (1, 1): "all", (2, 2): "all", (0, 2): "none", (1, 2): "none", (0, 3): "open", (1, 3): "open", (2, 3): "open", (3, 3): "open"}
    assert found == {k: (v, 3, 3) for k, v in fate.items()}
