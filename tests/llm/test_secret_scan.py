"""The secret scan against plain patterns, planted random strings and strings that are none."""

import hashlib
import random
import re
import string

import pytest

from pathloom.llm import secret_scan
from pathloom.llm.secret_scan import SecretParams, is_random

SCHEMA = "doc_id long, text string, lang string, spans string, key string, kind string"


def plain_base(text):
    """The three patterns one after another, without any preselection."""
    text, out = text or "", []
    word = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
    for m in re.finditer(word + "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[1]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(11)
    keys = ["".join(rng.choice(string.ascii_letters + string.digits) for _ in range(n)) for n in (24, 32, 40, 64) for _ in range(25)]
    return [k for k in keys if re.search("[0-9]", k)]


def rows(planted):
    rng = random.Random(5)
    digits = "".join(rng.choice("0123456789abcdef") for _ in range(60))
    out = [
        None, "", " ", "PassWord = hunter2", "passwd:'short", "passwd:'longer1 token=a.b-c=d secret", "api-key=1234567 apikey=1234567 api_key\": \"1234567",
        "toKen = 1234567 paſſword=1234567",  # letters that only Unicode folds to k and s
        "AKIA" + "Q" * 15 + " AKIA" + "Q" * 16 + " xAKIA" + "7" * 30 + "z", "AKIAAKIA" + "B" * 14, digits[:23], "é" + digits[:24] + "é ñ " + digits, "x" + digits[:30] + "g" + digits[30:],
        "token = \"" + digits[:40] + "\" and the rest", "password=password=secretsecret token: token: tokens", "ä" * 3000 + " token=" + digits[:30], digits * 2000,
        "secret\t=1234567 secret =  \"1234567", "token=", "token", digits[:24], digits[24:48],
    ]
    out += [f"the key is {k}, and more" for k in planted[:5]]
    return [(i, t) for i, t in enumerate(out)] + [(None, "token=1234567"), (3, out[3]), (3, out[3])]


def test_base_spans_are_those_of_the_patterns(spark, planted):
    own = rows(planted)
    docs = spark.createDataFrame([(i, t, "en", "s", "k", "x") for i, t in own], SCHEMA).repartition(3)
    got = sorted((r.asDict() for r in secret_scan.query(docs).collect()), key=str)
    want = []
    for i, t in own:
        base = plain_base(t)
        counts = {f"n_{k}": sum(x.startswith(k) for x in base) for k in ("assign", "access", "hex")}
        want.append({"doc_id": i, **counts, "base_sha256": hashlib.sha256(",".join(base).encode()).hexdigest()})
    bare = sorted(({k: v for k, v in r.items() if k not in ("spans", "n_random")} for r in got), key=str)
    assert bare == sorted(want, key=str)
    for r in got:  # the spans are the patterns' and the method's, in order
        kept = [x for x in r["spans"].split(",") if x and not x.startswith("random")]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == r["base_sha256"]
        starts = [int(x.split(":")[1]) for x in r["spans"].split(",") if x]
        assert starts == sorted(starts) and len([x for x in r["spans"].split(",") if x.startswith("random")]) == r["n_random"]


def test_a_run_ends_with_its_row():
    import pyarrow as pa

    half = "0123456789abcdef01"
    assert list(secret_scan.column_spans(pa.array([half, half, None, "", half + "abcdef"]), SecretParams())) == [[], [], [], [], [(0, "hex", 24)]]


def test_random_strings_are_found_and_words_are_not(planted):
    p = SecretParams()
    assert sum(is_random(k, p) for k in planted) >= 0.97 * len(planted)
    rng = random.Random(2)
    for n in secret_scan.DIGESTS:
        for letters in ("0123456789abcdef", "0123456789ABCDEF"):
            assert not is_random("".join(rng.choice(letters) for _ in range(n)), p)
    for name in (
        "550e8400-e29b-41d4-a716-446655440000", "img_550e8400-e29b-41d4-a716-446655440000", "sha256-oqVuAfXRKap7fdgcCY5uykM6R9GqQ8K", "getElementsByTagNameNS2", "the_quick_brown_fox_jumps",
        "application/x-www-form-urlencoded", "src/main/java/org/apache/spark/sql2", "2024-01-02T03-04-05-000000", "12345678901234567890123", "Donaudampfschifffahrtsgesellschaft", "a" * 50, "-" * 80, "/" * 40,
        "thationonenrereinshthhaer", "linux-x86_64-gnu-2-31-4ubuntu",
    ):
        assert not is_random(name, p), name


def test_long_runs_cost_their_length(planted):
    long = "".join(planted) * 300
    text = f"x {long} y"
    assert secret_scan.spans_of(text, [(2, 2 + len(long))], SecretParams()) == [(2, "random", 2 + len(long))]


def test_the_method_adds_to_the_patterns(spark, planted):
    k = planted[30]
    texts = [f"see {k}== end", f"token={k}", f"é{k}", f"src=data:image/png;base64,{k}", f"“{k}”"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in secret_scan.query(docs).collect()}
    assert got == {0: f"random:4:{6 + len(k)}", 1: f"assign:0:{6 + len(k)}", 2: "", 3: "", 4: f"random:1:{1 + len(k)}"}


def test_redact_keeps_all_else(spark, planted):
    texts = [f"a {planted[3]} b", None, "", "token=\"1234567\" AKIA" + "A" * 16, "nothing here"]
    docs = spark.createDataFrame([(i, t, "en", "s", "k", "x") for i, t in enumerate(texts)], SCHEMA)
    out = secret_scan.redact(docs)
    assert out.schema == docs.schema
    got = {r["doc_id"]: r.asDict() for r in out.collect()}
    assert [got[i]["text"] for i in range(5)] == ["a [random] b", None, "", "[assign]\" [access]", "nothing here"]
    assert all(r["spans"] == "s" and r["kind"] == "x" for r in got.values())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.query(docs).collect() == [] and secret_scan.redact(docs).collect() == []
