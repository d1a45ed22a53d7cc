import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryframe.llm import encode, spans

T0 = datetime(2025, 1, 1)
SRC = "source_id string, content string, ingested_at timestamp_ntz, c string, h long, a string, at int"


def sources(spark, rows):
    return spark.createDataFrame([(i, c, T0, "x", 1, "y", 2) for i, c in rows], SRC)


def brute(rows, n=300):
    grams = {}
    for i, c in rows:
        for p in range(len(c or "") - n + 1):
            grams.setdefault(c[p : p + n], set()).add(i)
    return {(a, b) for g in grams.values() for a in g for b in g if a < b}


def words(rng, n):
    return "".join(rng.choice("abcdefghij \n(){}äé😀") for _ in range(n))


@pytest.mark.parametrize("hot", [40, 1])
def test_pairs_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT_BLOCK", hot)
    rng = random.Random(7)
    pool = [words(rng, rng.randrange(280, 420)) for _ in range(8)]
    rows = []
    for k in range(40):
        parts = [words(rng, rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(pool)
            cut = rng.randrange(0, 120)
            parts += [p[cut : cut + rng.randrange(150, 330)], words(rng, rng.randrange(0, 90))]
        rows.append((f"s{k:02}", "".join(parts)))
    base = words(rng, 299)
    rows += [("t1", base), ("t2", base), ("t3", base + "x"), ("t4", base + "x"), ("p1", "-" * 700 + "end"), ("p2", "-" * 400 + "end"), ("p3", "ab" * 400), ("p4", "x" + "ab" * 160), ("n", None), ("e", "")]
    got = {(r[0], r[1]) for r in spans.shared_pairs(sources(spark, rows)).collect()}
    assert got == brute(rows)


def test_shares_and_redelivery(spark):
    rng = random.Random(1)
    x = words(rng, 400)
    rows = [("a", x + words(rng, 400)), ("b", x), ("b", x), ("c", None)]
    got = {r.source_id: (r.chars, r.shared_chars, r.share) for r in spans.shared_shares(sources(spark, rows)).collect()}
    assert got == {"a": (800, 400, 0.5), "b": (400, 400, 1.0), "c": (0, 0, None)}
    assert spans.shared_pairs(sources(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [40, 1])
def test_periodic_texts_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT_BLOCK", hot)
    rng = random.Random(11)
    row = words(rng, 70)
    turn = lambda n, at: (row * 40)[at : at + n]
    rows = [("a", "x" + "=" * 1000 + "y"), ("b", "u" + "=" * 350 + "v"), ("c", "0, 0, 0, " * 150), ("d", "k" + "0, 0, 0, " * 36), ("e", turn(1500, 0)), ("f", "<" + turn(310, 60) + ">"), ("g", "ab" * 90 + words(rng, 200)), ("h", "=" * 290)]
    tail = words(rng, 160)
    rows += [("i", "=" * 900 + tail), ("j", "=" * 200 + tail), ("k", "(" + turn(900, 13) + tail + ")"), ("l", "[" + turn(640, 40) + tail)]
    for k in range(12):
        unit = rng.choice([row, "ab", "-+-", words(random.Random(5), 40)])
        rows.append((f"r{k:02}", words(rng, rng.randrange(0, 90)) + (unit * 300)[rng.randrange(0, 70) :][: rng.randrange(250, 700)] + rng.choice([tail, words(rng, 50)])))
    assert {(r[0], r[1]) for r in spans.shared_pairs(sources(spark, rows)).collect()} == brute(rows)
    held = {}
    for i, c in rows:
        for p in range(len(c) - 299):
            held.setdefault(c[p : p + 300], set()).add(i)
    want = {i: len({q for p in range(len(c) - 299) if len(held[c[p : p + 300]]) > 1 for q in range(p, p + 300)}) for i, c in rows}
    assert {r.source_id: r.shared_chars for r in spans.shared_shares(sources(spark, rows)).collect()} == want


DOC = "doc_id long, text string, block long, word string"


def test_encoding_equals_the_tokenizer(spark, monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "   ", "<|endoftext|> is text", "can't  stop\r\n\r\n  \t now", "äöü 漢字 😀\u0301", "a" * 5000, "12345 678", "\x00\x1c\x85\u2028 x", "the " * 3000]
    texts += [words(rng, rng.randrange(0, 300)) for _ in range(60)]
    monkeypatch.setattr(encode, "BLOCK_CHARS", 4000)
    docs = spark.createDataFrame([(k, t, 0, "w") for k, t in enumerate(texts)] + [(None, "null id", 0, "w")], DOC).repartition(3)
    enc = encode.vocabulary(encode.TOKENIZERS)
    got = {r.doc_id: r.ids for r in encode.encode_corpus(docs).collect()}
    assert got == {**{k: enc.encode_ordinary(t or "") for k, t in enumerate(texts)}, None: enc.encode_ordinary("null id")}
    back = {r.doc_id: r.text for r in encode.decode_corpus(encode.encode_corpus(docs.where("doc_id is not null")), encode.token_bytes(spark)).collect()}
    assert back == {k: t or "" for k, t in enumerate(texts)}
    assert encode.encode_corpus(docs.limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=80))
def test_split_equals_the_tokenizers_split(text):
    import regex

    text = text.encode("utf-8", "ignore").decode()
    enc = encode.vocabulary(encode.TOKENIZERS)
    assert [i for w in regex.findall(encode.PATTERN, text) for i in enc.encode_ordinary(w)] == enc.encode_ordinary(text)


def brute_shares(rows, n=300):
    """How many characters of each record lie in a run of n that another record has."""
    grams = {}
    for i, c in rows:
        for p in range(len(c or "") - n + 1):
            grams.setdefault(c[p : p + n], set()).add(i)
    out = {}
    for i, c in rows:
        marked = bytearray(len(c or ""))
        for p in range(len(c or "") - n + 1):
            if len(grams[c[p : p + n]]) > 1:
                marked[p : p + n] = b"\1" * n
        out[i] = sum(marked)
    return out


@pytest.mark.parametrize("hot", [40, 1])
def test_shares_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(spans, "HOT_BLOCK", hot)
    rng = random.Random(11)
    pool = [words(rng, rng.randrange(280, 900)) for _ in range(6)]
    rows = []
    for k in range(25):
        parts = [words(rng, rng.randrange(0, 200))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(pool)
            at = rng.randrange(0, 120)
            parts += [p[at : at + rng.randrange(150, 700)], words(rng, rng.randrange(0, 90))]
        rows.append((f"s{k:02}", "".join(parts)))
    rows += [("p1", words(rng, 50) + "0, 0, 1, " * 400 + words(rng, 50)), ("p2", words(rng, 20) + "0, 1, 0, " * 80), ("p3", "=" * 1000), ("p4", "-" + "=" * 350), ("n", None)]
    got = {r.source_id: r.shared_chars for r in spans.shared_shares(sources(spark, rows)).collect()}
    assert got == brute_shares(rows)


def test_superseded_versions_are_not_elsewhere(spark):
    rng = random.Random(3)
    text = words(rng, 2000)
    later = text[:1000] + "?" + text[1001:]
    rows = [("a", text, T0, "x", 1, "y", 2), ("a", later, datetime(2025, 2, 1), "x", 1, "y", 2), ("b", words(rng, 900), T0, "x", 1, "y", 2)]
    got = {r.source_id: r.shared_chars for r in spans.shared_shares(spark.createDataFrame(rows, SRC)).collect()}
    assert got == {"a": 0, "b": 0}
