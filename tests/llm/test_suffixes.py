"""Repeated passages against a search of all strings, suffix order against plain sorting, and the whole given table against a dictionary of strings."""

import hashlib
import os
import random
from collections import Counter

import pytest
from gaugeflow.llm import queries, suffixes

DIR = "/root/testdata/sf0.001"


def brute(texts, length):
    """(bytes, removed, spans, sha256 of the rest) of each text."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone, upto = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                a = max(i, upto)
                upto = i + length
                gone[a:upto] = b"\1" * (upto - a)
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(t)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def got_of(spark, texts, length, ids=None):
    rows = [(i if ids is None else ids[i], t, "n", "k") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_bytes string, kept string").repartition(3)
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffixes.remove_repeats(docs, length=length).collect()), key=str)


def some_texts(r):
    words = ["ab", "ba", "abba", "c", "über", "🙂", "ddd", "the", "of"]
    passages = [" ".join(r.choice(words) for _ in range(r.randrange(5, 60))) for _ in range(6)]
    texts = []
    for _ in range(120):
        t = " ".join(r.choice([r.choice(passages), str(r.random()), r.choice(words) * r.randrange(1, 30)]) for _ in range(r.randrange(6)))
        if t and r.random() < 0.5:
            i = r.randrange(len(t))
            t = t[:i] + r.choice(["", "x", "yy"]) + t[i + r.randrange(3) :]
        texts.append(t)
    return texts + texts[:5]


@pytest.mark.parametrize("most", [1000, 3])
def test_removed_bytes_against_all_strings(spark, monkeypatch, most):
    monkeypatch.setattr(suffixes, "MOST", most)  # with 3, most groups are narrowed
    monkeypatch.setattr(suffixes, "CHUNK", 97)
    for seed, length in ((1, 32), (2, 47), (3, 100)):
        texts = some_texts(random.Random(seed))
        want = brute([t.encode() for t in texts], length)
        assert got_of(spark, texts, length) == sorted(((i, *w) for i, w in enumerate(want)), key=str)


def test_odd_rows(spark):
    passage = "".join(chr(97 + i * i % 26) for i in range(60))
    texts = [None, "", "short", passage, "x" + passage + "y", "z" * 500, "z" * 40, "é" * 60, passage, "q" + passage, None]
    ids = [1, 2, 3, 4, 5, 6, 7, None, 4, None, None]
    want = brute([(t or "").encode() for t in texts], 40)
    assert got_of(spark, texts, 40, ids) == sorted(((i, *w) for i, w in zip(ids, want, strict=True)), key=str)
    empty = spark.createDataFrame([], "doc_id int, text string")
    assert suffixes.remove_repeats(empty).count() == 0


def test_deep_shallow_order():
    r = random.Random(5)
    for _ in range(300):
        base = bytes(r.randrange(97, 99) for _ in range(60))
        some = [base[: r.randrange(61)] + bytes(r.randrange(97, 99) for _ in range(r.randrange(12))) for _ in range(r.randrange(1, 40))]
        order, prefixes = suffixes.deep_shallow(some)
        assert [some[i] for i in order] == sorted(some) and sorted(order) == list(range(len(some)))
        for k in range(1, len(some)):
            a, b = some[order[k - 1]], some[order[k]]
            assert prefixes[k] == len(os.path.commonprefix([a, b]))


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_on_the_given_table(spark):
    texts = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    want = {(r.doc_id, *w) for r, w in zip(texts, brute([(r.text or "").encode() for r in texts], 400), strict=True)}
    got = {tuple(r) for r in queries.QUERIES["op13_suffixes"](spark, DIR).collect()}
    assert got == want and sum(w[2] > 0 for w in want) > 10
