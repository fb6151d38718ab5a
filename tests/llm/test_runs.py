"""Runs against a definition-by-definition search, over many small alphabets, and the query's digests against one text at a time."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest
from gaugeflow.llm import queries, runs

DIR = "/root/testdata/sf0.001"


def brute(t):
    n, out = len(t), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            a, b = i, j + q
            if b - a >= max(4, 2 * q) and not any(t[a + d : b] == t[a : b - d] for d in range(1, q)):
                out.append((a, b, q))
            i = max(j, i + 1)
    return sorted(out)


def some_text(r):
    kind, n = r.randrange(7), r.randrange(300)
    if kind == 0:
        return [r.randrange(2) for _ in range(n)]
    if kind == 1:
        return [int(r.randrange(5) == 0) for _ in range(n)]
    if kind == 2:  # periodic with faults
        u = [r.randrange(3) for _ in range(r.randrange(1, 50))]
        t = (u * (n // len(u) + 1))[:n]
        for _ in range(r.randrange(3)):
            if t:
                t[r.randrange(n)] = r.randrange(3)
        return t
    if kind == 3:  # stretches of one period that touch
        v, t = [r.randrange(3) for _ in range(r.randrange(1, 6))], []
        while len(t) < n:
            t += v * r.randrange(1, 12) + v[: r.randrange(len(v) + 1)]
        return t[:n]
    if kind == 4:  # Fibonacci word
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == 5:  # a square whose half is highly periodic
        v = [r.randrange(2) for _ in range(r.randrange(1, 4))]
        u = (v * 40)[: r.randrange(1, 90)]
        return u + u + u[: r.randrange(9)] + [r.randrange(2) for _ in range(r.randrange(50))]
    t = [r.randrange(50) for _ in range(n)]
    for _ in range(3):
        i, length = r.randrange(n + 1), r.randrange(1, 60)
        t = t[:i] + t[i : i + length] * r.randrange(1, 4) + t[i:]
    return t


def test_all_runs_are_found():
    r, found = random.Random(7), 0
    for _ in range(1200):
        t = some_text(r)
        want = brute(t)
        assert runs.find_runs(np.array(t, np.int64), len(t)) == want, t
        found += len(want)
    assert found > 10_000


def test_long_periods():
    r = random.Random(3)
    u = [r.randrange(10**6) for _ in range(3000)]
    assert runs.find_runs(np.array(u * 2 + u[:100], np.int64), 6100) == [(0, 6100, 3000)]
    assert runs.find_runs(np.zeros(50_000, np.int64), 50_000) == [(0, 50_000, 1)]


def report(text, doc_id, reword):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if reword and doc_id is not None and n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    own = [x for x in brute(words) if x[1] - x[0] >= max(12, 2 * x[2])]
    gone = {i for a, b, q in own for i in range(a + q, b)}
    best = min(own, key=lambda x: (x[0] - x[1], x[0], x[2]), default=None)
    best = (best[0], best[1] - best[0], best[2], 1000 * (best[1] - best[0]) // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{b - a},{q}\n" for a, b, q in own)
    kept = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(own), *best, *(hashlib.sha256(x.encode()).hexdigest() for x in (lines, kept)))


def test_query_rows_of_odd_texts(spark):
    long = " ".join(f"w{i % 7}" for i in range(3000))
    texts = [None, "", " \t\n\x0b\x0c\r ", "a", "a " * 12, "a " * 11, "x y\tz\n" * 30, "é ü\xa0ü 🙂 " * 9, long, "a b " * 5 + "c " + "a b " * 9]
    rows = [(i, t, "n", "p") for i, t in enumerate(texts * 3)] + [(None, "a " * 30, "n", "p"), (3, "same id " * 8, None, None), (3, "same id " * 8, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs string, period string")
    for reword in (False, True):
        got = [tuple(r) for r in runs.periodic_runs(docs, reword=reword).collect()]
        assert sorted(got, key=str) == sorted((report(t, i, reword) for i, t, *_ in rows), key=str)
    assert runs.periodic_runs(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_on_the_given_table(spark):
    texts = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op12_runs"](spark, DIR).collect()}
    assert len(got) == len(texts) and sum(r[1] > 0 for r in got.values()) > 10
    for r in texts:
        if len(r.text or "") < 6000:
            assert got[r.doc_id] == report(r.text, r.doc_id, True)
