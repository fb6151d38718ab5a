"""Spelling variants against brute force: all pairs of words on small alphabets, and deletions by hand on the smallest given table."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from gaugeflow.llm import queries, variants

DIR = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows, least_length=6, least_count=5, one_in=199):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = run.translate(LOWER)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if one_in and doc_id is not None and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    return {w: n for w, n in total.items() if len(w) >= least_length and n >= least_count}


def near_of(words):
    """Neighbours by what is left of each word when a letter goes: equal rests at one position are replacements, else insertions."""
    near, holes = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            if rest in words:
                near[w].add(rest)
                near[rest].add(w)
            holes[i, rest].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    return near


def brute(words, times=5):
    near, out = near_of(words), {}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= times * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (w, form[w], root, n, len(near[w]), words.get(form[w]))
    return out


def test_neighbours_on_small_alphabets(spark):
    r = random.Random(11)
    for letters, most, size in (("ab", 9, 300), ("aé", 4, 40), ("abcdef", 7, 600), ("a", 40, 30)):
        words = {"".join(r.choice(letters) for _ in range(r.randrange(1, most + 1))) for _ in range(size)}
        counts = {w: r.choice([1, 1, 1, 2, 5, 6, 25, 30, 125, 700]) for w in words}
        got = {x.word: tuple(x) for x in variants.spelling_forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()}
        assert got == brute(counts)


def test_odd_documents(spark):
    rows = [(1, None, "f"), (2, "", "f"), (3, "Colour colouR COLOUR colour colour colour " * 5, "f"), (4, "color " * 6 + "colours " * 6, "f"), (None, "Übergang übergang Übergang " * 3, "f"), (4, "ÜBERGANG colorÿ×÷ " * 9, None), (5, "x" * 50_000 + " " + ("y" * 30_000 + " ") * 5 + ("y" * 30_001 + " ") * 26, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string")
    for one_in in (0, 2):
        words = counted([x[:2] for x in rows], one_in=one_in)
        counts = variants.word_counts(docs, delete_one_in=one_in)
        assert {x.word: x.n for x in counts.collect()} == words
        got = {x.word: tuple(x) for x in variants.spelling_forms(counts).collect()}
        assert got.keys() == words.keys() and len(words) > 4
        assert {w: v for w, v in got.items() if len(w) < 100} == {w: v for w, v in brute({w: n for w, n in words.items() if len(w) < 100}).items()}
        if not one_in:
            assert got["y" * 30_000][1:] == ("y" * 30_001, "y" * 30_001, 5, 1, 26)
    assert variants.spelling_forms(variants.word_counts(docs.limit(0))).count() == 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_query_on_the_given_table(spark):
    rows = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text").collect()
    want = brute(counted(rows))
    got = {r.word: tuple(r) for r in queries.QUERIES["op11_variants"](spark, DIR).collect()}
    assert got == want and len(want) > 500 and sum(w[1] is not None for w in want.values()) > 10
