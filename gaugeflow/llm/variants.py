"""Spelling variants: words one edit apart, found by walking a trie level by level as joins, and the form each word is a variant of.

The words' trie is a table of edges (node, first letter, label, child), without nodes that only hand on; nodes are hashes of prefixes. A
state (word, position, node, edits) says that a word's letters up to ``position`` lead to ``node`` with so many edits.

- States without an edit lie on the word's own path, at its nodes.
- One edit leaves the path at a node where another letter goes on: in place of the word's own, or before it. (A word that lacks a letter of
  another is found from the other's side: pairs are kept both ways.)
- States with one edit are joined with the edges on node and next letter, level by level, until the frontier is empty; those that end
  where a word ends are neighbours. Their distance is checked exactly at last.

Two words with one edit share their first or their last half. So there are two tries, of words and of reversed words, and a word leaves its path
only beyond its middle, where tries branch little: states grow with words times letters of the alphabet at most, never with pairs of words.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import bound_batches, forget, written

_RUN = re.compile("[a-zÀ-ÿ]+")
HELD = 200_000  # words that a task counts before it hands them on
_PRIME, _BASE = (1 << 61) - 1, 1_000_003_319


def _counts(batches: Iterator[pa.RecordBatch], least_length: int, delete_one_in: int) -> Iterator[pa.RecordBatch]:
    held: Counter[str] = Counter()

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            start = zlib.crc32(f"{doc_id}:".encode())
            for word, n in Counter(_RUN.findall((text.as_py() or "").encode().lower().decode())).items():
                if len(word) < least_length:
                    continue
                if delete_one_in and doc_id is not None:
                    h = zlib.crc32(word.encode(), start)
                    if h % delete_one_in == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                held[word] += n
            if len(held) >= HELD:
                yield rows()
                held.clear()
    yield rows()


def word_counts(docs: DataFrame, *, least_length: int = 6, least_count: int = 5, delete_one_in: int = 0) -> DataFrame:
    """word, n: maximal runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lower-cased, of ``least_length`` code points, that come ``least_count`` times.

    ``delete_one_in`` misspells on purpose: where it divides h, the crc32 of ``<doc_id>:<word>``, the letter h % length goes (never for a null
    id). A null text has no word.
    """
    bound_batches(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(lambda b: _counts(b, least_length, delete_one_in), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word, read from either end, its prefixes from the middle on: word_id, reversed, depth, node, next letter (empty at the end)."""
    for batch in batches:
        ids, words, out = batch.column(0).to_pylist(), batch.column(1), ([], [], [], [], [])
        for word_id, word in zip(ids, words, strict=True):
            word = word.as_py()
            for back, letters in ((False, word), (True, word[::-1])):
                node, middle = 1 + back, (len(letters) - 1) // 2
                for depth in range(len(letters) + 1):
                    if depth >= middle:
                        for column, value in zip(out, (word_id, back, depth, node, letters[depth : depth + 1]), strict=True):
                            column.append(value)
                    if depth < len(letters):
                        node = (node * _BASE + ord(letters[depth])) % _PRIME
            if len(out[0]) >= 100_000:
                yield _path_rows(out)
                out = ([], [], [], [], [])
        yield _path_rows(out)


def _path_rows(out: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays(list(map(pa.array, out, types)), names=["word_id", "back", "depth", "node", "next"])


def _trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes on each word's path with the rest of the word behind them: word_id, back, depth, length, node, rest; edges: node, first, label, child, ends)."""
    paths = written(words.select("word_id", "word").mapInArrow(_paths, "word_id long, back boolean, depth int, node long, next string"), "paths")
    nodes = paths.groupBy("node").agg(F.min("next").alias("a"), F.max("next").alias("z")).where("a = '' OR a <> z").select("node")
    own = paths.join(nodes, "node", "left_semi").groupBy("word_id", "back").agg(F.sort_array(F.collect_list(F.struct("depth", "node"))).alias("path"))
    letters = F.when(F.col("back"), F.reverse("word")).otherwise(F.col("word"))
    own = own.join(words, "word_id").select("word_id", "back", letters.alias("letters"), F.posexplode("path").alias("i", "at"), "path")
    below = F.get("path", F.col("i") + 1)
    rest = F.expr("substring(letters, at.depth + 1)")
    walked = written(
        own.select("word_id", "back", "at.depth", "at.node", F.length("letters").alias("length"), rest.alias("rest"), below["node"].alias("child"), (below["depth"] - F.col("at.depth")).alias("step")),
        "walked",
    )
    label = F.expr("substring(rest, 1, step)")
    ends = F.when(F.col("step") == F.length("rest"), F.col("word_id"))
    edges = walked.where("child IS NOT NULL").groupBy("node", F.expr("substring(rest, 1, 1)").alias("first"), label.alias("label"), "child").agg(F.max(ends).alias("ends"))
    edges = written(edges, "edges")
    forget(paths)
    return walked.select("word_id", "back", "depth", "length", "node", "rest"), edges


def neighbours(words: DataFrame) -> DataFrame:
    """word_id, near_id, both ways: words that differ by exactly one inserted, deleted or replaced code point. words: word_id (unique), word."""
    walked, edges = _trie(words)
    # A word and one as long as it or longer by a letter share half of its letters, from the front or (half rounded up) from the back.
    starts = walked.where("depth >= CASE WHEN back THEN (length + 1) DIV 2 ELSE length DIV 2 END")
    left = starts.join(edges, "node")
    replaced = "first > substring(rest, 1, 1) AND rest <> '' AND startswith(substring(rest, 2), substring(label, 2))"
    put_in = "first <> substring(rest, 1, 1) AND startswith(rest, substring(label, 2))"
    edited = F.expr(f"""filter(array(
        CASE WHEN {replaced} THEN struct(depth + length(label) AS position, substring(rest, length(label) + 1) AS rest) END,
        CASE WHEN {put_in} THEN struct(depth + length(label) - 1 AS position, substring(rest, length(label)) AS rest) END), s -> s IS NOT NULL)""")
    frontier = left.select("word_id", F.explode(edited).alias("s"), F.col("child").alias("node"), "ends")
    frontier = written(frontier.select("word_id", "s.position", "node", F.lit(1).alias("edits"), "s.rest", "ends"), "frontier")
    found, scratch = [], [frontier]
    while True:
        found.append(frontier.where("rest = '' AND ends IS NOT NULL").select("word_id", F.col("ends").alias("near_id")))
        on = frontier.where("rest <> ''").select("word_id", "position", "node", "edits", "rest", F.expr("substring(rest, 1, 1)").alias("first"))
        walk = on.join(edges, ["node", "first"]).where("startswith(rest, label)")
        frontier = written(walk.select("word_id", F.expr("position + length(label)").alias("position"), F.col("child").alias("node"), "edits", F.expr("substring(rest, length(label) + 1)").alias("rest"), "ends"), "frontier")
        scratch.append(frontier)
        if frontier.isEmpty():
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = pairs.distinct()
    one, other = (words.select(F.col("word_id").alias(i), F.col("word").alias(w)) for i, w in (("word_id", "one"), ("near_id", "other")))
    checked = pairs.join(one, "word_id").join(other, "near_id").where(F.levenshtein("one", "other", 1) == 1)
    both = F.explode(F.array(F.struct("word_id", "near_id"), F.struct(F.col("near_id").alias("word_id"), F.col("word_id").alias("near_id"))))
    out = written(checked.select(both.alias("p")).select("p.*"), "neighbours")
    forget(*scratch, edges)
    return out


def spelling_forms(counts: DataFrame, *, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for ``counts`` (word, n; words are distinct).

    A word's form is its neighbour of largest n (ties: smallest in code-point order) if that is ``times`` its own n or more; its root is
    where forms lead in the end, the word itself if it has none. As n grows by ``times`` at each step there are no rings and few
    steps, which are doubled in each round. Words without a neighbour have n_near 0. An empty table gives an empty one.
    """
    spark = counts.sparkSession
    bound_batches(spark)
    words = written(counts.select(F.monotonically_increasing_id().alias("word_id"), "word", "n"), "words")
    near = neighbours(words)
    other = words.select(F.col("word_id").alias("near_id"), F.struct((-F.col("n")).alias("less"), F.col("word").alias("form"), F.col("word_id").alias("form_id")).alias("of"))
    best = near.join(other, "near_id").groupBy("word_id").agg(F.count("*").alias("n_near"), F.min("of").alias("of"))
    forms = written(words.join(best, "word_id", "left").select("word_id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("of.less") >= times * F.col("n"), F.col("of")).alias("of")), "forms")
    steps = written(forms.where("of IS NOT NULL").select("word_id", F.col("of.form_id").alias("root_id"), F.col("of.form").alias("root")), "steps")
    scratch = [words, near, steps]
    while True:
        # What a root's own root is, where it has one.
        further = steps.select(F.col("word_id").alias("root_id"), F.col("root_id").alias("next_id"), F.col("root").alias("next"))
        both = steps.join(further, "root_id", "left")
        moved = written(both.select("word_id", F.coalesce("next_id", "root_id").alias("root_id"), F.coalesce("next", "root").alias("root"), F.col("next_id").isNotNull().alias("moved")), "steps")
        scratch.append(moved)
        steps = moved.drop("moved")
        if moved.where("moved").isEmpty():
            break
    out = forms.join(steps.select("word_id", "root"), "word_id", "left")
    out = written(out.select("word", F.col("of.form").alias("form"), F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("of.less")).alias("form_n")), "variants")
    forget(*scratch, forms)
    return out
