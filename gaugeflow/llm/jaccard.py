"""N-gram Jaccard join by a forest of MinHash prefix tries, verified exactly.

Stages, each a Spark job over texts that differ:

1. Equal texts are one text; its copies are counted, not compared.
2. Each text gets a sketch of ``trees`` labels of ``depth`` bytes, a byte a MinHash value: its leaves in ``trees`` prefix tries.
3. The leaves are sorted (by ranges, so that a hot prefix is many tasks), and each learns from its neighbours in that order the longest
   prefix that it shares with any other text. Leaves that share less than the floor drop out: most texts go no further.
4. Within a node of the floor, pairs of texts are compared by their sketches. A pair counts in the first tree where it meets, with the longest
   prefix it shares in any tree. A spanning forest of the likely pairs and counts of them by that length are what is returned.
5. The matched prefix is shortened from the leaves, level by level, until the likely pairs that share it are the target share of all. A
   pair of similarity s shares k values in one of t trees with probability 1 - (1 - s^k)^t; the floor is the longest prefix for which
   that reaches the target at the threshold itself, so no corpus needs shorter ones.
6. Texts joined by likely pairs stand together. Texts are read once more, and every pair that shares a prefix of the matched length is verified
   on its exact shingle sets. Large groups are cut into blocks; a task takes a pair of blocks, counts links with a matrix product,
   and returns a row a text, never a pair.
7. Links join texts to classes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .store import bound_batches, forget, written

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MULTIPLIERS = tuple(int(x) | 1 for x in np.random.default_rng(20240607).integers(1, 2**63, 64))


class WordHashes(dict):
    """Word -> 64-bit hash, kept for up to ``most`` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= self.most:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


def shingles(text: str, n: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's runs of n words; of all its words if it has fewer; empty for a text without words."""
    words = _WORD.findall(text)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    if len(h) > n:
        run = np.zeros(len(h) - n + 1, np.uint64)
        for k in range(n):
            run = (run ^ h[k : len(h) - n + 1 + k]) * np.uint64(_MULTIPLIERS[k % 64])
            run ^= run >> np.uint64(29)
        return np.unique(run)
    if not len(h):
        return h
    return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64)


def matched_depth(threshold: float, trees: int, depth: int, recall: float) -> int:
    """The longest prefix at which a pair at the threshold meets in some tree as often as asked; 1 if none does."""
    for k in range(depth, 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


@lru_cache(maxsize=4)
def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rnd = np.random.default_rng(977)
    return rnd.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rnd.integers(0, 2**32, count, dtype=np.uint32)


def sketch(sh: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """trees x depth bytes, one of each MinHash value. Bytes of unlike texts agree once in 256 times, which adds candidates and loses none."""
    a, b = _permutations(trees * depth)
    x = (sh ^ (sh >> np.uint64(32))).astype(np.uint32)
    least = np.full(trees * depth, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 512):  # bounded memory for any length of text
        np.minimum(least, ((x[None, at : at + 512] ^ b[:, None]) * a[:, None]).min(axis=1), out=least)
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def matched_prefixes(batches: Iterator[pa.RecordBatch], depth: int, floor: int) -> Iterator[pa.RecordBatch]:
    """From leaves in order of (tree, label, text_key): those that share ``floor`` bytes or more with a neighbour, with how many they share at most, and the first and last ones, marked as edges."""
    held, held_before, first = None, 0, True

    def batch_of(rows: pa.RecordBatch, matched: np.ndarray, edge: np.ndarray) -> pa.RecordBatch:
        keep = pa.array((matched >= floor) | edge)
        out = rows.append_column("matched", pa.array(matched.astype(np.int32))).append_column("edge", pa.array(edge))
        return out.filter(keep)

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        tree = rows.column("tree").to_numpy()
        label = np.frombuffer(b"".join(rows.column("label").to_pylist()), np.uint8).reshape(-1, depth)
        same = np.logical_and.accumulate(label[1:] == label[:-1], axis=1).sum(axis=1) * (tree[1:] == tree[:-1])
        before = np.concatenate([[held_before], same])
        matched, edge = np.maximum(before[:-1], same), np.zeros(len(same), bool)
        if len(same):
            edge[0], first = first, False
            yield batch_of(rows.slice(0, len(same)), matched, edge)
        held, held_before = rows.slice(len(same)), int(before[-1])
    if held is not None:
        yield batch_of(held, np.array([held_before]), np.array([True]))


def shared_prefixes(one: np.ndarray, others: np.ndarray) -> np.ndarray:
    """others x trees: how many leading bytes of each tree's label a text (trees x depth) shares with the others."""
    return np.logical_and.accumulate(others == one, axis=2).sum(axis=2)


def likely_pairs(sketches: np.ndarray, split: int, tree: int, floor: int, least: float, threshold: float) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """Of the texts in a node of ``tree``: a spanning forest (i, j, level) of the pairs whose sketches agree in a share ``least`` or more, longest shared prefixes first, and how many pairs agree in ``threshold`` or more by level.

    Pairs that share ``floor`` bytes in an earlier tree are left to that one. All pairs if split is 0, else those of the first
    ``split`` texts with the others. The level of a pair is the longest prefix it shares in any tree.
    """
    m, trees, depth = sketches.shape
    nodes = np.zeros((m, trees, -(-floor // 8) * 8), np.uint8)
    nodes[:, :, :floor] = sketches[:, :, :floor]
    nodes = nodes.view(np.uint64)
    counts, found = np.zeros(depth + 1, np.int64), []
    for i in range(split or m - 1):
        same = (nodes[split or i + 1 :] == nodes[i]).all(axis=2)
        new = np.flatnonzero(same[:, tree] & ~same[:, :tree].any(axis=1)) + (split or i + 1)
        if not len(new):
            continue
        others = sketches[new]
        agree, level = (others == sketches[i]).mean(axis=(1, 2)), shared_prefixes(sketches[i], others).max(axis=1)
        counts += np.bincount(level[agree >= threshold], minlength=depth + 1)
        likely = agree >= least
        if likely.any():
            found.append(np.stack([np.full(likely.sum(), i), new[likely], level[likely]], axis=1))
    if not found:
        return [], counts
    pairs, root, out = np.concatenate(found), list(range(m)), []

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j, level in pairs[np.argsort(-pairs[:, 2], kind="stable")].tolist():
        x, y = top(i), top(j)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((i, j, level))
    return out, counts


def matched_level(counts: dict[int, int], floor: int, depth: int, recall: float) -> int:
    """The longest prefix that the share ``recall`` of the counted pairs have in common, and no less than ``floor``; without pairs the floor."""
    total, seen = sum(counts.values()), 0
    for k in range(depth, floor, -1):
        seen += counts.get(k, 0)
        if total and seen >= recall * total:
            return k
    return floor


def count_links(sets: list[np.ndarray], split: int, threshold: float) -> np.ndarray:
    """Which pairs link: a boolean matrix. All against all if split is 0, else the first ``split`` sets against the others.

    Only shingles that two sets share count for an intersection, so others are left out; the matrix product runs over slices of
    columns, for bounded memory.
    """
    sizes = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), sizes.astype(np.int64))
    names, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[column] > 1
    owner, column = owner[shared], column[shared]
    new = np.cumsum(n > 1) - 1
    column = new[column]
    width = int((n > 1).sum())
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    top, rest = (slice(None), slice(None)) if not split else (slice(0, split), slice(split, None))
    both = np.zeros((len(sets) if not split else split, len(sets) - split), np.float32)
    step = max(64, 2_000_000 // len(sets))
    for at in range(0, width, step):
        a, b = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), min(step, width - at)), np.float32)
        m[owner[a:b], column[a:b] - at] = 1
        both += m[top] @ m[rest].T
    union = sizes[top][:, None] + sizes[rest][None, :] - both
    links = (both >= threshold * union - 1e-9) & (union > 0)
    if not split:
        np.fill_diagonal(links, False)
    return links


def _roots(links: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix the smallest row of its component."""
    label = np.full(len(links), -1)
    for i in range(len(links)):
        if label[i] < 0:
            label[i], front = i, [i]
            while front:
                new = links[front].any(axis=0) & (label < 0)
                front = np.flatnonzero(new).tolist()
                label[front] = i
    return label


def _groups(batches: Iterator[pa.RecordBatch], key: tuple[str, ...]) -> Iterator[tuple[tuple, list[dict]]]:
    """Runs of rows with equal keys, across batches."""
    now, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in key)
            if k != now:
                if rows:
                    yield now, rows
                now, rows = k, []
            rows.append(row)
    if rows:
        yield now, rows


def near_duplicates(docs: DataFrame, *, n: int = 5, threshold: float = 0.8, trees: int = 24, depth: int = 10, recall: float = 0.999, block_texts: int = 1024, block_characters: int = 4_000_000) -> DataFrame:
    """For each distinct (doc_id, text) of ``docs``: doc_id, text_key, class_id, class_key, n_links, rows.

    class_id is the smallest doc_id of the texts joined by links, directly or through others, and class_key tells classes apart even without ids; n_links counts the other rows of
    ``docs`` whose text links to this one, equal texts included; rows is how often the pair comes. Two texts link if the Jaccard similarity
    of their sets of n-word shingles is ``threshold`` or more; a text of fewer words than n is one shingle, and texts without a word link
    only to equal ones. Null text counts as empty. Null ids are grouped like others and give a null class only where no id is known.
    An empty table gives an empty one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    floor = matched_depth(threshold, trees, depth, recall)
    values = trees * depth
    least = threshold - 6 * (threshold * (1 - threshold) / values) ** 0.5  # a pair at the threshold agrees less once in a billion times
    text = F.coalesce(docs["text"], F.lit(""))
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text)).alias("text_key"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), {}  # a task's own, so that idle workers hold none
        for batch in batches:
            keys, bodies, out = batch.column("text_key").to_pylist(), batch.column("text").to_pylist(), []
            for key, body in zip(keys, bodies):
                if key not in known:
                    if len(known) >= 20_000:
                        known.clear()
                    known[key] = sketch(sh, trees, depth).tobytes() if len(sh := shingles(body, n, hashes)) else None
                out.append(known[key])
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text_key": batch.column("text_key"), "characters": pa.array([len(x) for x in bodies], pa.int64()), "sketch": pa.array(out, pa.binary())})

    # A row a document; which of them stands for a text is left open until the classes are known.
    signed = written(keyed.select("doc_id", "text_key", "text").mapInArrow(sketched, "doc_id long, text_key binary, characters long, sketch binary"), "signed")
    members = signed.groupBy("doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows"))
    texts = signed.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id"))
    # Copies have equal sketches: the first seen in each task stands for them before anything is shuffled.
    sketches = written(signed.where("sketch IS NOT NULL").groupBy("text_key").agg(F.any_value("characters").alias("characters"), F.any_value("sketch").alias("sketch")), "sketches")

    each = f"explode(transform(sequence(0, {trees - 1}), t -> struct(t AS tree, substring(sketch, t * {depth} + 1, {depth}) AS label))) AS leaf"
    order = ["tree", "label", "text_key"]
    leaves = sketches.selectExpr("text_key", each).select("leaf.tree", "leaf.label", "text_key").repartitionByRange(*order).sortWithinPartitions(*order)
    trie = written(leaves.mapInArrow(lambda batches: matched_prefixes(batches, depth, floor), "tree int, label binary, text_key binary, matched int, edge boolean"), "trie")
    # The first and last leaf of each partition, two rows a partition, meet their neighbours across the cut.
    w = Window.orderBy(*order)
    common = f"CASE WHEN tree = other.tree THEN size(filter(sequence(1, {depth}), i -> substring(label, 1, i) = substring(other.label, 1, i))) ELSE 0 END"
    edges = trie.where("edge").withColumn("near", F.array(*[f(F.struct("tree", "label")).over(w) for f in (F.lag, F.lead)]))
    edges = edges.selectExpr(*order, f"greatest(matched, array_max(transform(near, other -> coalesce({common}, 0)))) AS matched")
    met = trie.where("NOT edge").select(*order, "matched").unionByName(edges).where(F.col("matched") >= floor)
    met = written(met.selectExpr("tree", f"substring(label, 1, {floor}) AS node", "text_key"), "met")

    def in_blocks(rows: DataFrame, by: list[str], n_blocks: str) -> DataFrame:
        """Rows of groups ``by`` once for each pair of blocks that their block is in: i <= j."""
        cut = rows.withColumn("blocks", F.expr(n_blocks)).withColumn("block", F.expr("CAST(pmod(xxhash64(text_key), blocks) AS INT)"))
        pairs = cut.withColumn("task", F.expr("explode(transform(sequence(0, blocks - 1), x -> struct(least(block, x) AS i, greatest(block, x) AS j)))"))
        keys = [*by, "i", "j"]
        return pairs.select("*", "task.i", "task.j").drop("task").repartition(*keys).sortWithinPartitions(*keys)

    def split_of(rows: list[dict], i: int, j: int) -> int:
        """Sorts the rows of a task, block i first, and says where block j starts: 0 within one block, -1 where one of two is empty."""
        if i == j:
            return 0
        rows.sort(key=lambda r: r["block"] != i)
        split = sum(r["block"] == i for r in rows)
        return split if 0 < split < len(rows) else -1

    def paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, out = np.zeros(depth + 1, np.int64), []

        def table(rows: list[tuple]) -> pa.RecordBatch:
            names = (("a", pa.binary()), ("b", pa.binary()), ("level", pa.int32()), ("pairs", pa.int64()))
            return pa.RecordBatch.from_pydict({name: pa.array(column, kind) for (name, kind), column in zip(names, zip(*rows))})

        for (tree, _, i, j), rows in _groups(batches, ("tree", "node", "i", "j")):
            split = split_of(rows, i, j)
            if split >= 0 and len(rows) > 1:
                stacked = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), trees, depth)
                forest, counts = likely_pairs(stacked, split, tree, floor, least, threshold)
                total += counts
                out += [(rows[x]["text_key"], rows[y]["text_key"], level, 0) for x, y, level in forest]
            if len(out) > 5000:
                yield table(out)
                out = []
        out += [(None, None, level, int(count)) for level, count in enumerate(total) if count]
        if out:
            yield table(out)

    sizes = met.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
    nodes = met.join(sizes, ["tree", "node"]).join(sketches.select("text_key", "sketch"), "text_key")
    forest = written(in_blocks(nodes, ["tree", "node"], f"CAST(ceil(texts / {block_texts}) AS INT)").select("tree", "node", "i", "j", "block", "text_key", "sketch").mapInArrow(paired, "a binary, b binary, level int, pairs long"), "forest")
    counts = {r["level"]: r["pairs"] for r in forest.where("a IS NULL").groupBy("level").agg(F.sum("pairs").alias("pairs")).collect()}  # a row a level
    k = matched_level(counts, floor, depth, recall)
    groups = connected_components(forest.where((F.col("level") >= k) & F.col("a").isNotNull()).select("a", "b"))

    sized = groups.join(sketches.select(F.col("text_key").alias("node"), "characters", "sketch"), "node")
    blocks = sized.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / block_texts), F.ceil(F.sum("characters") / block_characters)).cast("int").alias("n_blocks"))
    placed = sized.join(blocks, "component").withColumnRenamed("node", "text_key").join(texts, "text_key").select("text_key", "component", "n_blocks", "sketch", "copies", "first_id")
    placed = written(placed, "placed")
    forget(sketches, trie, met, forest, groups)
    # Each text once: of its copies the one with the smallest id brings the words. Spark broadcasts the ids if the written table is small.
    chosen = placed.select(F.col("text_key").alias("p_key"), F.col("first_id").alias("f"))
    bodies = keyed.join(chosen, (F.col("text_key") == F.col("p_key")) & F.col("doc_id").eqNullSafe(F.col("f")), "left_semi").select("text_key", "text").dropDuplicates(["text_key"])
    work = in_blocks(placed.join(bodies, "text_key"), ["component"], "n_blocks").select("component", "i", "j", "block", "blocks", "text_key", "text", "sketch", "copies")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        out: dict[str, list] = {c: [] for c in ("text_key", "links", "head", "whole")}
        for (_, i, j), rows in _groups(batches, ("component", "i", "j")):
            split = split_of(rows, i, j)
            if split < 0 or len(rows) < 2:
                continue
            links = count_links([shingles(r["text"], n, hashes) for r in rows], split, threshold)
            stacked = np.frombuffer(b"".join(r["sketch"] for r in rows), np.uint8).reshape(len(rows), trees, depth)
            for x in range(len(links)):  # only pairs that share a node
                at = np.flatnonzero(links[x])
                links[x, at] = (stacked[at + split][:, :, :k] == stacked[x, :, :k]).all(axis=2).any(axis=1)
            copies = np.array([r["copies"] for r in rows], np.int64)
            if split:
                full = np.zeros((len(rows), len(rows)), bool)
                full[:split, split:], full[split:, :split] = links, links.T
                links = full
            root = _roots(links)
            for r, s, h in zip(rows, links @ copies, root):
                if s:
                    for c, v in zip(out, (r["text_key"], int(s), rows[h]["text_key"], r["blocks"] == 1)):
                        out[c].append(v)
            if len(out["links"]) > 5000:
                yield pa.RecordBatch.from_pydict(out)
                out = {c: [] for c in out}
        if out["links"]:
            yield pa.RecordBatch.from_pydict(out)

    linked = written(work.mapInArrow(verify, "text_key binary, links long, head binary, whole boolean"), "links")
    # A group of one block has its classes; those of several blocks are joined across them.
    classes = linked.where("whole").select(F.col("text_key").alias("node"), F.col("head").alias("component"))
    apart = linked.where("NOT whole").select(F.col("text_key").alias("a"), F.col("head").alias("b"))
    if not apart.isEmpty():
        classes = classes.unionByName(connected_components(apart))
    found = linked.groupBy("text_key").agg(F.sum("links").alias("links"))
    joined = classes.join(placed.select(F.col("text_key").alias("node"), "first_id"), "node")
    ids = joined.groupBy("component").agg(F.min("first_id").alias("class_id"))
    found = written(classes.join(ids, "component").join(found, F.col("node") == F.col("text_key")).select(F.col("node").alias("k"), F.col("component").alias("class_key"), "class_id", "links"), "classes")
    forget(placed, linked)
    every = texts.join(found, F.col("text_key") == F.col("k"), "left").select("text_key", "copies", F.coalesce("class_key", "text_key").alias("class_key"), F.coalesce("class_id", "first_id").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return _met(members, every, "text_key", "copies", signed.count()).select("doc_id", "text_key", "class_id", "class_key", "n_links", "rows")


def _met(rows: DataFrame, about: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """``rows`` joined with ``about``, which has a row a key and says how many of the ``total`` rows have it.

    Keys with more than a ten-thousandth of all rows (1000 at least) are 10,000 at most; they are broadcast, so their rows stay where they
    are, whatever share of all they have. The others meet in an ordinary join.
    """
    hot, about = max(1000, total // 10_000), written(about, "about")
    few, rest = about.where(F.col(size) > hot), about.where(F.col(size) <= hot)
    names = F.broadcast(few.select(key))
    return rows.join(F.broadcast(few), key).unionByName(rows.join(names, key, "left_anti").join(rest, key))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each class does: the one with the smallest id, once. Columns stay as they are.

    Where a class has no id at all (all null), the smallest text by its key stays. Only the rows that go, and those that come more than
    once, are looked for: where they are few, Spark broadcasts them, and no text is moved.
    """
    found = near_duplicates(docs, **how)
    order = F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "text_key")).alias("m")
    found = written(found, "found")
    first = found.groupBy("class_key").agg(order, F.count(F.lit(1)).alias("many")).select("class_key", "many", F.col("m.doc_id").alias("keep_id"), F.col("m.text_key").alias("keep_key"))
    kept = (F.col("text_key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    seen = written(_met(found, first, "class_key", "many", found.count()).where(~kept | (F.col("rows") > 1)).select(_mark(F.col("doc_id"), F.col("text_key")).alias("mark"), kept.alias("again")), "seen")
    key = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), _mark(docs["doc_id"].cast("long"), key).alias("mark"))
    out = rows.join(seen, "mark", "left_anti").select("row.*")
    repeated = seen.where("again").select("mark")
    return out if repeated.isEmpty() else out.unionByName(rows.join(repeated, "mark", "left_semi").dropDuplicates(["mark"]).select("row.*"))


def _mark(doc_id: Column, text_key: Column) -> Column:
    """One value for an id, null included, and a text."""
    return F.concat(text_key, F.coalesce(doc_id.cast("string"), F.lit("-")).cast("binary"))
