"""Approximate nearest neighbours by cosine: cross-polytope hashing with multiprobe tables and exact reranking."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import bound_batches, forget, written


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of each row, scaled to keep lengths; the row length is a power of two."""
    n, h = x.shape[1], 1
    while h < n:
        y = x.reshape(len(x), -1, 2, h)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], axis=2).reshape(len(x), n)
        h *= 2
    return x / x.dtype.type(np.sqrt(n))


@lru_cache(maxsize=8)
def _signs(count: int, size: int) -> np.ndarray:
    return np.random.default_rng(4711).choice(np.array([-1.0, 1.0], np.float32), (count, 3, size))


def rotated(x: np.ndarray, which: int, count: int) -> np.ndarray:
    """H D3 H D2 H D1 x: a pseudo-rotation, a different one for each of ``count``. Rows are padded to a power of two."""
    size = padded(x.shape[1])
    y = np.zeros((len(x), size), np.float32)
    y[:, : x.shape[1]] = x
    for d in _signs(count, size)[which]:
        y = hadamard(y * d)
    return y


def padded(dimension: int) -> int:
    return 1 << max(0, (dimension - 1).bit_length())


def settings(rows: int, dimension: int, tables: int) -> tuple[int, int]:
    """Hashes of a table, concatenated, and probes of a query in it, for so many rows: cells that a query looks into are a share of all that falls with the rows to the power 0.3, and hashes are as many as that takes."""
    axes, share = 2 * padded(dimension), min(1.0, 0.17 * (2000 / max(rows, 1)) ** 0.3)
    hashes = 1
    while share * axes**hashes / tables < 8 and axes**hashes < 2**50:
        hashes += 1
    return hashes, min(axes**hashes, max(1, round(share * axes**hashes / tables)))


def cells(unit: np.ndarray, table: int, tables: int, hashes: int) -> np.ndarray:
    """The cell of each row in a table: for each hash the nearest signed axis after its pseudo-rotation."""
    cell = np.zeros(len(unit), np.int64)
    for h in range(hashes):
        y = rotated(unit, table * hashes + h, tables * hashes)
        cell = cell * (2 * y.shape[1]) + np.argmax(np.concatenate([y, -y], axis=1), axis=1)
    return cell


def probes(unit: np.ndarray, table: int, tables: int, hashes: int, count: int) -> np.ndarray:
    """The ``count`` nearest cells of each row, nearest first: those whose axes lose least against the nearest ones, in squares summed over the hashes."""
    cell, loss = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1), np.float32)
    for h in range(hashes):
        y = rotated(unit, table * hashes + h, tables * hashes)
        both = np.concatenate([y, -y], axis=1)
        near = np.argsort(-both, axis=1, kind="stable")[:, :count]
        height = np.take_along_axis(both, near, axis=1)
        sums = (loss[:, :, None] + ((height[:, :1] - height) ** 2)[:, None, :]).reshape(len(unit), -1)
        joint = (cell[:, :, None] * both.shape[1] + near[:, None, :]).reshape(len(unit), -1)
        best = np.argsort(sums, axis=1, kind="stable")[:, :count]
        cell, loss = np.take_along_axis(joint, best, axis=1), np.take_along_axis(sums, best, axis=1)
    return cell


def bucket(cell: np.ndarray, table: int, dimension: int) -> np.ndarray:
    """One number for a cell of a table, spread over 64 bits. Two cells with the same one would be searched together."""
    return (cell * np.int64(1 << 12) + table) * np.int64(-7046029254386353131) + np.int64(dimension)


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows as bytes, with the scale of each and how far off they are at most: the length of what rounding left."""
    scale = np.abs(unit).max(axis=1) / 127
    code = np.rint(unit / scale[:, None]).astype(np.int8)
    return code, scale, np.sqrt(((unit - code * scale[:, None]) ** 2).sum(axis=1)) + 1e-6


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # first, so that large components don't overflow
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def best_first(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """Rows that may be among the k best, given bounds of their scores."""
    return np.flatnonzero(high >= np.partition(low, len(low) - k)[len(low) - k]) if len(low) > k else np.arange(len(low))


def _by_dimension(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Dimension, rows and vectors of a batch, one dimension after the other."""
    data = batch.column("v")
    lengths = np.diff(data.offsets.to_numpy())
    values, starts = data.values.to_numpy(), data.offsets.to_numpy()[:-1]
    for d in np.unique(lengths):
        rows = np.flatnonzero(lengths == d)
        yield int(d), rows, values[starts[rows][:, None] + np.arange(d)]


def nearest(vectors: DataFrame, *, k: int = 5, query_every: int = 50, tables: int = 40, part_rows: int = 200_000, part_cells: int = 20_000) -> DataFrame:
    """The k nearest of each query found: query_id, rank (from 1), vec_id, score (cosine in double precision on the given vectors).

    Queries are the rows whose vec_id is divisible by ``query_every``; candidates are all rows but those with the query's own id; ties
    go to the smaller vec_id. Vectors that are null, zero, or hold null or non-finite components take no part; nor do rows without an
    id. Of rows with equal ids, equal vectors are one; other ones compete, and the best stands. An empty table gives no rows.

    Equal vectors are searched once, and of the rows that have one, only those with the k + 1 smallest ids can be among a query's
    nearest. Every other row is in one cell of each of ``tables`` tables, and goes there as bytes, a byte a component; a query goes once
    to each part of the cells that it looks into, with the list of them. Parts hold about ``part_rows`` rows; a cell with more than
    ``part_cells`` rows is cut by hash over several. A part returns the candidates that may be among the best, as far as bytes can
    tell; only what may be among the best of all parts is fetched and compared exactly. A query that finds too few looks into all
    cells of one table, so it meets every row.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0")
    good = good.where("NOT exists(v, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity')) AND exists(v, x -> x <> 0)")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [None] * batch.num_rows
            for _, rows, x in _by_dimension(batch):
                for r, one in zip(rows, np.ascontiguousarray(x)):
                    keys[r] = hashlib.blake2b(one.tobytes(), digest_size=16).digest()
            yield batch.append_column("key", pa.array(keys, pa.binary()))

    rows = good.mapInArrow(keyed, "vec_id long, v array<double>, key binary")
    rows = written(rows.groupBy("key", "vec_id").agg(F.any_value("v").alias("v")), "vectors")
    ranked = rows.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("nth") <= k + 1)
    candidates = written(ranked.select("key", "vec_id", "v"), "candidates")
    asked = rows.where(F.col("vec_id") % query_every == 0)
    queries = written(asked.groupBy("key").agg(F.any_value("v").alias("v")), "queries")
    shapes = candidates.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 0)
    scratch: list[DataFrame] = []
    total, dimension = shapes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("d")).first()

    def found(asking: DataFrame, tables: int, hashes: int, count: int) -> DataFrame:
        """key (of the query), vec_id, score: all that may be among the k + 1 best of what the probes meet."""
        parts = max(1, -(-total * tables // part_rows))

        def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("vec_id").to_numpy()
                for d, at, x in _by_dimension(batch):
                    unit = unit_rows(x)
                    code, scale, error = coded(unit)
                    codes = pa.array([c.tobytes() for c in code], pa.binary())
                    for t in range(tables):
                        yield pa.RecordBatch.from_pydict({"bucket": bucket(cells(unit, t, tables, hashes), t, d), "vec_id": ids[at], "code": codes, "scale": scale, "error": error})

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for d, at, x in _by_dimension(batch):
                    keys, unit = batch.column("key").take(pa.array(at)), unit_rows(x)
                    for t in range(tables):
                        near = bucket(probes(unit, t, tables, hashes, count), t, d)
                        yield pa.RecordBatch.from_pydict({"bucket": near.ravel(), "key": keys.take(pa.array(np.repeat(np.arange(len(at)), near.shape[1])))})

        table = written(candidates.mapInArrow(index, "bucket long, vec_id long, code binary, scale double, error double"), "index")
        crowded = table.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > part_cells).selectExpr("bucket", f"CAST(ceil(n / {part_cells}) AS INT) AS cuts")
        crowded = written(crowded, "crowded")  # as many rows as there are such cells
        scratch.extend((table, crowded))
        part = f"pmod(xxhash64(bucket, cut), {parts})"
        here = table.join(crowded, "bucket", "left").withColumn("cut", F.expr("CASE WHEN cuts IS NULL THEN 0 ELSE CAST(pmod(xxhash64(vec_id), cuts) AS INT) END"))
        here = here.selectExpr(f"{part} AS part", "bucket", "vec_id", "code", "scale", "error")
        looks = asking.select("key", "v").mapInArrow(probe, "bucket long, key binary").join(crowded, "bucket", "left")
        looks = looks.withColumn("cut", F.expr("explode(sequence(0, coalesce(cuts, 1) - 1))")).groupBy("key", F.expr(part).alias("part")).agg(F.collect_set("bucket").alias("buckets"))
        looks = looks.join(asking.select("key", "v"), "key")  # a vector a part, not a probe
        both = here.withColumn("kind", F.lit(0)).unionByName(looks.withColumn("kind", F.lit(1)), allowMissingColumns=True).select("part", "kind", "bucket", "vec_id", "code", "scale", "error", "key", "buckets", "v")
        met = both.repartition("part").sortWithinPartitions("part", "kind", "bucket").mapInArrow(meet, "key binary, vec_id long, low double, high double")
        met = met.groupBy("key", "vec_id").agg(F.max("low").alias("low"), F.max("high").alias("high"))
        w = Window.partitionBy("key")
        sure = F.max(F.when(F.col("nth") == k + 1, F.col("low"))).over(w)
        met = met.withColumn("nth", F.row_number().over(w.orderBy(F.col("low").desc(), "vec_id"))).withColumn("sure", sure).where("sure IS NULL OR high >= sure")
        last = met.select("key", "vec_id").join(candidates.select("vec_id", F.col("v").alias("b")), "vec_id").join(asking.select("key", F.col("v").alias("a")), "key").where("size(a) = size(b)")
        return last.mapInArrow(exact, "key binary, vec_id long, score double").groupBy("key", "vec_id").agg(F.max("score").alias("score"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a part, in order of their buckets, then the queries that look into it."""
        now, blocks, stored = None, [], None
        for batch in batches:
            part = batch.column("part").to_numpy()
            for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(part)) + 1):
                if part[at[0]] != now:
                    now, blocks, stored = part[at[0]], [], None
                some = batch.slice(int(at[0]), len(at))
                kind = some.column("kind").to_numpy()
                n = int((kind == 0).sum())
                if n:
                    blocks.append(some.slice(0, n))
                if n < len(at) and blocks:
                    if stored is None:
                        stored = _Stored(blocks)
                    yield from stored.search(some.slice(n), k + 1)

    hashes, count = settings(total, dimension or 1, tables)
    best = written(found(queries, tables, hashes, count), "nearest")
    enough = best.groupBy("key").agg(F.count("vec_id").alias("n")).where(F.col("n") > k).select("key")
    lacking = queries.join(enough, "key", "left_anti")
    if not lacking.isEmpty():
        lacking = written(lacking, "lacking")
        best = written(best.join(lacking.select("key"), "key", "left_anti").unionByName(found(lacking, 1, 1, 2 * padded(dimension))), "nearest")
    each = asked.select(F.col("vec_id").alias("query_id"), "key").join(best, "key").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    out = each.selectExpr("query_id", "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank", "vec_id", "score").where(F.col("rank") <= k)
    forget(candidates, queries, *scratch)
    return out


class _Stored:
    """The indexed rows of a part, sorted by bucket."""

    def __init__(self, blocks: list[pa.RecordBatch]):
        rows = pa.Table.from_batches(blocks).combine_chunks()
        self.bucket, self.ids, self.scale, self.error = (rows.column(c).to_numpy() for c in ("bucket", "vec_id", "scale", "error"))
        code = rows.column("code").combine_chunks()
        self.length = pc.binary_length(code).to_numpy()
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(code.to_pylist()), np.int8)

    def search(self, queries: pa.RecordBatch, k: int) -> Iterator[pa.RecordBatch]:
        out: dict[str, list] = {c: [] for c in ("key", "vec_id", "low", "high")}
        for key, buckets, v in zip(queries.column("key").to_pylist(), queries.column("buckets"), queries.column("v")):
            wanted = np.sort(buckets.values.to_numpy())
            first, last = np.searchsorted(self.bucket, wanted, "left"), np.searchsorted(self.bucket, wanted, "right")
            size = last - first
            rows = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            x = v.values.to_numpy()
            rows = rows[self.length[rows] == len(x)]
            if not len(rows):
                continue
            rows = rows[np.argsort(self.ids[rows], kind="stable")]  # one may be met in several cells, and an id may have several vectors
            ids, first = np.unique(self.ids[rows], return_index=True)
            q = unit_rows(x[None, :])[0].astype(np.float32)
            code = self.bytes[self.start[rows][:, None] + np.arange(len(x))]
            score, error = (code.astype(np.float32) @ q) * self.scale[rows], self.error[rows]
            low, high = np.maximum.reduceat(score - error, first), np.maximum.reduceat(score + error, first)
            keep = best_first(low, high, k)
            out["key"] += [key] * len(keep)
            for c, values in (("vec_id", ids), ("low", low), ("high", high)):
                out[c] += values[keep].tolist()
        yield pa.RecordBatch.from_pydict({"key": pa.array(out["key"], pa.binary()), "vec_id": pa.array(out["vec_id"], pa.int64()), "low": pa.array(out["low"], pa.float64()), "high": pa.array(out["high"], pa.float64())})


def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = np.array([exact_cosine(a.values.to_numpy()[None, :], b.values.to_numpy()[None, :])[0] for a, b in zip(batch.column("a"), batch.column("b"))])
        yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "vec_id": batch.column("vec_id"), "score": pa.array(score, pa.float64())})


def exact_cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine, the same for a pair whatever batch it stands in; scaled first, so large components don't overflow."""
    a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))
