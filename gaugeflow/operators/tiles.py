"""Points dealt to tiles with all that lies near them: Spark shuffles and sorts the rows, and a task compares a tile's points with what streams by, block by block in NumPy.

A tile holds a bounded number of query points; of what is compared with them a task holds a batch at a time. So pairs are neither
shuffled nor sorted, and memory doesn't depend on how many there are. What lies near is sent to each tile that it can matter to.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written
from ..sources.workers import share_package

ROWS_A_TASK = 500_000
BATCH = 8192  # rows that are compared at once
FINER = 8  # sub-cells along a block's side, by which rows of a tile are ordered


def block_size(points: DataFrame, reach: float, most: int, on: tuple[str, ...] = ()) -> float:
    """``reach`` times a power of two, a quarter at least: the largest cells that hold ``most`` points of equal ``on`` or fewer on average, counted roughly."""
    sizes = [reach * 2.0**k for k in range(-2, 11)]
    cell = lambda size: F.struct(*on, *[F.floor(F.col(c) / size).cast("long") for c in "xyz"])
    n, *cells = points.agg(F.count(F.lit(1)), *[F.approx_count_distinct(cell(s)) for s in sizes]).first()
    return max((s for s, k in zip(sizes, cells) if n <= most * k), default=sizes[0])


def _spread(v: Column) -> Column:
    """The lowest ten bits of ``v``, three apart."""
    v = v.bitwiseAND(F.lit(1023))
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _code(at: tuple[Column, ...], size: float) -> Column:
    """Places along a curve that keeps near ones together."""
    x, y, z = (_spread(F.floor(c / (size / FINER)).cast("long")) for c in at)
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def deal(queries: DataFrame, others: DataFrame, low: tuple[Column, ...], high: tuple[Column, ...], reach: float, most: int, on: tuple[str, ...] = (), size: float | None = None) -> DataFrame:
    """Rows for ``mapInArrow``, in order: block, part, kind, q, o. Each tile (block, part) has its queries first (kind 0, struct q), then all others (struct o) of equal ``on`` whose box, from ``low`` to ``high``, lies within ``reach`` of the block.

    queries: ``on``, x, y, z and more; places have to be finite. Blocks are as large as hold ``most`` queries on average, or ``size``; the queries of a fuller one are dealt to several parts.
    A box far larger than a block is sent to cells of twice the size, four times, and so on, where each query is again.
    """
    spark = queries.sparkSession
    share_package(spark)
    size = size or block_size(queries, reach, most, on)
    extent = F.lit(0.0) if low is high else F.greatest(*[h - l for l, h in zip(low, high)])  # noqa: E741
    others = others.select(F.struct(*others.columns).alias("o"), *on, *[c.alias(f"l{n}") for c, n in zip(low, "xyz")], *[c.alias(f"h{n}") for c, n in zip(high, "xyz")], F.when(extent > 2 * size, F.ceil(F.log2(extent / (2 * size)))).otherwise(0).cast("int").alias("level"))
    levels = [0] if low is high else sorted(r.level for r in others.select("level").distinct().collect())  # sizes by powers of two
    side = lambda: size * F.pow(F.lit(2.0), F.col("level"))
    grid = [f"g{c}" for c in "xyz"]
    own = queries.select(F.struct(*queries.columns).alias("q"), *on, "x", "y", "z", F.explode(F.lit(levels or [0])).alias("level"))
    own = own.withColumns({f"g{c}": F.floor(F.col(c) / side()).cast("long") for c in "xyz"})
    key = [*on, "level", *grid]
    blocks = own.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).select(*key, F.ceil(F.col("n") / most).cast("int").alias("parts"), "n")
    blocks = written(blocks.withColumn("block", F.monotonically_increasing_id()), "blocks")
    tiles, rows = (v or 0 for v in blocks.agg(F.sum("parts"), F.sum("n")).first())
    near = others
    for c in "xyz":
        near = near.withColumn(f"g{c}", F.explode(F.sequence(F.floor((F.col(f"l{c}") - reach) / side()).cast("long"), F.floor((F.col(f"h{c}") + reach) / side()).cast("long"))))
    # A table of blocks grows with the points, so it isn't sent to the driver for a broadcast.
    near = near.join(blocks.hint("merge"), key).select("block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), _code(tuple((F.col(f"l{c}") + F.col(f"h{c}")) / 2 for c in "xyz"), size).alias("code"), "o")
    own = own.join(blocks.hint("merge"), key).select("block", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), _code(tuple(F.col(c) for c in "xyz"), size).alias("code"), "q")
    tasks = max(1, min(4 * tiles, max(8 * spark.sparkContext.defaultParallelism, rows // ROWS_A_TASK)))
    return own.unionByName(near, allowMissingColumns=True).repartition(tasks, "block", "part").sortWithinPartitions("block", "part", "kind", "code").select("block", "part", "kind", "q", "o")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.StructArray]]:
    """(tile, kind, rows) of up to ``BATCH`` rows or a little more."""
    held, rows, now = [], 0, None
    for b in batches:
        keys = [b.column(i).to_numpy() for i in range(3)]
        cuts = np.flatnonzero(sum(k[1:] != k[:-1] for k in keys)) + 1
        for s, e in zip([0, *cuts], [*cuts, b.num_rows]):
            if s == e:
                continue
            this = tuple(int(k[s]) for k in keys)
            if held and (this != now or rows >= BATCH):
                yield now[:2], now[2], pa.concat_arrays(held)
                held, rows = [], 0
            held.append(b.column(4 if this[2] else 3).slice(s, e - s))
            rows, now = rows + e - s, this
    if held:
        yield now[:2], now[2], pa.concat_arrays(held)


def tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.StructArray, Iterator[pa.StructArray]]]:
    """(queries, batches of others) for each tile of ``deal``."""
    runs = _runs(batches)
    row = next(runs, None)
    while row:
        tile, mine = row[0], []
        while row and row[0] == tile and row[1] == 0:
            mine.append(row[2])
            row = next(runs, None)

        def others():
            nonlocal row
            while row and row[0] == tile:  # noqa: B023
                yield row[2]
                row = next(runs, None)

        rest = others()
        if mine:
            yield pa.concat_arrays(mine), rest
        for _ in rest:
            pass


def numbers(rows: pa.StructArray, *names: str) -> list[np.ndarray]:
    return [rows.field(n).to_numpy(zero_copy_only=False) for n in names]


def boxes(low: list[np.ndarray], high: list[np.ndarray], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The boxes of rows from each start to the next."""
    return np.stack([np.minimum.reduceat(v, starts) for v in low]), np.stack([np.maximum.reduceat(v, starts) for v in high])


def box_distances(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distances between points of the boxes a and b."""
    gap = np.maximum(0, np.maximum(b[0][:, None, :] - a[1][:, :, None], a[0][:, :, None] - b[1][:, None, :]))
    far = np.maximum(b[1][:, None, :] - a[0][:, :, None], a[1][:, :, None] - b[0][:, None, :])
    return (gap * gap).sum(axis=0), (far * far).sum(axis=0)


def squares(q: list[np.ndarray], p: list[np.ndarray]) -> np.ndarray:
    """Squared distances of all q from all p."""
    out = q[0][:, None] - p[0]
    out *= out
    for a, b in zip(q[1:], p[1:]):
        d = a[:, None] - b
        d *= d
        out += d
    return out


def square_limit(radius: float) -> float:
    """The largest square whose root is no more than the radius, so squares can be compared as their roots would be."""
    s = radius * radius
    while math.sqrt(s) > radius:
        s = math.nextafter(s, 0.0)
    while math.sqrt(math.nextafter(s, math.inf)) <= radius:
        s = math.nextafter(s, math.inf)
    return s


def near_blocks(q: list[np.ndarray], q_id: np.ndarray, starts: np.ndarray, others: Iterator[pa.StructArray], limit: float) -> Iterator[tuple[slice, list[np.ndarray], np.ndarray | None]]:
    """(rows of the queries, places of others, which of the pairs are within): the pairs of points of unequal ids up to the squared distance ``limit``; None where all are. Queries are cut at ``starts``."""
    ends = np.append(starts[1:], len(q_id))
    own = boxes(q, q, starts)
    for batch in others:
        p_id, *p = numbers(batch, "point_id", "x", "y", "z")
        cuts = np.arange(0, len(p_id), 1024)
        least, most = box_distances(own, boxes(p, p, cuts))
        for j, s in enumerate(cuts):
            part, ids = [v[s : s + 1024] for v in p], p_id[s : s + 1024]
            same = np.flatnonzero(np.isin(ids, q_id))
            for i in np.flatnonzero(least[:, j] <= limit * (1 + 1e-9)):
                rows = slice(starts[i], ends[i])
                if not len(same) and most[i, j] < limit * (1 - 1e-9):
                    yield rows, part, None
                    continue
                inside = squares([v[rows] for v in q], part) <= limit
                if len(same):
                    inside[:, same] &= q_id[rows, None] != ids[same]
                if inside.any():
                    yield rows, part, inside


def closest_candidates(rows: DataFrame, corners: list[tuple[str, str, str]], exact: Callable[..., np.ndarray], most: float) -> DataFrame:
    """From rows of ``deal``: q and o of each query and what is closest to it, up to ``most``, with all that can't be told from the closest by rounding.

    An other is a shape with ``corners`` (names of x, y, z each); ``exact(points, corners)`` gives distances of pairs. Only pairs whose box may be
    closer than what a query has already are looked at, nearest boxes first.
    """

    points = len(corners) == 1
    few, many = (64, 256) if points else (32, 128)  # rows of queries and of others that are compared at once

    def search(batches):
        for mine, others in tiles(batches):
            q = numbers(mine, "x", "y", "z")
            starts = np.arange(0, len(mine), few)
            own, best = boxes(q, q, starts), np.full(len(mine), most)
            found = []  # (queries, distances, others)
            for batch in others:
                at = [numbers(batch, *c) for c in corners]
                low, high = ([f.reduce([c[k] for c in at]) for k in range(3)] for f in (np.minimum, np.maximum))
                cuts = np.arange(0, len(batch), many)
                slack = 1e-13 * max(np.abs(v).max() for v in (*own, *low, *high))  # of rounding
                least = np.sqrt(box_distances(own, boxes(low, high, cuts))[0]) - slack
                seen = []
                for i, s in enumerate(starts):
                    here, mine_at, bound = slice(s, s + few), [v[s : s + few] for v in q], best[s : s + few].max()
                    for j in np.argsort(least[i], kind="stable"):
                        if least[i, j] > bound:
                            break
                        part = slice(cuts[j], cuts[j] + many)
                        if points:
                            gap = np.sqrt(squares(mine_at, [v[part] for v in low]))
                            np.minimum(best[here], gap.min(axis=1), out=best[here])
                        else:
                            gap = 0.0
                            for x, lo, hi in zip(mine_at, low, high):
                                d = np.maximum(np.maximum(lo[part] - x[:, None], x[:, None] - hi[part]), 0)
                                gap = gap + d * d
                            gap = np.sqrt(gap)
                        a, b = np.nonzero(gap <= best[here, None] + slack)
                        if not len(a):
                            continue
                        a, b = a + s, b + cuts[j]
                        distance = exact([v[a] for v in q], [[v[b] for v in c] for c in at])
                        np.fmin.at(best, a, distance)
                        near = distance <= best[a] * (1 + 1e-9) + slack
                        seen.append((a[near], distance[near], b[near]))
                        bound = best[here].max()
                if seen:
                    a, distance, b = (np.concatenate(v) for v in zip(*seen))
                    near = distance <= best[a] * (1 + 1e-9) + slack
                    found.append((a[near], distance[near], batch.take(pa.array(b[near]))))
            if found:
                a, distance = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                near = np.flatnonzero(distance <= best[a] * (1 + 1e-9) + slack)
                closest = pa.concat_arrays([f[2] for f in found]).take(pa.array(near))
                yield pa.RecordBatch.from_arrays([mine.take(pa.array(a[near])), closest], names=["q", "o"])

    return rows.mapInArrow(search, rows.select("q", "o").schema)
