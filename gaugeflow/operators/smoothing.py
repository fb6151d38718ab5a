"""Smooth offsets of meshes under constraints: sparse symmetric systems by preconditioned conjugate gradients, all meshes at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import forget, written
from .mesh import unique_edges
from .quantiles import exact_percentiles

#: How firmly constraints and boundary hold, and what keeps the system regular.
CONSTRAINT, BOUNDARY, REGULAR = 2500.0, 10000.0, 1e-9


def conjugate_gradients(system: DataFrame, apply: Callable[[DataFrame], DataFrame], by: list[str], key: str, sides: int, *, tolerance: float = 1e-10, rounds: int = 1000) -> DataFrame:
    """by, key, x0.. and residual0..: solutions of A x = b for several right sides at once, for each group of ``by``.

    system: by, key, diagonal (of A, positive) and b0, b1, ..; ``apply`` takes rows (by, key, p0, ..) and returns A p as (by, key, q0, ..). A
    is symmetric and positive definite. A round is one product, written to the shared folder, and one aggregate of dot products with
    partial results; the vectors stay tables, and no round sends them to the driver to be broadcast. Each side of each group takes its own steps, and stands still once its residual is
    ``tolerance`` times the norm of b. The residuals that are returned, relative to that norm, are computed anew from x at the end.
    """
    n = range(sides)
    start = system.select(*by, key, "diagonal", *[F.col(f"b{i}") for i in n], *[F.lit(0.0).alias(f"x{i}") for i in n], *[F.col(f"b{i}").alias(f"r{i}") for i in n], *[(F.col(f"b{i}") / F.col("diagonal")).alias(f"p{i}") for i in n])
    state, scratch = start, []
    product = lambda i, a, b: F.sum(F.col(f"{a}{i}") * F.col(f"{b}{i}"))
    scaled = lambda i, a, b: F.sum(F.col(f"{a}{i}") * F.col(f"{b}{i}") / F.col("diagonal"))
    for _ in range(rounds):
        kept = written(state, "cg")
        now = written(kept.join(apply(kept.select(*by, key, *[f"p{i}" for i in n])).hint("merge"), [*by, key]), "cg")
        forget(kept, *scratch)
        scratch = [now]
        sums = now.groupBy(*by).agg(*[f.alias(f"{name}{i}") for i in n for name, f in (("pq", product(i, "p", "q")), ("rz", scaled(i, "r", "r")), ("sz", scaled(i, "r", "q")), ("tz", scaled(i, "q", "q")), ("rr", product(i, "r", "r")), ("rq", product(i, "r", "q")), ("qq", product(i, "q", "q")), ("bb", product(i, "b", "b")))])
        for i in n:
            over = F.col(f"rr{i}") > tolerance**2 * F.col(f"bb{i}")
            sums = sums.withColumn(f"alpha{i}", F.when(over, F.coalesce(F.try_divide(f"rz{i}", f"pq{i}"), F.lit(0.0))).otherwise(0.0))
            sums = sums.withColumn(f"beta{i}", F.greatest(F.lit(0.0), F.coalesce(F.try_divide(F.col(f"rz{i}") - 2 * F.col(f"alpha{i}") * F.col(f"sz{i}") + F.col(f"alpha{i}") ** 2 * F.col(f"tz{i}"), F.col(f"rz{i}")), F.lit(0.0))))
            sums = sums.withColumn(f"open{i}", over & (F.col(f"rr{i}") - 2 * F.col(f"alpha{i}") * F.col(f"rq{i}") + F.col(f"alpha{i}") ** 2 * F.col(f"qq{i}") > tolerance**2 * F.col(f"bb{i}")))
        steps = now.join(sums.select(*by, *[f"{c}{i}" for i in n for c in ("alpha", "beta")]), by)
        moved = [(F.col(f"x{i}") + F.col(f"alpha{i}") * F.col(f"p{i}")).alias(f"x{i}") for i in n]
        left = [F.col(f"r{i}") - F.col(f"alpha{i}") * F.col(f"q{i}") for i in n]
        state = steps.select(*by, key, "diagonal", *[f"b{i}" for i in n], *moved, *[r.alias(f"r{i}") for i, r in enumerate(left)], *[(r / F.col("diagonal") + F.col(f"beta{i}") * F.col(f"p{i}")).alias(f"p{i}") for i, r in enumerate(left)])
        if not sums.where(" OR ".join(f"open{i}" for i in n)).count():
            break
    found = written(state.select(*by, key, *[f"b{i}" for i in n], *[f"x{i}" for i in n]), "solved")
    forget(*scratch)
    rest = found.join(apply(found.select(*by, key, *[F.col(f"x{i}").alias(f"p{i}") for i in n])).hint("merge"), [*by, key])
    norms = rest.groupBy(*by).agg(*[F.coalesce(F.try_divide(F.sqrt(F.sum((F.col(f"b{i}") - F.col(f"q{i}")) ** 2)), F.sqrt(F.sum(F.col(f"b{i}") ** 2))), F.lit(0.0)).alias(f"residual{i}") for i in n])
    out = written(found.join(norms, by).select(*by, key, *[f"x{i}" for i in n], *[f"residual{i}" for i in n]), "solved")
    forget(found)
    return out


def normalised_laplacian(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries beside the diagonal (mesh, u, v, w) of I - D^-1/2 A D^-1/2, both ways, and nodes (mesh, vid) with ``own``: the sum of squares of each column, the diagonal's 1 included."""
    both = edges.select("mesh", F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("mesh", "e.u", "e.v")
    degree = both.groupBy("mesh", "u").agg(F.count("v").alias("degree"))
    entries = both.join(degree, ["mesh", "u"]).join(degree.withColumnsRenamed({"u": "v", "degree": "other"}), ["mesh", "v"]).select("mesh", "u", "v", (-1 / F.sqrt(F.col("degree") * F.col("other"))).alias("w"))
    entries = written(entries, "laplacian")
    squares = entries.groupBy("mesh", F.col("v").alias("vid")).agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    return entries, nodes.join(squares, ["mesh", "vid"], "left").select(*nodes.columns, (1 + F.coalesce("s", F.lit(0.0))).alias("own"))


def smooth_offsets(faces: DataFrame, nodes: DataFrame, *, tolerance: float = 1e-10) -> DataFrame:
    """mesh, vid, offset0, offset1, residual: one smooth field of two components over each mesh's region, by its bi-Laplacian.

    nodes: mesh, vid, role ('constraint', 'boundary' or 'free'), target0, target1 (of constraints), limit0, limit1 (the same in all rows of a
    mesh); they are the region, and only edges between them count. Constraints are pulled to their targets, the boundary is held at
    zero, and what is free follows smoothly. Then offset0 is held to 0..limit0, offset1 to -limit1..limit1, the boundary is zero, and so
    is what is below 1e-8. ``residual`` is the larger of the components' relative residuals before that. Meshes with fewer than three constraints or boundary
    vertices, or without an edge, are an error.
    """
    nodes = written(nodes.select("mesh", "vid", "role", "target0", "target1", "limit0", "limit1"), "nodes")
    region = nodes.select("mesh", "vid")
    edges = unique_edges(faces).select("mesh", "a", "b")
    for end in "ab":
        edges = edges.join(region.withColumnRenamed("vid", end), ["mesh", end], "left_semi")
    edges = written(edges, "region-edges")
    counts = nodes.groupBy("mesh").agg(F.count_if(F.col("role") == "constraint").alias("c"), F.count_if(F.col("role") == "boundary").alias("b")).join(edges.groupBy("mesh").agg(F.count("a").alias("e")), "mesh", "left")
    wrong = counts.where("c < 3 OR b < 3 OR e IS NULL").limit(3).collect()
    if wrong:
        raise ValueError(f"meshes need three constraints, three boundary vertices and edges: {[(r.mesh, r.c, r.b, r.e or 0) for r in wrong]}")
    entries, own = normalised_laplacian(edges, nodes)
    weight = F.when(F.col("role") == "constraint", CONSTRAINT).when(F.col("role") == "boundary", BOUNDARY).otherwise(0.0)
    pull = [F.when(F.col("role") == "constraint", CONSTRAINT * F.col(f"target{i}")).otherwise(0.0).alias(f"b{i}") for i in (0, 1)]
    held = written(own.select("mesh", "vid", weight.alias("weight"), (F.col("own") + weight + REGULAR).alias("diagonal"), *pull), "system")

    def times(p: DataFrame) -> DataFrame:
        """The Laplacian times (mesh, vid, p0, p1)."""
        met = entries.join(p.withColumnRenamed("vid", "v").hint("merge"), ["mesh", "v"]).select("mesh", F.col("u").alias("vid"), *[(F.col("w") * F.col(f"p{i}")).alias(f"p{i}") for i in (0, 1)])
        return p.unionByName(met).groupBy("mesh", "vid").agg(F.sum("p0").alias("p0"), F.sum("p1").alias("p1"))

    def apply(p: DataFrame) -> DataFrame:
        twice = times(times(p)).withColumnsRenamed({"p0": "t0", "p1": "t1"})
        return p.join(twice.hint("merge"), ["mesh", "vid"]).join(held.select("mesh", "vid", "weight").hint("merge"), ["mesh", "vid"]).select("mesh", "vid", *[(F.col(f"t{i}") + (F.col("weight") + REGULAR) * F.col(f"p{i}")).alias(f"q{i}") for i in (0, 1)])

    solved = conjugate_gradients(held, apply, ["mesh"], "vid", 2, tolerance=tolerance)
    both = solved.join(nodes, ["mesh", "vid"])
    limited = [F.least(F.greatest("x0", F.lit(0.0)), F.col("limit0")), F.least(F.greatest("x1", -F.col("limit1")), F.col("limit1"))]
    out = [F.when((F.col("role") == "boundary") | (F.abs(v) < 1e-8), 0.0).otherwise(v).alias(f"offset{i}") for i, v in enumerate(limited)]
    result = written(both.select("mesh", "vid", *out, F.greatest("residual0", "residual1").alias("residual")), "offsets")
    forget(solved, nodes, edges, entries, held)
    return result


def offset_changes(faces: DataFrame, offsets: DataFrame) -> DataFrame:
    """mesh, edges, maximum and p95: how much the offsets of neighbours (mesh, vid, offset0, offset1) differ."""
    side = lambda n: offsets.select("mesh", F.col("vid").alias(n), F.col("offset0").alias(n + "0"), F.col("offset1").alias(n + "1"))
    met = unique_edges(faces).select("mesh", "a", "b").join(side("a"), ["mesh", "a"]).join(side("b"), ["mesh", "b"]).select("mesh", F.hypot(F.col("a0") - F.col("b0"), F.col("a1") - F.col("b1")).alias("change"))
    return met.groupBy("mesh").agg(F.count("change").alias("edges"), F.max("change").alias("maximum")).join(exact_percentiles(met, ["mesh"], {"p95": (F.col("change"), 0.95)}), "mesh")
