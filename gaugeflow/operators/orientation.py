"""Normals that agree in direction over a point cloud: signs carried along a minimum spanning tree of the neighbour graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..sources.scratch import forget, written
from .quantiles import exact_percentiles


def _jumped(picks: DataFrame) -> DataFrame:
    """component, root, parity: where picks (component, parent, parity) lead in the end. Roots are their own parents; paths are halved in each round."""
    scratch = []
    while True:
        up = picks.select(F.col("component").alias("parent"), F.col("parent").alias("next"), F.col("parity").alias("next_parity"))
        step = written(picks.join(up, "parent").select("component", F.col("next").alias("parent"), F.when(F.col("parent") == F.col("next"), F.col("parity")).otherwise(F.col("parity") * F.col("next_parity")).alias("parity"), (F.col("parent") != F.col("next")).alias("moved")), "jumps")
        scratch.append(step)
        picks = step.drop("moved")
        if step.where("moved").isEmpty():
            break
    forget(*scratch[:-1])
    return picks.withColumnRenamed("parent", "root")


def spanning_signs(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component, sign for nodes (node) and edges (a, b, weight, parity): signs that agree with the parities (1 or -1) of a minimum spanning forest.

    In each round every component takes its lightest edge to another (ties: smallest ends), and components joined so become one, the
    parity of each path carried along (Boruvka). Components at least halve in number, so rounds grow with the logarithm of the nodes; edges
    inside a component leave. A component's lightest edge is an aggregate with partial results, and all tables are written to the
    shared folder. The component is that of the smallest node id among those that were roots; the sign is relative to it.
    """
    now = written(nodes.select("node").distinct().select("node", F.col("node").alias("component"), F.lit(1).alias("sign")), "signs")
    # What an edge says of its ends' components: ca, cb and the parity between their roots.
    open_edges = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", F.col("parity").cast("int").alias("parity")).groupBy("a", "b").agg(F.min(F.struct("weight", "parity")).alias("e")).select("a", "b", "e.weight", "e.parity", F.col("a").alias("ca"), F.col("b").alias("cb")), "open-edges")
    while not open_edges.isEmpty():
        ends = F.array(F.struct(F.col("ca").alias("component"), F.col("cb").alias("other")), F.struct(F.col("cb").alias("component"), F.col("ca").alias("other")))
        lightest = open_edges.select(F.explode(ends).alias("c"), "weight", "a", "b", "parity").groupBy("c.component").agg(F.min(F.struct("weight", "a", "b", "c.other", "parity")).alias("m"))
        lightest = written(lightest.select("component", "m.a", "m.b", F.col("m.other").alias("parent"), "m.parity"), "lightest")
        # Two components that take the same edge: the smaller one is the root. No other ring can be, as all edges are in one order.
        back = lightest.select(F.col("component").alias("parent"), F.col("parent").alias("component"), F.lit(True).alias("both"))
        root = F.coalesce("both", F.lit(False)) & (F.col("component") < F.col("parent"))
        picks = lightest.join(back, ["component", "parent"], "left").select("component", F.when(root, F.col("component")).otherwise(F.col("parent")).alias("parent"), F.when(root, 1).otherwise(F.col("parity")).alias("parity"))
        roots = _jumped(written(picks, "picks")).withColumnRenamed("parity", "turn")
        roots = written(roots, "roots")
        before, now = now, written(now.join(roots, "component", "left").select("node", F.coalesce("root", "component").alias("component"), (F.col("sign") * F.coalesce("turn", F.lit(1))).alias("sign")), "signs")
        old = open_edges
        for end in ("ca", "cb"):
            open_edges = open_edges.join(roots.withColumnsRenamed({"component": end, "root": f"root_{end}", "turn": f"turn_{end}"}), end, "left")
        moved = {end: F.coalesce(f"root_{end}", end).alias(end) for end in ("ca", "cb")}
        turned = F.col("parity") * F.coalesce("turn_ca", F.lit(1)) * F.coalesce("turn_cb", F.lit(1))
        open_edges = written(open_edges.select("a", "b", "weight", turned.alias("parity"), moved["ca"], moved["cb"]).where("ca <> cb"), "open-edges")
        forget(before, old, lightest, roots)
    return now


def orient_normals(normals: DataFrame, neighbors: DataFrame, reference: DataFrame) -> DataFrame:
    """point_id, nx, ny, nz (unit), component, turned, flipped, median_dot: normals that agree over the graph, and on the whole with a reference.

    normals: point_id, nx, ny, nz of any sign; neighbors: point_id, neighbor_id; reference: point_id, rx, ry, rz. An edge weighs 1 less the
    absolute cosine between its normals, so signs are carried where the surface is flat. Then each connected part is turned as one if the median
    cosine with the reference, over points where both have a length, is negative (``turned``; a connected graph gets one sign).
    ``flipped`` says whether a normal's sign changed in all. Points without a normal of some length are left out. Positions aren't touched.
    """
    length = V.norm(V.columns("n"))
    unit = normals.where(V.is_finite(length) & (length > 1e-12)).select("point_id", *[(F.col(f"n{c}") / length).alias(f"n{c}") for c in "xyz"])
    unit = written(unit, "unit-normals")
    side = lambda end, p: unit.select(F.col("point_id").alias(end), *[F.col(f"n{c}").alias(p + c) for c in "xyz"])
    pairs = neighbors.where("point_id <> neighbor_id").select(F.least("point_id", "neighbor_id").alias("a"), F.greatest("point_id", "neighbor_id").alias("b")).distinct()
    cosine = V.dot(V.columns("p"), V.columns("q"))
    edges = pairs.join(side("a", "p"), "a").join(side("b", "q"), "b").select("a", "b", (1 - F.abs(cosine)).alias("weight"), F.when(cosine < 0, -1).otherwise(1).alias("parity"))
    signs = spanning_signs(unit.select(F.col("point_id").alias("node")), edges)
    signed = written(unit.join(signs.withColumnRenamed("node", "point_id"), "point_id"), "signed")
    size = V.norm(V.columns("r"))
    known = signed.join(reference.where(V.is_finite(size) & (size > 1e-12)), "point_id").withColumn("dot", F.col("sign") * V.dot(V.columns("n"), V.columns("r")) / size)
    medians = exact_percentiles(known, ["component"], {"median_dot": (F.col("dot"), 0.5)})
    both = signed.join(medians, "component", "left")
    turned = F.coalesce(F.col("median_dot") < 0, F.lit(False))
    sign = F.col("sign") * F.when(turned, -1).otherwise(1)
    out = written(both.select("point_id", *[(F.col(f"n{c}") * sign).alias(f"n{c}") for c in "xyz"], "component", turned.alias("turned"), (sign < 0).alias("flipped"), "median_dot"), "oriented")
    forget(unit, signs, signed)
    return out
