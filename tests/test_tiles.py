"""Comparisons of near points block by block, against the same on all pairs."""

import numpy as np
import pytest
from gaugeflow.operators import neighbors, profiles, registration, solve, surfaces, tiles
from pyspark.sql import functions as F


@pytest.fixture
def points(spark):
    g = np.random.default_rng(31)
    x = np.concatenate([g.normal(size=(300, 3)) * 0.1, g.normal(size=(30, 3)), np.repeat(g.normal(size=(1, 3)) * 0.1, 5, axis=0)])
    rows = [(i, i % 3 if i % 50 else None, *map(float, p)) for i, p in enumerate(x)] + [(1000, 1, float("nan"), 0.0, 0.0), (1001, 1, None, 0.0, 0.0), (0, 2, 0.01, 0.0, 0.0)]
    return spark.createDataFrame(rows, "point_id long, case_id int, x double, y double, z double")


def test_sums_within_a_radius_are_those_of_all_pairs(points, monkeypatch):
    monkeypatch.setattr(neighbors, "POINTS_A_TILE", 16)
    found = {r.point_id: r for r in neighbors.radius_sums(points, 0.15).collect()}
    pairs = neighbors.radius_pairs(points, 0.15, places=True)
    sums = pairs.groupBy("point_id").agg(F.count(F.lit(1)).alias("n"), F.sum("nx").alias("nx"), F.sum(F.col("ny") * F.col("nz")).alias("ny_nz")).collect()
    assert len(found) == len(sums) > 250
    for r in sums:
        assert found[r.point_id].n == r.n and found[r.point_id].nx == pytest.approx(r.nx) and found[r.point_id]["ny_nz"] == pytest.approx(r["ny_nz"])


def test_residuals_of_planes_are_those_of_all_pairs_without_making_a_table_of_them(points, monkeypatch):
    planes = solve.local_planes(neighbors.radius_pairs(points, 0.15, places=True))
    near = neighbors.radius_pairs(points, 0.15, points.join(planes, "point_id"), keep=("case_id", "normal", "mean", "n"), places=True)
    want = profiles.plane_residuals(near, None, ["case_id"], 4).orderBy("case_id").toPandas()
    monkeypatch.setattr(neighbors, "radius_pairs", None)
    monkeypatch.setattr(neighbors, "POINTS_A_TILE", 16)
    got = profiles.plane_residuals_within(points, 0.15, ["case_id"], 4).orderBy("case_id").toPandas()
    assert list(got.columns) == list(want.columns) and len(got) == 3
    for c in want.columns:
        assert np.allclose(got[c], want[c], rtol=1e-9, atol=1e-12), c
    assert profiles.plane_residuals_within(points.limit(0), 0.15, ["case_id"], 4).count() == 0
    assert profiles.plane_residuals_within(points, 0.15, [], 4).first().residuals > want["residuals"].sum() - 1


def test_bounds_hold_the_percentiles():
    g = np.random.default_rng(5)
    r, scale = np.concatenate([g.normal(size=999), np.zeros(40)]), 20.0
    bins, counts = np.unique(np.floor(r * scale).astype(int), return_counts=True)
    middle = np.median(r)
    for name, lo, hi, part, below, spans in profiles._bounds(bins, counts, scale):
        kind, share = profiles.RESIDUALS[name]
        values = r if kind == "signed" else np.abs(r - (middle if kind == "mad" else 0))
        at = np.floor(r * scale)
        kept = np.sort(values[np.any([(at >= s["a"]) & (at <= s["b"]) for s in spans], axis=0)])
        assert kept[lo - below] * (1 - part) + kept[hi - below] * part == pytest.approx(np.quantile(values, share), abs=1e-12)
        assert len(kept) < 400


def test_a_tile_holds_a_bounded_number_of_queries(spark, points):
    place = tuple(F.col(c) for c in "xyz")
    near = neighbors.whole(points)
    rows = tiles.deal(near, near, place, place, 0.05, 16).groupBy("block", "part").agg(F.count("q").alias("q")).collect()
    assert sum(r.q for r in rows) == near.count() and max(r.q for r in rows) < 48


def test_only_what_may_be_closest_leaves_a_task(spark, monkeypatch):
    g = np.random.default_rng(8)
    monkeypatch.setattr(surfaces, "POINTS_A_TILE", 64)
    p, a = g.normal(size=(300, 3)), g.normal(size=(500, 1, 3)) + g.normal(size=(500, 3, 3)) * 0.05
    a[0], a[7] = [[-9, -9, -1], [9, -9, -1], [0, 9, -1]], a[8]  # one far larger than a block, two in the same place
    names = [f"{t}{c}" for t in "abc" for c in "xyz"]
    points = spark.createDataFrame([("k", i, *map(float, x)) for i, x in enumerate(p)] + [("other", 0, 0.0, 0.0, 0.0), ("k", 999, float("nan"), 0.0, 0.0)], "s string, point_id long, x double, y double, z double")
    triangles = spark.createDataFrame([("k", i, *map(float, x.ravel())) for i, x in enumerate(a)], "s string, fid long, " + ", ".join(f"{n} double" for n in names))
    seen, search = [], tiles.closest_candidates
    monkeypatch.setattr(tiles, "closest_candidates", lambda *r: seen.append(search(*r)) or seen[-1])
    monkeypatch.setattr(surfaces, "forget", lambda *_: None)
    got = surfaces.closest_on_surface(points, triangles, 0.1, on=("s",)).toPandas().set_index("point_id").sort_index()
    i, j = (v.ravel() for v in np.meshgrid(range(300), range(500), indexing="ij"))
    d = surfaces.triangle_distances(list(p[i].T), [list(a[j, k].T) for k in range(3)]).reshape(300, 500)
    assert list(got.index) == list(range(300)) and list(got["fid"]) == list(d.argmin(axis=1)) and np.array_equal(got["distance"], d.min(axis=1))
    assert 300 <= sum(s.count() for s in seen) < 3000  # of 150,000 pairs


def test_dense_clouds_far_off_meet_in_few_rounds(spark):
    x, a = np.random.default_rng(12).normal(size=(1500, 3)) * 0.3, 0.05
    turn = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    cloud = lambda v: spark.createDataFrame([tuple(map(float, p)) for p in v], "x double, y double, z double")
    got = registration.closest_points(cloud(x @ turn.T + (0.1, -0.08, 0.06)), cloud(x), voxel=1e-6, reach=2.0, rounds=10).first()
    assert got.converged and got.n == 1500 and got.rmse < 1e-12 and np.allclose(np.reshape(got.r, (3, 3)), turn.T)
