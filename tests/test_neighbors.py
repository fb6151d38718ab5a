"""Nearest neighbours against brute force, where points are dense, far apart, or many at one place."""

import numpy as np
import pytest
from gaugeflow.operators import geometry, neighbors


def brute(points, k):
    ids, at = np.array([p[0] for p in points]), np.array([p[1:] for p in points])
    out = {}
    for i, p in zip(ids, at):
        d = np.sqrt(((at - p) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if ids[j] != i][:k]
        out[int(i)] = [(int(ids[j]), float(d[j])) for j in order]
    return out


def got_of(df, k, radius):
    out = {}
    for r in sorted(neighbors.knn(df, k, radius).collect(), key=lambda r: (r.point_id, r.rank)):
        out.setdefault(r.point_id, []).append((r.neighbor_id, r.distance))
        assert r.rank == len(out[r.point_id])
    return out


def test_nearest_of_dense_and_sparse_points(spark):
    g = np.random.default_rng(1)
    some = np.concatenate([g.random((150, 3)), g.random((200, 3)) * 0.001 + 0.5, g.random((30, 3)) * 50, np.tile([[3.0, 3.0, 3.0]], (60, 1)), np.tile([[0.5, 0.5, 0.5]], (20, 1)), [[-0.0, 0.0, 0.0], [0.0, 0.0, 0.0]]])
    points = [(int(i), *map(float, p)) for i, p in zip(g.permutation(len(some)), some)]
    df = spark.createDataFrame(points, "point_id long, x double, y double, z double")
    want = brute(points, 5)
    for radius in (0.2, 5.0):
        got = got_of(df, 5, radius)
        assert got.keys() == want.keys()
        for i in want:
            assert [n for n, _ in got[i]] == [n for n, _ in want[i]] and np.allclose([d for _, d in got[i]], [d for _, d in want[i]], atol=1e-12), i
    few = df.where("point_id < 3")
    assert {len(v) for v in got_of(few, 5, 0.1).values()} == {2}
    assert got_of(df.limit(1), 5, 0.1) == {} and got_of(df.limit(0), 5, 0.1) == {}


def test_rows_written_grow_with_points_in_a_dense_cloud(spark, monkeypatch):
    made = []
    real = neighbors.written

    def counted(df, name):
        out = real(df, name)
        if name == "knn":
            made.append(out.count())
        return out

    monkeypatch.setattr(neighbors, "written", counted)
    g, per_point = np.random.default_rng(2), []
    for n in (500, 2000):
        made.clear()
        rows = [(i, *map(float, p)) for i, p in enumerate(g.random((n, 3)) * 0.01)]  # all within the start radius
        assert neighbors.knn(spark.createDataFrame(rows, "point_id long, x double, y double, z double"), 4, 0.1).count() == 4 * n
        per_point.append(sum(made) / n)
    assert per_point[1] < 1.5 * per_point[0] and per_point[1] < 15


def test_limits_on_what_is_taken_or_goes(spark):
    g = np.random.default_rng(3)
    rows = [(i, *map(float, p)) for i, p in enumerate(np.concatenate([g.random((98, 3)), [[9.0, 9, 9], [-7.0, 0, 0]]]))]
    df = spark.createDataFrame(rows, "point_id long, x double, y double, z double")
    near = neighbors.knn(df, 4, 0.3)
    kept = {r.point_id for r in neighbors.without_outliers(df, near, 3.0).collect()}
    assert kept == set(range(98))
    with pytest.raises(ValueError, match="outliers"):
        neighbors.without_outliers(df, near, 3.0, most_share=0.01)
    pairs = neighbors.radius_pairs(df, 0.5)
    capped = neighbors.nearest_of_pairs(pairs, 3).toPandas()
    want = {i: [n for n, d in near if d <= 0.5][:3] for i, near in brute(rows, 3).items()}
    for i, own in capped.groupby("point_id"):
        assert own.sort_values(["distance", "neighbor_id"]).neighbor_id.tolist() == want[i]
    assert len(capped) == sum(map(len, want.values()))
    anchors = [(0.0, 0.0, 0.0), (1.0, 1.0, 1.0)]
    n = geometry.near_any(df, ("x", "y", "z"), anchors, 0.6).count()
    assert geometry.near_any(df, ("x", "y", "z"), anchors, 0.6, least=n).count() == n > 5
    with pytest.raises(ValueError, match="fewer than"):
        geometry.near_any(df, ("x", "y", "z"), anchors, 0.6, least=n + 1)
