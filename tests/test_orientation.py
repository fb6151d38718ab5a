"""Signs over a minimum spanning forest against Kruskal's, and normals of surfaces whose signs were thrown at random."""

import numpy as np
from gaugeflow.operators import neighbors, orientation, solve


def kruskal(nodes, edges):
    """Signs relative to the smallest node of each tree, and the trees."""
    parent = {n: (n, 1) for n in nodes}

    def find(n):
        sign = 1
        while parent[n][0] != n:
            n, s = parent[n]
            sign *= s
        return n, sign

    for _, a, b, parity in sorted(edges):
        (ra, sa), (rb, sb) = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = (min(ra, rb), sa * sb * parity)
    return {n: find(n) for n in nodes}


def test_signs_of_random_graphs(spark):
    g = np.random.default_rng(3)
    for n, m, weights in ((40, 60, 1000), (120, 100, 3), (60, 400, 2), (1, 0, 1)):
        edges = {}
        for a, b in g.integers(0, n, (m, 2)).tolist():
            if a != b:
                edges[min(a, b), max(a, b)] = (float(g.integers(weights)), int(g.choice([-1, 1])))
        rows = [(a, b, w, p) if i % 2 else (b, a, w, p) for i, ((a, b), (w, p)) in enumerate(edges.items())] + [(0, 0, 0.0, -1)]
        want = kruskal(range(n), [(w, a, b, p) for (a, b), (w, p) in edges.items()])
        got = {r.node: (r.component, r.sign) for r in orientation.spanning_signs(spark.range(n).withColumnRenamed("id", "node"), spark.createDataFrame(rows, "a long, b long, weight double, parity int")).collect()}
        assert got.keys() == want.keys()
        trees, first = {}, {}
        for k, (root, sign) in want.items():
            trees.setdefault(root, set()).add(k)
            component, own = got[k]
            assert first.setdefault(root, (component, sign * own)) == (component, sign * own)  # the same tree, signs alike or all contrary
        assert len({c for c, _ in first.values()}) == len(trees)


def test_random_flips_are_undone(spark):
    g = np.random.default_rng(5)
    u, v = g.random(400) * 2 * np.pi, g.random(400) * 2 - 1
    sphere = np.stack([np.sqrt(1 - v * v) * np.cos(u), np.sqrt(1 - v * v) * np.sin(u), v], 1)
    flat = np.stack([g.random(150) * 3 + 9, g.random(150) * 3, np.zeros(150)], 1)
    points = np.concatenate([sphere, flat])
    true = np.concatenate([sphere, np.tile([0.0, 0.0, 1.0], (150, 1))])
    thrown = g.choice([-1, 1], 550)
    cloud = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "point_id long, x double, y double, z double")
    normals = spark.createDataFrame([(i, *map(float, t * s * 2.5)) for i, (t, s) in enumerate(zip(true, thrown))] + [(900, 0.0, 0.0, 0.0)], "point_id long, nx double, ny double, nz double")
    noisy = true + g.normal(size=true.shape) * 0.8
    reference = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(noisy)], "point_id long, rx double, ry double, rz double")
    near = neighbors.knn(cloud, 8, 0.3)
    got = orientation.orient_normals(normals, near, reference).toPandas().sort_values("point_id")
    assert len(got) == 550 and np.allclose(got[["nx", "ny", "nz"]], true, atol=1e-12)
    assert (got.flipped.to_numpy() == (thrown < 0)).all() and got.component.nunique() == 2

    against = orientation.orient_normals(normals, near, reference.selectExpr("point_id", "-rx AS rx", "-ry AS ry", "-rz AS rz")).toPandas().sort_values("point_id")
    assert np.allclose(against[["nx", "ny", "nz"]], -true, atol=1e-12)


def test_estimated_normals_of_a_surface(spark):
    rows = [(50 * i + k, i * 0.1, k * 0.1, 0.3 * np.sin(i * 0.2) * np.cos(k * 0.3)) for i in range(20) for k in range(20)]
    cloud = spark.createDataFrame([(a, *map(float, b)) for a, *b in rows], "point_id long, x double, y double, z double")
    near = neighbors.knn(cloud, 10, 0.2)
    at = cloud.selectExpr("point_id AS neighbor_id", "x AS nx", "y AS ny", "z AS nz")
    planes = solve.local_planes(near.join(at, "neighbor_id")).selectExpr("point_id", "normal[0] AS nx", "normal[1] AS ny", "normal[2] AS nz")
    got = orientation.orient_normals(planes, near, cloud.selectExpr("point_id", "0D AS rx", "0D AS ry", "-2D AS rz")).collect()
    assert len(got) == 400 and all(r.nz < -0.5 for r in got)
