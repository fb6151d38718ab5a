"""First hits of rays against all pairs of rays and triangles."""

import numpy as np
from gaugeflow.operators import rays


def brute(ray, triangles):
    o, d = np.array(ray[:3]), np.array(ray[3:])
    best = None
    for fid, *t in triangles:
        a, b, c = np.array(t).reshape(3, 3)
        p = np.cross(d, c - a)
        det = (b - a) @ p
        if det == 0 or not np.isfinite(det):
            continue
        q = np.cross(o - a, b - a)
        u, v, at = (o - a) @ p / det, d @ q / det, (c - a) @ q / det
        if u >= 0 and v >= 0 and u + v <= 1 and at > 0 and (best is None or at < best[1] - 1e-12):
            best = (fid, at)
    return best


def test_first_hits_against_all_pairs(spark):
    g = np.random.default_rng(2)
    middle = g.normal(size=(300, 1, 3)) * [3, 3, 1]
    size = np.concatenate([np.full(150, 0.05), np.full(140, 0.6), np.full(10, 8.0)])[:, None, None]
    triangles = [(i, *map(float, t.ravel())) for i, t in enumerate(middle + g.normal(size=(300, 3, 3)) * size)]
    triangles += [(900, *[1.0] * 9), (901, *[float("nan")] * 9)]  # without area, not finite
    some = [(*map(float, g.normal(size=3) * 6), *map(float, g.normal(size=3))) for _ in range(150)]
    some += [(0.1, 0.2, 9.0, 0.0, 0.0, -1.0), (0.1, 0.2, 9.0, 0.0, 0.0, 2.0), (-9.0, 0.05, 0.0, 3.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 0.0, 0.0), (float("inf"), 0.0, 0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 0.0, 0.0, 1.0, 0.0)]
    names = "ox double, oy double, oz double, dx double, dy double, dz double"
    r = spark.createDataFrame([(i, *x) for i, x in enumerate(some)], f"ray_id long, {names}")
    t = spark.createDataFrame(triangles, "fid long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz"))
    got = {x.ray_id: (x.fid, x.t) for x in rays.first_hits(r, t).collect()}
    want = {i: brute(x, triangles) for i, x in enumerate(some) if np.isfinite(x).all() and any(x[3:])}
    want = {i: w for i, w in want.items() if w}
    assert len(want) > 50 and got.keys() == want.keys()
    assert all(got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9 for i in want)
    assert rays.first_hits(r.limit(0), t).count() == 0 and rays.first_hits(r, t.limit(0)).count() == 0


def test_rays_meet_the_near_side_of_a_wall_across_many_cells(spark):
    wall = [(0, -50.0, -50.0, 0.0, 50.0, -50.0, 0.0, 0.0, 80.0, 0.0), (1, -50.0, -50.0, -7.0, 50.0, -50.0, -7.0, 0.0, 80.0, -7.0), (2, 0.0, 0.0, 40.0, 0.01, 0.0, 40.0, 0.0, 0.01, 40.0)]
    t = spark.createDataFrame(wall, "fid long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz"))
    r = spark.createDataFrame([(1, 0.001, 0.001, 1000.0, 0.0, 0.0, -0.5, "a"), (2, 0.5, 0.5, 30.0, 0.0, 0.0, -1.0, "a"), (3, 0.5, 0.5, -30.0, 0.0, 0.0, 1.0, "b"), (4, 0.5, 0.5, -3.0, 0.0, 0.0, -1.0, "c")], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, landmark string")
    assert {x.ray_id: (x.fid, round(x.t, 9)) for x in rays.first_hits(r, t).collect()} == {1: (2, 1920.0), 2: (0, 30.0), 3: (1, 23.0), 4: (1, 4.0)}
    near = spark.createDataFrame([("a", 0.5, 0.5, 0.02), ("b", 0.5, 0.5, -7.03), ("c", 0.5, 0.5, -7.0)], "landmark string, ex double, ey double, ez double")
    assert {(x.ray_id, x.z) for x in rays.surface_observations(r, t, near).collect()} == {(2, 0.0), (4, -7.0)}
