"""Smooth offsets against a dense solution, and the reduction of a ridge on made surfaces: what moves, how far, and what stays."""

import numpy as np
import pytest
from gaugeflow.operators import deformation, smoothing
from gaugeflow.operators.profiles import profile_acceptance

LANDMARKS = {"glabella": (0, -10, 1), "nasion": (0, 0, 0), "pronasale": (0, 50, 19), "subnasale": (0, 56, 0), "columella": (0, 54, 8), "labiale_superius": (0, 66, 3), "left_alare": (-17, 49, 3), "right_alare": (17, 49, 3), "left_endocanthion": (-16, 2, -6), "right_endocanthion": (16, 2, -6)}


def grid(width, height):
    return [(k, i, i + 1, i + width) if half == 0 else (k + 1, i + 1, i + width + 1, i + width) for y in range(height - 1) for x in range(width - 1) for i in [y * width + x] for k in [2 * i] for half in (0, 1)]


def surface(height):
    """A sheet over 34 by 56 mm: rows (vid, x, y, z in mm)."""
    xs, ys = np.arange(-17, 17.1, 1.7).tolist(), np.arange(-4, 52.1, 1.4).tolist()
    return [(i, x, y, height(y, x)) for i, (y, x) in enumerate((y, x) for y in ys for x in xs)], grid(len(xs), len(ys))


def bump(y, at, width, high):
    return high * np.exp(-0.5 * ((y - at) / width) ** 2)


SHAPES = {
    "one": lambda y, x: 0.32 * y + bump(y, 20, 6, 2.5) - 0.018 * x * x,
    "upper": lambda y, x: 0.32 * y + bump(y, 16, 4.5, 2.7) + bump(y, 35, 3, 4.0) - 0.018 * x * x,
}


@pytest.fixture(scope="module")
def cases(spark):
    v, f = [], []
    for name, height in SHAPES.items():
        rows, triangles = surface(height)
        v += [(name, i, x / 1000, y / 1000, float(z) / 1000) for i, x, y, z in rows]
        f += [(name, *t) for t in triangles]
    marks = [(name, n, *map(float, p)) for name in SHAPES for n, p in LANDMARKS.items()]
    return spark.createDataFrame(v, "case_id string, vid long, x double, y double, z double"), spark.createDataFrame(f, "case_id string, fid long, v0 long, v1 long, v2 long"), spark.createDataFrame(marks, "case_id string, landmark string, x double, y double, z double")


def test_offsets_against_a_dense_solution(spark):
    w, h = 12, 9
    g, faces = np.random.default_rng(1), grid(12, 9)
    edge = lambda i: min(i % w, i // w, w - 1 - i % w, h - 1 - i // w)
    meshes, want = {}, {}
    for mesh in "ab":
        roles = np.array(["boundary" if edge(i) == 0 else "free" if edge(i) == 1 or g.random() < 0.5 else "constraint" for i in range(w * h)])
        meshes[mesh] = roles, g.random((w * h, 2)) - [0.1, 0.5]
        a = np.zeros((w * h, w * h))
        for _, *c in faces:
            for u, v in ((0, 1), (1, 2), (2, 0)):
                a[c[u], c[v]] = a[c[v], c[u]] = 1
        d = 1 / np.sqrt(a.sum(1))
        lap = np.eye(w * h) - d[:, None] * a * d
        weight = np.select([roles == "constraint", roles == "boundary"], [2500.0, 1e4], 0)
        u = np.linalg.solve(lap.T @ lap + np.diag(weight + 1e-9), np.where(roles == "constraint", 2500.0, 0)[:, None] * meshes[mesh][1])
        u = np.stack([np.clip(u[:, 0], 0, 0.8), np.clip(u[:, 1], -0.4, 0.4)], 1)
        u[(roles == "boundary")] = 0
        want[mesh] = np.where(np.abs(u) < 1e-8, 0, u)
    rows = [(m, i, str(roles[i]), float(t[i, 0]), float(t[i, 1]), 0.8, 0.4) for m, (roles, t) in meshes.items() for i in range(w * h)]
    nodes = spark.createDataFrame(rows, "mesh string, vid long, role string, target0 double, target1 double, limit0 double, limit1 double")
    triangles = spark.createDataFrame([(m, *f) for m in "ab" for f in faces], "mesh string, fid long, v0 long, v1 long, v2 long")
    got = smoothing.smooth_offsets(triangles, nodes, tolerance=1e-12).toPandas()
    assert got.residual.max() < 1e-8
    for m in "ab":
        own = got[got.mesh == m].sort_values("vid")
        assert np.allclose(own[["offset0", "offset1"]], want[m], atol=1e-6)
    for bad in (nodes.where("role <> 'boundary' OR vid < 2"), nodes.where("role <> 'constraint'"), nodes.where("vid % 2 = 0 AND vid DIV 12 % 2 = 0")):
        with pytest.raises(ValueError):
            smoothing.smooth_offsets(triangles, bad)


def test_nothing_moves_for_a_reduction_of_zero(cases):
    moved, profiles = deformation.reduce_ridge(*cases, 0.0)
    before = {(r.case_id, r.vid): (r.x, r.y, r.z) for r in cases[0].collect()}
    assert {(r.case_id, r.vid): (r.x, r.y, r.z) for r in moved.collect()} == before
    assert all(r.passed for r in profile_acceptance(profiles, "case_id").collect())


def test_reduction_of_a_ridge(cases):
    moved, profiles = deformation.reduce_ridge(*cases, 2.0)
    rows, p = moved.toPandas(), profiles.toPandas()
    start = cases[0].toPandas().merge(rows, on=["case_id", "vid"], suffixes=("0", ""))
    assert rows.residual.dropna().max() < 1e-8 and set(rows.role.dropna()) == {"constraint", "free", "boundary"}
    assert np.allclose(start.y, start.y0, atol=1e-12)  # no movement along the ridge
    side, back = (start.x - start.x0) * 1000, (start.z0 - start.z) * 1000
    assert np.abs(side).max() <= 0.21 and (start.x0 * side <= 1e-10).all() and back.min() >= -1e-9
    assert 1.8 <= rows.displacement_mm.max() <= np.hypot(2.0, 0.2) + 1e-6
    end = min(0.82 * 50, 44)
    outside = (start.y0 * 1000 >= end) | (start.y0 <= 0) | (start.x0.abs() * 1000 >= 2 * 0.28 * 34)
    assert (start.displacement_mm[outside] == 0).all() and (start.displacement_mm > 0).sum() > 100
    apex = p[p.apex].set_index("case_id")
    assert 18 < apex.center["one"] < 22.5 and 12 <= apex.center["upper"] <= 20  # not the larger bulge further down
    assert (apex.requested == 2.0).all() and ((apex.source - apex.final) > 1.85).all()
    upper = start[start.case_id == "upper"]
    assert 12 <= 1000 * upper.y0[upper.displacement_mm.idxmax()] <= 20
    assert upper.displacement_mm[upper.y0.between(0.030, 0.039)].max() < 0.5 * upper.displacement_mm.max()
    ends = p[(p.normalized < 0.02) | (p.normalized > 0.94)]
    assert (ends.requested < 0.05).all() and (np.abs(ends.source - ends.final) < 0.1).all()
    bands = {r.case_id: r for r in deformation.coverage(moved, profiles, p.groupby("case_id").agg(roi_end_mm=("center", lambda c: c.max() * 64 / 63.5)).reset_index().pipe(cases[0].sparkSession.createDataFrame)).collect()}
    assert all(b.ridge_median > 1.8 and b.slopes_ratio > 0.75 and not b.strip for b in bands.values())
    changes = smoothing.offset_changes(cases[1].withColumnRenamed("case_id", "mesh"), moved.selectExpr("case_id AS mesh", "vid", "posterior_mm AS offset0", "lateral_mm AS offset1")).collect()
    assert all(0 < c.p95 <= c.maximum < 1.5 for c in changes)


def test_amplitude_isnt_limited_by_the_height_over_the_line(spark, cases):
    rows, triangles = surface(lambda y, x: 0.32 * y + bump(y, 20, 6, 0.5) - 0.018 * x * x)
    v = spark.createDataFrame([("one", i, x / 1000, y / 1000, float(z) / 1000) for i, x, y, z in rows], cases[0].schema)
    moved, profiles = deformation.reduce_ridge(v, cases[1].where("case_id = 'one'"), cases[2].where("case_id = 'one'"), 3.5)
    top = profiles.where("apex").first()
    assert top.excess < 1.0 and top.requested == 3.5 and top.source - top.final > 3.3
    assert 3.4 <= moved.selectExpr("max(displacement_mm)").first()[0] <= np.hypot(3.5, 0.35) + 1e-6


def test_what_is_refused(spark, cases):
    v, f, marks = (x.where("case_id = 'one'") for x in cases)
    flat = v.selectExpr("case_id", "vid", "x", "y", "0.32 * y AS z")
    for args in ((v, f, marks, 6.0), (v, f, marks, -1.0), (v, f, marks.where("landmark <> 'nasion'"), 1.0), (v.selectExpr("case_id", "vid", "x", "y", "if(vid = 3, double('nan'), z) AS z"), f, marks, 1.0), (v.where("y > 0.03"), f, marks, 1.0), (flat.selectExpr("case_id", "vid", "x", "y", "0.3 * y - 20 * (y - 0.02) * (0.02 - y) * 0 - y * y AS z").selectExpr("case_id", "vid", "x", "y", "y * y * 5 AS z"), f, marks, 1.0)):
        with pytest.raises(ValueError):
            deformation.reduce_ridge(*args)
