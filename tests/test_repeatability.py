"""Alignment and distances of several pairs of surfaces at once: known motions and known differences."""

import numpy as np
import pytest
from gaugeflow.operators import repeatability

MARKS = {"nasion": (0, -12), "pronasale": (0, 4), "subnasale": (0, 12), "left_alare": (-10, 8), "right_alare": (10, 8), "left_endocanthion": (-16, -14), "right_endocanthion": (16, -14)}


def height(x, y):
    return 12 * np.exp(-((x / 9) ** 2 + ((y - 4) / 12) ** 2)) - 0.01 * x * x + 1.5 * np.sin(x / 5) * np.cos(y / 7)


def turn(a, b, c):
    rx, ry, rz = (np.eye(3) for _ in range(3))
    rx[1:, 1:] = [[np.cos(a), -np.sin(a)], [np.sin(a), np.cos(a)]]
    ry[::2, ::2] = [[np.cos(b), np.sin(b)], [-np.sin(b), np.cos(b)]]
    rz[:2, :2] = [[np.cos(c), -np.sin(c)], [np.sin(c), np.cos(c)]]
    return rz @ ry @ rx


@pytest.fixture(scope="module")
def cases(spark):
    n, step, g = 33, 1.5, np.random.default_rng(4)
    at = (np.arange(n) - n // 2) * step
    xs, ys = (m.ravel() for m in np.meshgrid(at, at))
    flat = np.stack([xs, ys, height(xs, ys)], 1)
    marks = np.array([(x, y, height(x, y)) for x, y in MARKS.values()], float)
    v, lm, f = [], [], []
    for name, (r, t, extra) in {"a": (np.eye(3), np.zeros(3), 0.0), "b": (turn(0.1, -0.2, 0.3), np.array([40.0, -20, 9]), 0.0), "c": (turn(-0.3, 0.1, 0.05), np.array([-7.0, 3, 100]), 9.0), "d": (np.eye(3), np.zeros(3), 0.0)}.items():
        points = flat + np.stack([0 * xs, 0 * ys, extra * np.exp(-((xs / 6) ** 2 + ((ys - 4) / 6) ** 2))], 1)
        v += [(name, i, *map(float, p / 1000)) for i, p in enumerate(points @ r.T + t)]
        lm += [(name, k, *map(float, p / 1000)) for k, p in zip(MARKS, marks @ r.T + t + g.normal(size=marks.shape) * 0.3)]
        f += [(name, 2 * i + h, *((i, i + 1, i + n), (i + 1, i + n + 1, i + n))[h]) for y in range(n - 1) for x in range(n - 1) for i in [y * n + x] for h in (0, 1)]
    xyz = "x double, y double, z double"
    return spark.createDataFrame(v, f"case_id string, vid long, {xyz}"), spark.createDataFrame(f, "case_id string, fid long, v0 long, v1 long, v2 long"), spark.createDataFrame(lm, f"case_id string, landmark string, {xyz}")


def test_pairs_of_surfaces(spark, cases):
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "first string, second string")
    got = {(r.first, r.second): r for r in repeatability.surface_repeatability(*cases, pairs, least_nasal=100, least_central=100).collect()}
    assert got.keys() == {("a", "b"), ("a", "c"), ("b", "c")} and {r.overall_status for r in got.values()} == {"WARN"}
    same, bump = got["a", "b"], got["a", "c"]
    assert same.p99_mm < 0.1 and same.status == "PASS" and same.landmarks == 7 and same.icp_converged and same.icp_fitness > 0.99 and abs(same.landmark_scale - 1) < 0.05
    assert 800 < same.samples <= 2 * 33 * 33
    assert 1.0 < bump.p95_mm < 2.0 and bump.status != "PASS" and bump.median_mm < 1.0
    assert abs(bump.p95_mm - got["b", "c"].p95_mm) < 0.1  # the same surfaces in another place


def test_what_is_refused(spark, cases):
    v, f, lm = cases
    pair = spark.createDataFrame([("a", "d")], "first string, second string")
    with pytest.raises(ValueError):
        repeatability.surface_repeatability(v, f, lm.where("case_id <> 'd' OR landmark < 'o'"), pair, least_nasal=100)
    with pytest.raises(ValueError):
        repeatability.surface_repeatability(v, f, lm, pair, least_nasal=5000, rounds=1)
