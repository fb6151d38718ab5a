"""Edge rows and invariants that the given tables don't hold."""

import math

import numpy as np
import pandas as pd
import pytest
from gaugeflow.functions import vectors as V
from gaugeflow.functions.text import duration_label, reduction_label
from gaugeflow.operators import compare, gates, geometry, mesh, neighbors, profiles, quantiles, registration, reports, robust, scale, series, solve, state, surfaces
from gaugeflow.operators.components import connected_components
from gaugeflow.plans import roles
from gaugeflow.sources import captures
from pyspark.sql import functions as F


LIMITS = [("s", "fps", "min", 29.0, None, 24.0, None, "fps"), ("s", "drift", "max", None, 1.0, None, 2.0, "%"), ("s", "duration", "range", 25.0, 45.0, 18.0, 60.0, "s")]


def test_gate_edges(spark):
    rows = [("fps", 29.0), ("fps", 24.0), ("fps", 23.9), ("fps", math.nan), ("fps", None), ("drift", 1.0), ("drift", 2.0), ("drift", 2.1), ("drift", math.nan), ("duration", 25.0), ("duration", 45.1), ("duration", 61.0), ("duration", math.nan)]
    m = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, check_id string, value double")
    got = [r.status for r in gates.evaluate(m, gates.thresholds(spark, LIMITS)).orderBy("i").collect()]
    assert got == ["PASS", "WARN", "FAIL", "FAIL", "WARN", "PASS", "WARN", "FAIL", "FAIL", "PASS", "WARN", "FAIL", "WARN"]
    with pytest.raises(Exception, match="unknown check: mystery"):
        gates.evaluate(spark.createDataFrame([("mystery", 1.0)], "check_id string, value double"), gates.thresholds(spark, LIMITS)).collect()
    flags = spark.createDataFrame([(0, True), (1, False), (2, None)], "i int, f boolean")
    assert [r.s for r in flags.select("i", gates.tri_state(F.col("f")).alias("s")).orderBy("i").collect()] == ["PASS", "FAIL", "WARN"]


GOOD = {
    "capture.frame_count": 1200, "capture.duration": 32, "capture.fps": 37.5, "capture.resolution": 1920, "capture.path": 1.5, "capture.span": 0.5, "capture.orientation_coverage": 145, "capture.tracking_jumps": 0, "capture.focal_drift": 0.5,
    "capture.linear_speed": 0.1, "capture.angular_speed": 20, "video.sharpness_p10": 120, "video.sharpness_median": 250, "video.dark_pixels": 0.1, "video.bright_pixels": 0.1, "video.luminance_stability": 20, "capture.selected_frames": 120, "capture.depth_coverage": 1,
    "mask.success_ratio": 1, "sfm.registered_images": 100, "sfm.registration_ratio": 0.9, "sfm.sparse_points": 20000, "mvs.fused_artifact_exists": 1, "mvs.fused_artifact_role": 1, "mvs.fused_point_count": 150000, "mvs.nonfinite_points": 0, "mvs.fused_file_size": 1,
    "mvs.fused_bounding_box": 1, "mvs.fused_normals": 1, "scale.pose_inlier_ratio": 0.9, "scale.pose_median_residual": 5, "scale.pose_p95_residual": 10, "scale.lidar_verification": 1, "mesh.nonfinite": 0, "mesh.degenerate": 0, "mesh.largest_component": 1,
    "mesh.component_count": 1, "mesh.edge_sampling": 0.5, "mesh.winding": 1, "mesh.watertight": 1, "landmarks.minimum_inlier_ratio": 0.9, "landmarks.maximum_ray_residual": 1, "landmarks.maximum_surface_snap": 0.5, "assets.geometry_identity": 1,
    "assets.render_deviation": 0, "assets.texture_resolution": 4096, "assets.texture_black_faces": 1, "assets.texture_white_faces": 0, "assets.skin_material": 1, "measurements.count": 1, "measurements.definition_validation": 1, "pipeline.runtime": 3000, "pipeline.stage_completion": 1,
}
DOCUMENTS = ["sfm", "mvs", "scale", "mesh", "landmarks"]


def reported(spark, metrics, documents):
    cases = spark.createDataFrame([("a",)], "case_id string")
    m = spark.createDataFrame([("a", k, None if v is None else float(v)) for k, v in metrics.items()], "case_id string, check_id string, value double")
    d = spark.createDataFrame([("a", x) for x in documents], "case_id string, document string")
    checks = reports.case_checks(cases, m, d)
    return reports.case_report(checks).first(), {r.check_id: r.status for r in checks.collect()}


def test_a_complete_case_never_passes_as_definitions_are_not_approved(spark):
    r, checks = reported(spark, GOOD, DOCUMENTS)
    assert r.overall_status == "WARN" and r.failed_sections == [] and r.warning_sections == ["Measurements"] and r.clinical_use_authorized is False
    assert {s.id: s.status for s in r.sections} == {s: "WARN" if s == "measurements" else "PASS" for s, *_ in reports.SECTIONS} and [s.id for s in r.sections] == [s for s, *_ in reports.SECTIONS]
    assert checks["measurements.definition_validation"] == "WARN" and checks["capture.duration"] == "PASS"
    criteria = {c.check_id: c.criteria for s in r.sections for c in s.checks}
    assert criteria["capture.path"] == "PASS >= 1.2; WARN >= 0.75; FAIL < 0.75" and criteria["capture.duration"] == "PASS 25-45; WARN 18-60; FAIL outside WARN range"


def test_case_gates(spark):
    assert reported(spark, GOOD | {"capture.duration": 20}, DOCUMENTS)[1]["capture.duration"] == "WARN"
    r, checks = reported(spark, GOOD | {"capture.orientation_coverage": 90, "mvs.fused_artifact_exists": 0, "scale.lidar_verification": None, "mesh.watertight": 0, "pipeline.stage_completion": 0}, DOCUMENTS)
    assert r.overall_status == "FAIL" and r.failed_sections == ["Input capture", "Raw dense stereo fusion", "Pipeline execution"] and r.warning_sections == ["Metric scale", "Authoritative mesh", "Measurements"]
    # Nothing known: metrics warn, flags fail, absent documents say so, optional checks are left out.
    r, checks = reported(spark, {}, [])
    assert checks["capture.fps"] == "WARN" and checks["mesh.exists"] == "FAIL" and checks["scale.exists"] == "FAIL" and checks["landmarks.quality"] == "FAIL" and checks["sfm.metrics"] == "WARN" and checks["mvs.fusion_metrics"] == "WARN"
    assert "capture.selected_frames" not in checks and "mesh.winding" not in checks and r.overall_status == "FAIL" and len(r.sections) == 10
    with pytest.raises(Exception, match="unknown check: mesh.largest"):
        reported(spark, {"mesh.largest": 1}, DOCUMENTS)


def test_repeatability_of_three_cases(spark):
    base = {"nasofrontal_angle_deg": 160.0, "nasolabial_angle_deg": 95.0, "goode_ratio": 0.5, "nose_length_mm": 45.0, "nose_width_mm": 30.0, "midline_deviation_mm": 1.0}
    rows = [("s", f"case_{i}", n, v + (offset / 100 if n == "goode_ratio" else offset)) for i, offset in enumerate((0.0, 0.5, 2.5)) for n, v in base.items()]
    schema = "subject_id string, case_id string, measurement string, value double"
    got = {r.measurement: r for r in reports.repeatability_report(spark.createDataFrame(rows, schema)).collect()}
    assert {r.overall_status for r in got.values()} == {"FAIL"} and got["nose_length_mm"].maximum_pairwise_difference == 2.5 and got["nose_width_mm"].sample_standard_deviation == 1.3229
    assert {n: r.status for n, r in got.items()} == {n: "FAIL" if n.endswith("mm") else "PASS" for n in base} and got["goode_ratio"].unit == "ratio"
    for bad, match in ((rows[:6], "fewer than two cases"), (rows[1:], "lack a measurement")):
        with pytest.raises(Exception, match=match):
            reports.repeatability_report(spark.createDataFrame(bad, schema)).collect()


def test_runtime_and_worst_landmarks(spark):
    stages = spark.createDataFrame([("a", "ingest", "complete", 10.5), ("a", "mesh", "failed", 99.0), ("a", "quality", "running", 5.0), ("b", "ingest", "complete", None)], "case_id string, stage string, status string, elapsed_seconds double")
    assert {r.case_id: (r.runtime, r.incomplete, r.complete) for r in reports.stage_runtime(stages).collect()} == {"a": (10.5, ["mesh"], False), "b": (0.0, [], True)}
    quality = spark.createDataFrame([("a", "nasion", 8.0, 10.0, 0.5, 0.2), ("a", "tip", 9.0, 10.0, None, 0.9)], "case_id string, landmark string, inliers double, observations double, ray_residual_mm double, snap_mm double")
    r = reports.landmark_metrics(quality).first()
    assert (r.landmark_count, r.minimum_inlier_ratio, r.maximum_median_ray_residual_mm, r.maximum_surface_snap_distance_mm, r.worst_surface_snap_landmark) == (2, 0.8, math.inf, 0.9, "tip")


def test_percentiles_of_large_groups_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 500)
    g = np.random.default_rng(17)
    x = {"a": g.normal(size=30_000), "b": np.where(g.random(20_000) < 0.4, 1.5, g.integers(0, 50, 20_000)), "c": g.normal(size=7), None: np.array([2.0])}
    pdf = pd.concat([pd.DataFrame({"g": k, "v": v}) for k, v in x.items()] + [pd.DataFrame({"g": ["empty"], "v": [None]})])
    df = spark.createDataFrame(pdf.astype({"v": float}), "g string, v double").withColumn("v", F.nanvl("v", F.lit(None)))
    wanted = {f"q{i}": (F.col("v"), q) for i, q in enumerate((0.0, 0.04, 0.5, 0.95, 1.0))}
    got = {r.g: r for r in quantiles.exact_percentiles(df, ["g"], wanted).collect()}
    for k, v in x.items():
        assert [got[k][n] for n in wanted] == pytest.approx([np.quantile(v, q) for _, q in wanted.values()], abs=1e-12), k
    assert got["empty"].q0 is None and len(got) == 5
    whole = quantiles.exact_percentiles(df, [], {"m": (F.col("v"), 0.5)}).first()
    assert whole.m == pytest.approx(np.quantile(np.concatenate(list(x.values())), 0.5))
    assert quantiles.exact_percentiles(df.limit(0), ["g"], {"m": (F.col("v"), 0.5)}).count() == 0


def brute_closest(p, a, b, c):
    """The least distance over the triangle's face, edges and corners."""
    best = min(np.linalg.norm(p - q) for q in (a, b, c))
    for s, e in ((a, b), (b, c), (c, a)):
        t = np.clip((p - s) @ (e - s) / max((e - s) @ (e - s), 1e-300), 0, 1)
        best = min(best, np.linalg.norm(p - s - t * (e - s)))
    m = np.stack([b - a, c - a], axis=1)
    v, w = np.linalg.lstsq(m, p - a, rcond=None)[0]
    return min(best, np.linalg.norm(p - a - m @ (v, w))) if v >= 0 and w >= 0 and v + w <= 1 else best


def test_closest_on_surface_against_brute_force(spark):
    g = np.random.default_rng(18)
    corners = g.uniform(0, 1, (40, 1, 3)) + g.uniform(-0.2, 0.2, (40, 3, 3))
    points = np.concatenate([g.uniform(-0.2, 1.2, (60, 3)), [[9.0, 9.0, 9.0]]])
    t = spark.createDataFrame([(i, *map(float, c.ravel())) for i, c in enumerate(corners)], "fid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double")
    p = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(points)], "point_id long, x double, y double, z double")
    got = {r.point_id: r for r in surfaces.closest_on_surface(p, t, 0.1).collect()}
    for i, x in enumerate(points):
        r = got[i]
        assert r.distance == pytest.approx(min(brute_closest(x, *c) for c in corners)) and min(r.u, r.v, r.w) >= -1e-12 and r.u + r.v + r.w == pytest.approx(1)
        assert np.allclose((r.u, r.v, r.w) @ corners[r.fid], (r.sx, r.sy, r.sz)) and np.linalg.norm(x - (r.sx, r.sy, r.sz)) == pytest.approx(r.distance)
    assert surfaces.closest_on_surface(p, t.limit(0), 0.1).count() == 0 and surfaces.closest_on_surface(p.limit(0), t, 0.1).count() == 0


def test_triangle_hits_and_samples(spark):
    rays = spark.createDataFrame([(0, 0.2, 0.2, 5.0, 0.0, 0.0, -1.0, 1), (1, 2.0, 2.0, 5.0, 0.0, 0.0, -1.0, 1)], "ray_id long, ox double, oy double, oz double, dx double, dy double, dz double, k int")
    tris = spark.createDataFrame([(i, 0.0, 0.0, z, 1.0, 0.0, z, 0.0, 1.0, z, 1) for i, z in enumerate((1.0, 3.0, 9.0))], "fid long, ax double, ay double, az double, bx double, by double, bz double, cx double, cy double, cz double, k int")
    assert [tuple(r) for r in neighbors.triangle_hits(rays, tris, ["k"]).collect()] == [(0, 1, 2.0)]
    rows = spark.range(1000)
    one = {r.id for r in neighbors.seeded_sample(rows, "id", 50, 3).collect()}
    assert len(one) == 50 and one == {r.id for r in neighbors.seeded_sample(rows.repartition(7), "id", 50, 3).collect()} != {r.id for r in neighbors.seeded_sample(rows, "id", 50, 4).collect()}
    chain = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 5, 6, 7)], "mesh string, fid long, v0 long, v1 long, v2 long")
    assert {(r.node, r.component) for r in mesh.mesh_components(chain).collect()} == {(0, 0), (1, 0), (2, 0), (5, 5), (6, 5), (7, 5)}


def test_views_and_frames(spark):
    q = spark.createDataFrame([(0, 0.0, 0.0, 0.0, 1.0), (1, 0.0, 2.0, 0.0, 0.0), (2, 1e-9, 0.0, 0.0, 0.0)], "i int, x double, y double, z double, w double")
    v = V.view_direction(tuple(F.col(c) for c in "xyzw"))
    assert [tuple(r)[1:] for r in q.select("i", *[F.round(x, 9).alias(n) for x, n in zip(v, "abc")]).orderBy("i").collect()] == [(0, 0, -1), (0, 0, 1), (0, 0, -1)]
    at = FACE
    r = spark.createDataFrame([("a", k, *map(float, x)) for k, x in at.items()], "c string, landmark string, x double, y double, z double")
    f = geometry.anatomical_frame(geometry.pivot_landmarks(r, "c"), "c").first()
    up = np.array([0, -20, 20]) / math.sqrt(800)
    assert np.allclose([f.vertical[c] for c in "xyz"], up) and np.allclose([f.lateral[c] for c in "xyz"], (-1, 0, 0)) and f.tip_longitudinal_mm == pytest.approx(np.array([0, 0, 50]) @ up)
    assert f.alar_width_mm == 35 and f.half_width_mm == pytest.approx(9.8) and f.usable and f.anterior["z"] > 0


def test_report_is_never_clinical_and_empty_section_warns(spark):
    c = spark.createDataFrame([("a", "s", "x", 1.0, "", "PASS"), ("a", "t", "y", None, "", "WARN"), ("a", "t", "z", 0.0, "", "FAIL")], "case_id string, section string, check_id string, value double, unit string, status string")
    r = gates.report(c, ["case_id"]).first()
    assert (r.status, r.failed, r.warned, r.clinical_use_authorized) == ("FAIL", ["z"], ["y"], False)
    every = spark.createDataFrame([("a", "s"), ("a", "none")], "case_id string, section string")
    assert {(x.section, x.status) for x in gates.worst(c, ["case_id", "section"], every).collect()} == {("s", "PASS"), ("none", "WARN")}


def test_window_ties_and_threshold(spark):
    r = spark.createDataFrame([(0, 0, 5.0), (1, 1, 5.0), (2, 50, 1.0), (3, 99, 7.0), (4, 98, math.nan)], "id long, t long, s double")
    assert [(x.window, x.id) for x in series.window_top1(r, "t", "s", "id", 2, 2.0).orderBy("window").collect()] == [(0, 0), (1, 3)]
    assert series.window_top1(r.where("id < 0"), "t", "s", "id", 2, 2.0).count() == 0


def test_gaps_smoothing_and_contiguity(spark):
    r = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 2.0, None, None, 8.0, None])], "c string, p int, v double")
    assert [x.filled for x in series.interpolate_gaps(r, "c", "p", "v").orderBy("p").collect()] == [2, 2, 4, 6, 8, 8]
    flat = spark.createDataFrame([("a", i, 3.0) for i in range(20)], "c string, p int, v double")
    assert all(abs(x.smooth - 3) < 1e-12 for x in series.gaussian_smooth(flat, "c", "p", "v").collect())
    c = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("b", 0), ("c", 1)], "c string, p long")
    assert {x.c: x.contiguous for x in series.contiguity(c, "c", "p").collect()} == {"a": True, "b": False, "c": False}


def test_outer_compare_null_keys(spark):
    a = spark.createDataFrame([(None, "x", 1.0), ("k", "y", None)], "c string, m string, v double")
    b = spark.createDataFrame([(None, "x", 4.0), ("n", "z", 2.0)], "c string, m string, v double")
    got = {(r.c, r.m): (r.true_value, r.predicted, r.error) for r in compare.outer_compare(a, b, ["c", "m"], "v", "v").collect()}
    assert got == {(None, "x"): (1.0, 4.0, 3.0), ("k", "y"): (None, None, None), ("n", "z"): (None, 2.0, None)}


def test_repeatability_of_one_and_of_zero_mean(spark):
    r = spark.createDataFrame([("a", 1.0), ("b", -1.0), ("b", 1.0)], "m string, v double")
    (x,) = compare.repeatability(r, ["m"], "v", 1000).collect()
    assert (x.m, x.mean, x.cv_percent, x.range) == ("b", 0.0, None, 2.0) and abs(x.sd - math.sqrt(2)) < 1e-12


def test_rotated_intrinsics(spark):
    k = geometry.rotated_intrinsics(*[F.lit(float(v)) for v in (1370, 1368, 963, 722, 1920, 1440)], F.col("r"), F.lit(0.5))
    got = spark.createDataFrame([("clockwise",)], "r string").select(*[x.alias(f"c{i}") for i, x in enumerate(k)]).first()
    assert tuple(got) == (684.0, 685.0, 358.5, 481.5, 720.0, 960.0)


FACE = {"glabella": (0, 10, 0), "nasion": (0, 0, 0), "pronasale": (0, 0, 50), "subnasale": (0, -20, 20), "columella": (0, -18, 24), "labiale_superius": (0, -27, 18), "left_alare": (-17.5, -14, 15), "right_alare": (17.5, -14, 15), "left_endocanthion": (-15, 10, 0), "right_endocanthion": (15, 10, 0)}


def test_measurements_of_a_known_face(spark):
    r = spark.createDataFrame([("a", k, *map(float, v)) for k, v in FACE.items()], "c string, landmark string, x double, y double, z double")
    m = geometry.measurements(geometry.pivot_landmarks(r, "c"), "c").first()
    assert (m.nose_length_mm, m.nose_width_mm, m.midline_deviation_mm, m.nasofrontal_angle_deg, m.nasolabial_angle_deg, m.goode_ratio) == (50.0, 35.0, 0.0, 90.0, 132.5, 0.754)
    with pytest.raises(Exception, match="missing landmarks: nasion"):
        geometry.measurements(geometry.pivot_landmarks(r.where("landmark <> 'nasion'"), "c"), "c").collect()


def test_degenerate_tube_has_no_points(spark):
    p = spark.createDataFrame([(0.0, 0.0, 0.0)], "x double, y double, z double")
    assert p.where(geometry.in_segment_tube(V.columns(""), V.numbers(0, 0, 0), V.numbers(0, 0, 0), 1.0)).count() == 0


def test_mesh_of_two_triangles(spark):
    f = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 1, 3, 2), ("m", 2, 5, 5, 6)], "mesh string, fid long, v0 long, v1 long, v2 long")
    v = spark.createDataFrame([("m", i, *p) for i, p in enumerate([(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (1.0, 1.0, 0.0), (9.0, 9.0, 9.0), (2.0, 2.0, 2.0), (3.0, 3.0, 3.0)])], "mesh string, vid long, x double, y double, z double")
    e = mesh.edge_summary(f.where("fid < 2")).first()
    assert (e.edges, e.boundary, e.nonmanifold, e.watertight, e.winding_consistent) == (5, 4, 0, False, True)
    assert mesh.degenerate_faces(f, v).first().degenerate == 1
    assert {r.vid: r.nz for r in mesh.vertex_normals(f.where("fid < 2"), v).collect()} == {0: 1.0, 1: 1.0, 2: 1.0, 3: 1.0}
    assert {(r.vid, r.new_vid) for r in mesh.reindexed(f.where("fid = 2")).collect()} == {(5, 0), (6, 1)}


def test_components_of_a_long_chain_and_ties(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
    two = spark.createDataFrame([(0, 1), (5, 6)], "a long, b long")
    assert mesh.largest_component(connected_components(two)).first().component == 0


def test_knn_against_brute_force(spark):
    x = np.random.default_rng(3).normal(size=(120, 3))
    x[5] = (40, 40, 40)
    p = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "point_id long, x double, y double, z double")
    got = neighbors.knn(p, 4, 0.3).toPandas().sort_values(["point_id", "rank"]).groupby("point_id").neighbor_id.apply(list)
    d = np.linalg.norm(x[:, None] - x[None], axis=2)
    np.fill_diagonal(d, np.inf)
    assert all(got[i] == np.argsort(d[i])[:4].tolist() for i in range(120))


def test_similarity_and_ransac(spark):
    g = np.random.default_rng(11)
    s = g.normal(size=(80, 3))
    t = 0.42 * s @ np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]).T + (3, -2, 7)
    t[[4, 17, 55]] += 0.25
    df = spark.createDataFrame([("a", i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(s, t))], "c string, i long, sx double, sy double, sz double, tx double, ty double, tz double")
    fit = solve.umeyama_fit(df.where("i NOT IN (4, 17, 55)"), ["c"]).first()
    assert abs(fit.scale - 0.42) < 1e-9 and np.allclose(fit.t, (3, -2, 7))
    robust_fit = solve.ransac_fit(df, ["c"], "i", threshold=0.01).first()
    assert robust_fit.inliers == 77 and abs(robust_fit.scale - 0.42) < 1e-9


def brute_rays(c, d, least=6):
    d = d / np.linalg.norm(d, axis=1, keepdims=True)
    m = np.eye(3) - d[:, :, None] * d[:, None, :]
    point = lambda k: np.linalg.solve(m[k].sum(axis=0), np.einsum("nij,nj->i", m[k], c[k]))
    keep = np.ones(len(c), bool)
    for _ in range(4):
        if keep.sum() < least:
            break
        r = np.linalg.norm(np.cross(point(keep) - c, d), axis=1)
        middle = np.median(r[keep])
        new = r <= max(middle + 3 * np.median(np.abs(r[keep] - middle)), 2 * middle, 1e-6)
        if (new == keep).all():
            break
        keep = new
    return (point(keep) if keep.sum() >= least else None), int(keep.sum())


def brute_consensus(p, low, high, least=6):
    keep = np.ones(len(p), bool)
    for _ in range(5):
        if keep.sum() < least:
            break
        r = np.linalg.norm(p - np.median(p[keep], axis=0), axis=1)
        middle = np.median(r[keep])
        new = r <= min(high, max(low, middle + 3 * 1.4826 * np.median(np.abs(r[keep] - middle))))
        if (new == keep).all():
            break
        keep = new
    return (p[keep].mean(axis=0) if keep.sum() >= least else None), int(keep.sum())


def test_consensus_and_rays_against_plain_loops(spark):
    g, rows, points, want = np.random.default_rng(7), [], [], {}
    for k in range(8):
        n = (5, 7, 12, 12, 20, 20, 30, 30)[k]
        c = g.normal(size=(n, 3)) * 5
        d = (1, 2, 3) - c + g.normal(scale=0.02, size=(n, 3)) + np.where(g.random((n, 1)) < 0.3, g.normal(size=(n, 3)), 0)
        p = g.normal(scale=0.3, size=(n, 3)) + np.where(g.random((n, 1)) < 0.2, 20, 0)
        rows += [(k, *map(float, (*a, *b))) for a, b in zip(c, d)]
        points += [(k, *map(float, x)) for x in p]
        want[k] = (brute_rays(c, d), brute_consensus(p, 0.5, 2.0))
    rays = solve.robust_rays(spark.createDataFrame(rows, "k int, cx double, cy double, cz double, dx double, dy double, dz double"), ["k"])
    consensus = solve.consensus_point(spark.createDataFrame(points, "k int, x double, y double, z double"), ["k"], 0.5, 2.0)
    for got, which in ((rays, 0), (consensus, 1)):
        for r in got.collect():
            point, used = want[r.k][which]
            assert r.used == used and (r.x is None if point is None else np.allclose((r.x, r.y, r.z), point, atol=1e-8)), (which, r)
    assert want[0][0][0] is None and sum(w[0][0] is not None for w in want.values()) >= 5


def test_ransac_ties_go_to_the_lower_median_of_inliers(spark):
    # Two groups of 20 fit alike in number; the second fits exactly, while its median over all pairs is no better.
    g = np.random.default_rng(23)
    s = g.normal(size=(40, 3))
    t = np.concatenate([s[:20] + (5, 0, 0) + g.normal(scale=0.01, size=(20, 3)), s[20:] - (5, 0, 0)])
    df = spark.createDataFrame([("a", i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(s, t))], "c string, i long, sx double, sy double, sz double, tx double, ty double, tz double")
    r = solve.ransac_fit(df, ["c"], "i", sample=4, threshold=0.1).first()
    assert r.inliers == 20 and np.allclose(r.t, (-5, 0, 0), atol=1e-9) and r.accepted


def test_percentiles_skip_nan_and_trim_is_strict(spark):
    r = spark.createDataFrame([("a", v) for v in (1.0, 2.0, 4.0, 8.0, 16.0, math.nan, None)], "g string, v double")
    assert robust.finite_percentiles(r, ["g"], "v", [0.95]).first().p95 == pytest.approx(14.4)
    assert robust.percentile_trim(r.where("v < 100 AND NOT isnan(v)"), ["g"], "v", 0.0).count() == 5


def test_identity_ignores_order_and_log_resumes(spark, tmp_path):
    r = spark.createDataFrame([("a", i, i * 2) for i in range(5000)], "g string, o long, v long")
    one = state.content_identity(r, ["g"], "o", ["v"]).first().identity
    assert one == state.content_identity(r.orderBy(F.rand(1)), ["g"], "o", ["v"]).first().identity
    log, ran = state.StageLog(spark, str(tmp_path / "log")), []
    a = state.stage_signature("ingest", "c", {"n": 1}, None, "1")
    assert log.run("c", "ingest", a, {"n": 1}, lambda: ran.append(1)) and not log.run("c", "ingest", a, {"n": 1}, lambda: ran.append(2))
    assert log.run("c", "ingest", state.stage_signature("ingest", "c", {"n": 2}, None, "1"), {"n": 2}, lambda: ran.append(3)) and ran == [1, 3]


def test_readers_and_labels(spark, tmp_path):
    (tmp_path / "o.csv").write_text("timestamp, frame, x, y, z, qx, qy, qz, qw, fx\n0.5, 0, 1, 2, 3, 0, 0, 0, 1, \n0.6, 1, 1, 2, 3, 0, 0, 0, 1, 900\n")
    rows = captures.read_odometry(spark, str(tmp_path / "o.csv"), [1370, 0, 963, 0, 1368, 722, 0, 0, 1]).orderBy("frame_id").collect()
    assert [(r.fx, r.fy, r.cx) for r in rows] == [(1370.0, 1368.0, 963.0), (900.0, 1368.0, 963.0)]
    (tmp_path / "l.json").write_text('{"landmarks": {"nasion": [1, 2, 3]}}')
    assert captures.read_landmarks(spark, str(tmp_path / "l.json")).first().z == 3.0
    assert captures.render_html([{"id": "<a>", "status": "PASS"}], "t").count("&lt;a&gt;") == 1
    got = spark.createDataFrame([(2.0, 89.0), (0.125, 5400.0)], "a double, b double").select(reduction_label(F.col("a")).alias("a"), duration_label(F.col("b")).alias("b")).collect()
    assert [tuple(r) for r in got] == [("2.0", "89s"), ("0.125", "1.5h")]
    got = spark.createDataFrame([(0.5,), (1.5,), (90.0,), (5399.0,), (7200.0,)], "s double").select(duration_label(F.col("s")).alias("d")).collect()
    assert [r.d for r in got] == ["0s", "2s", "1.5m", "90.0m", "2.0h"]


def test_closest_points_recover_a_rigid_motion(spark):
    g, a = np.random.default_rng(5), 0.02
    p = g.uniform(0, 10, (40, 3))
    r, t = np.array([[math.cos(a), -math.sin(a), 0], [math.sin(a), math.cos(a), 0], [0, 0, 1]]), np.array([0.1, -0.05, 0.02])
    source, target = (spark.createDataFrame(pd.DataFrame(x, columns=list("xyz"))) for x in (p, p @ r.T + t))
    got = registration.closest_points(source, target, voxel=0.001, reach=2.0, rounds=12)
    row = got.first()
    assert np.allclose(np.array(row.r).reshape(3, 3), r, atol=1e-6) and np.allclose(row.t, t, atol=1e-6) and row.n == 40
    none = registration.closest_points(source, target.limit(0), voxel=0.001, reach=2.0).first()
    assert (none.n, none.rmse, none.t) == (0, None, [0, 0, 0])


def test_mesh_roles_reach_every_vertex(spark, tmp_path):
    g = np.random.default_rng(3)
    keys = g.integers(0, 5000, (400, 3))
    spark.createDataFrame([(i, [float(i)] * 64, i % 3) for i in range(700)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([("ANR"[i % 3], *map(int, k)) for i, k in enumerate(keys)], "l_returnflag string, l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {("ANR"[i % 3], *(int(x) % 700 for x in k)) for i, k in enumerate(keys)}
    f, v = roles.faces(spark, str(tmp_path)), roles.vertices(spark, str(tmp_path))
    assert {tuple(r) for r in f.select("mesh", "v0", "v1", "v2").collect()} == want and f.select("mesh", "fid").distinct().count() == len(want)
    assert {(r.mesh, r.vid) for r in v.collect()} == {(m, i) for m in "ANR" for i in range(700)}
    used = {(m, x) for m, *c in want for x in c}
    assert {(r.mesh, r.vid) for r in mesh.vertex_normals(f, v).collect()} == used and max(x for _, x in used) >= 500


def test_ransac_at_half_outliers_and_acceptance(spark):
    g = np.random.default_rng(2)
    s = g.normal(size=(160, 3))
    t = 0.5 * s + (1, 2, 3)
    t[::2] += g.normal(size=(80, 3)) * 5
    few = [("few", i, *map(float, (*p, *(2 * p)))) for i, p in enumerate(s[:15])]
    rows = [("half", i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(s, t))] + few
    fits = {r.c: r for r in solve.ransac_fit(spark.createDataFrame(rows, "c string, i long, sx double, sy double, sz double, tx double, ty double, tz double"), ["c"], "i").collect()}
    assert fits["half"].inliers == 80 and abs(fits["half"].scale - 0.5) < 1e-9 and fits["half"].accepted
    assert fits["few"].inliers == 15 and not fits["few"].accepted


def test_closest_points_tell_whether_they_converged(spark):
    p = np.random.default_rng(5).uniform(0, 10, (40, 3))
    source, target = (spark.createDataFrame(pd.DataFrame(x, columns=list("xyz"))) for x in (p, p + (0.1, -0.05, 0.02)))
    assert [registration.closest_points(source, target, voxel=0.001, reach=2.0, rounds=k).first().converged for k in (1, 12)] == [False, True]


def test_widest_angle_against_all_pairs(spark):
    g, rows, want = np.random.default_rng(24), [], {}
    for k, n in enumerate((2, 3, 40, 400)):
        x = g.normal(size=(n, 3)) + (0, 0, (0, 4, 2, 3)[k])
        rows += [(k, i, *map(float, v)) for i, v in enumerate(x)]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        want[k] = np.degrees(np.arccos(np.clip((u @ u.T).min(), -1, 1)))
    rows += [(9, 0, 1.0, 0.0, 0.0), (8, 0, 1.0, 1.0, 0.0), (8, 1, 1.0, 1.0, 0.0), (8, 2, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "k int, i int, x double, y double, z double")
    got = {r.k: r.max_angle for r in geometry.max_pairwise_angle(df, ["k"], "i", ("x", "y", "z")).collect()}
    assert got == pytest.approx(want | {8: 0.0}, abs=1e-5)


def test_capture_files(spark, tmp_path):
    frames = lambda rows: spark.createDataFrame(rows, "frame_id long, ts double")
    assert captures.checked_frames(frames([(1, 0.2), (0, 0.1), (2, 0.3)])).count() == 3
    for rows, match in (([(0, 1.0)], "fewer than two"), ([(0, 1.0), (2, 2.0)], "0 to n - 1"), ([(0, 1.0), (0, 2.0)], "0 to n - 1"), ([(0, 1.0), (1, 1.0)], "do not grow")):
        with pytest.raises(Exception, match=match):
            captures.checked_frames(frames(rows)).collect()
    (tmp_path / "m.csv").write_text("1,2,3\n4,5,6\n\n7,8,9\n")
    assert captures.read_matrix(spark, str(tmp_path / "m.csv")) == list(map(float, range(1, 10)))
    (tmp_path / "bad.csv").write_text("1,2\n3,4\n")
    with pytest.raises(ValueError, match="3x3"):
        captures.read_matrix(spark, str(tmp_path / "bad.csv"))
    docs = spark.createDataFrame([("a", "scale", '{"scale_mm_per_unit": 12.5}'), ("a", "case", '{"stages": {"mvs": {"parameters": {"poisson_depth": 10}}}}'), ("b", "scale", '{"scale_mm_per_unit": 1}')], "case_id string, document string, value string")
    assert {tuple(r) for r in captures.production_settings(docs).collect()} == {("a", 12.5, 10), ("b", 1.0, 9)}
    with pytest.raises(Exception, match="no scale for case a"):
        captures.production_settings(docs.where("document = 'case'")).collect()
    (tmp_path / "x.json").write_text('{"measurements": {"nose_length_mm": 45.5}}')
    assert captures.read_measurements(spark, str(tmp_path / "x.json")).first().value == 45.5
    (tmp_path / "c.csv").write_text("case_id,measurement,true_value\na,width,\nb,width,3.5\n")
    rows = captures.read_comparison(spark, str(tmp_path / "c.csv"))
    assert {tuple(r) for r in rows.collect()} == {("a", "width", None), ("b", "width", 3.5)}
    captures.write_csv(rows, str(tmp_path / "out"))
    assert captures.read_comparison(spark, str(tmp_path / "out")).count() == 2
    captures.write_report(rows, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).where("case_id = 'b'").first().true_value == 3.5


def test_identities_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a.bin").write_bytes(b"abc")
    r = state.artifact_records(spark, str(tmp_path / "a.bin"), "mesh").first()
    assert (r.role, r["size"], r.sha256) == ("mesh", 3, hashlib.sha256(b"abc").hexdigest())
    files = spark.createDataFrame([("c", "rgb", f"{i:03}.png", 100 + i) for i in range(5)], "case_id string, kind string, name string, size long")
    tables = spark.createDataFrame([("c", "odometry.csv", "t,x"), ("d", "odometry.csv", "t,x")], "case_id string, name string, content string")
    one = {r.case_id: r.fingerprint for r in state.capture_fingerprint(files, tables).collect()}
    two = {r.case_id: r.fingerprint for r in state.capture_fingerprint(files.repartition(3), tables.repartition(2)).collect()}
    less = {r.case_id: r.fingerprint for r in state.capture_fingerprint(files.where("name <> '004.png'"), tables).collect()}
    assert one == two and one["c"] != less["c"] and one["d"] == less["d"] and len(one["c"]) == 64


def test_parts_of_meshes(spark):
    f = spark.createDataFrame([("m", 0, 0, 1, 2), ("m", 1, 1, 3, 2), ("m", 2, 2, 7, 8), ("m", 3, 20, 21, 22), ("n", 0, 30, 31, 32)], "mesh string, fid long, v0 long, v1 long, v2 long")
    assert {(r.mesh, r.fid, r.component) for r in mesh.face_components(f).collect()} == {("m", 0, 0), ("m", 1, 0), ("m", 2, 2), ("m", 3, 20), ("n", 0, 30)}
    assert {(r.mesh, r.fid) for r in mesh.keep_largest(f).collect()} == {("m", 0), ("m", 1), ("n", 0)}
    edges = spark.createDataFrame([(0, 1), (1, 2), (3, 4), (2, 3)], "a long, b long")
    inside = spark.createDataFrame([(i,) for i in (0, 1, 3, 4)], "vid long")
    assert {r.vid for r in mesh.seeded_component(edges, inside, 4).collect()} == {3, 4}
    with pytest.raises(ValueError, match="seed"):
        mesh.seeded_component(edges, inside, 2)


def test_intrinsics_of_cameras(spark):
    cameras, images = spark.createDataFrame([(1,), (2,)], "camera_id int"), spark.createDataFrame([(1, "a"), (2, "b")], "camera_id int, name string")
    measured = spark.createDataFrame([("a", 10.0), ("b", 20.0)], "name string, fx double")
    assert {(r.camera_id, r.fx) for r in scale.measured_intrinsics(cameras, images, measured).collect()} == {(1, 10.0), (2, 20.0)}
    for i, m, match in ((images.unionByName(spark.createDataFrame([(1, "c")], "camera_id int, name string")), measured, "share camera 1"), (images, measured.where("name = 'a'"), "no measured parameters for b")):
        with pytest.raises(Exception, match=match):
            scale.measured_intrinsics(cameras, i, m).collect()


def test_best_of_windows_on_a_stream(spark, tmp_path):
    from gaugeflow.streaming import best_of_windows

    rows = spark.createDataFrame([(i, s, 1.0 * v) for i, (s, v) in enumerate([(0, 3), (5, 9), (9, 9), (12, 1), (40, 2)])], "id long, s long, v double").selectExpr("id", "timestamp_seconds(s) AS t", "v")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = best_of_windows(stream, "t", "v", "id", "10 seconds", "1 second").writeStream.format("memory").queryName("best").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {(r.id, r.v) for r in spark.table("best").select("id", "v").collect()} == {(1, 9.0), (3, 1.0)}


def test_ridge_profile_against_plain_loops(spark):
    g = np.random.default_rng(25)
    lon, lat = g.uniform(-2, 34, 4000), g.uniform(-6, 6, 4000)
    height = 20 + np.sin(lon / 5) + g.normal(scale=0.1, size=4000)
    keep = ~((lon > 10) & (lon < 12))  # a gap
    lon, lat, height = lon[keep], lat[keep], height[keep]
    df = spark.createDataFrame([("a", *map(float, r)) for r in zip(lon, lat, height)] + [("b", 1.0, 0.0, 5.0), ("b", 1.1, 0.0, 5.0)], "c string, longitudinal double, lateral double, anterior double")
    frames = spark.createDataFrame([("a", 30.0, 8.0), ("b", 30.0, 8.0)], "c string, roi_end_mm double, half_width_mm double")
    rows = profiles.ridge_profile(df, frames, "c").orderBy("bin").collect()
    got = [r for r in rows if r.c == "a"]
    edges = np.linspace(0, 30, 65)
    level = np.full(64, np.nan)
    for i in range(64):
        own = (lon >= edges[i]) & (lon < edges[i + 1]) & (np.abs(lat) <= 2.5)
        if own.sum() >= 2:
            level[i] = np.percentile(height[own], 90)
    at = np.flatnonzero(np.isfinite(level))
    kernel = np.exp(-0.5 * (np.arange(-5, 6) / 1.6) ** 2)
    want = np.convolve(np.pad(np.interp(np.arange(64), at, level[at]), 5, mode="edge"), kernel / kernel.sum(), mode="valid")
    assert np.allclose([r.profile for r in got], want) and all(r.covered for r in got) and not any(r.covered for r in rows if r.c == "b")
    centers = (edges[:-1] + edges[1:]) / 2
    a, b = np.arange(1, 5), np.arange(60, 64)
    slope = (np.median(want[b]) - np.median(want[a])) / (np.median(centers[b]) - np.median(centers[a]))
    assert np.allclose([r.target for r in got], np.median(want[a]) + slope * (centers - np.median(centers[a])))


def test_plane_residuals_against_numpy(spark):
    g = np.random.default_rng(26)
    x = g.normal(size=(3, 12, 3)) * (1, 1, 0.05) + g.normal(size=(3, 1, 3))
    near = spark.createDataFrame([("a", k, *map(float, p)) for k in range(3) for p in x[k]] + [("a", 7, 0.0, 0.0, 0.0)] * 4, "c string, point_id long, nx double, ny double, nz double")
    planes = solve.local_planes(near)
    got = profiles.plane_residuals(near, planes, ["c"]).first()
    r = []
    for p in x:
        q = p - p.mean(axis=0)
        r.append(q @ np.linalg.eigh(q.T @ q)[1][:, 0])
    assert got.neighborhoods == 3 and got.residuals == 36 and got.median_absolute == pytest.approx(np.median(np.abs(r)), abs=1e-9) and got.p95 == pytest.approx(np.percentile(np.abs(r), 95), abs=1e-9)
    rms = {p.point_id: p.rms for p in planes.collect()}
    assert all(rms[k] == pytest.approx(np.sqrt(np.mean(np.square(r[k]))), abs=1e-9) for k in range(3))


def test_motion_across_spans(spark):
    g = np.random.default_rng(27)
    rows = [(c, i, i * 0.1, *map(float, g.normal(size=7))) for c in "ab" for i in sorted(g.choice(200, 60, replace=False).tolist())]
    df = spark.createDataFrame(rows, "c string, i long, t double, x double, y double, z double, qx double, qy double, qz double, qw double")
    q = tuple(F.col(n) for n in ("qx", "qy", "qz", "qw"))
    one, two = ({(r.c, r.i): (r.step, r.angle, r.interval) for r in series.adjacent_motion(df, "c", "i", "t", V.columns(""), q, span).collect()} for span in (4096, 7))
    assert one == two and len(one) == 120
    for c in "ab":
        own = [r for r in rows if r[0] == c]
        assert one[c, own[0][1]] == (None, None, None)
        for a, b in zip(own, own[1:]):
            assert one[c, b[1]][0] == pytest.approx(np.linalg.norm(np.subtract(b[3:6], a[3:6]))) and one[c, b[1]][2] == pytest.approx(b[2] - a[2])
