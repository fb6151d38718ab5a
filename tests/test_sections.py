"""Sections of several levels and surfaces against NumPy, one at a time."""

import numpy as np
import pytest
from gaugeflow.operators import sections


def envelope(lon, lat, front, level, window, half):
    edges = np.linspace(-half, half, 50)
    near, raw = np.abs(lon - level) <= window, np.full(49, np.nan)
    for k in range(49):
        inside = near & (lat >= edges[k]) & (lat < edges[k + 1])
        if inside.any():
            raw[k] = np.percentile(front[inside], 90)
    known = np.flatnonzero(np.isfinite(raw))
    filled = np.interp(np.arange(49), known, raw[known])
    kernel = np.exp(-0.5 * np.arange(-3, 4.0) ** 2)
    return (edges[:-1] + edges[1:]) / 2, np.convolve(np.pad(filled, 3, mode="edge"), kernel / kernel.sum(), mode="valid")


def test_report_of_each_section(spark):
    g = np.random.default_rng(8)
    rows, want = [], {}
    sizes = {"a": 40.0, "b": 30.0}
    levels = {(r.case_id, r.level): r for r in sections.section_levels(spark.createDataFrame(list(sizes.items()), "case_id string, roi_end_mm double"), spark.createDataFrame([("a", 0.4), ("b", 0.5)], "case_id string, normalized double")).collect()}
    assert len(levels) == 8 and levels["a", "hump_region"].level_mm == pytest.approx(16) and levels["b", "supratip"].level_mm == pytest.approx(26.4) and levels["b", "supratip"].window_mm == pytest.approx(0.8)
    half, core, bridge = 14.0, 2.0, 9.0
    for case, size in sizes.items():
        lon, lat = g.random(4000) * size, (g.random(4000) - 0.5) * 30
        front = 20 - 0.05 * lat**2 + 0.2 * lon + g.normal(size=4000) * 0.05
        surfaces = {"source": (lat, front), "target": (lat * 0.97, front - 2), "simulated": (lat - np.sign(lat) * np.minimum(0.3, 0.1 * np.abs(lat)), front - 2 * np.exp(-((lat / 3) ** 2)))}
        for surface, (x, y) in surfaces.items():
            rows += [(case, i, surface, *map(float, p)) for i, p in enumerate(zip(lon, x, y))]
        for (c, name), at in levels.items():
            if c != case:
                continue
            near = np.abs(lon - at.level_mm) <= at.window_mm
            top = np.percentile(front[near], 98)
            on, low, high = near & (front >= top - 1.5), 0.4 * bridge, min(1.15 * bridge, 0.8 * half)
            side = {"left": near & (front >= top - 5) & (lat <= -low) & (lat >= -high), "right": near & (front >= top - 5) & (lat >= low) & (lat <= high)}
            for surface, (x, y) in surfaces.items():
                cx, cy = envelope(lon, x, y, at.level_mm, at.window_mm, half)
                central, inside = np.abs(cx) <= 4.5, cy >= cy.max() - 1.5
                shoulder = (np.abs(cx) > core) & (np.abs(cx) <= bridge)
                moved = {"left": np.maximum(x - lat, 0)[side["left"]], "right": np.maximum(lat - x, 0)[side["right"]]}
                w = {"width": np.ptp(x[on]), "envelope_width": np.ptp(cx[inside]), "central_height": np.interp(0, cx, cy), "ridge_lateral": cx[cy.argmax()], "curvature": np.polyfit(cx[central], cy[central], 2)[0], "prominence": np.interp(0, cx, cy) - cy[shoulder].max()}
                for n in side:
                    w |= {f"{n}_vertices": side[n].sum(), f"{n}_lateral": np.median(x[side[n]]), f"{n}_anterior": np.median(y[side[n]]), f"{n}_medial": np.median(moved[n][moved[n] > 1e-6]) if (moved[n] > 1e-6).any() else 0}
                want[case, name, surface] = w
    points = spark.createDataFrame(rows, "case_id string, vid long, surface string, longitudinal double, lateral double, anterior double")
    at = spark.createDataFrame([(r.case_id, r.level, r.level_mm, r.window_mm, half, core, bridge) for r in levels.values()], "case_id string, level string, level_mm double, window_mm double, half_width_mm double, core_mm double, bridge_mm double")
    got = {(r.case_id, r.level, r.surface): r.asDict() for r in sections.section_report(points, at).collect()}
    assert got.keys() == want.keys() and len(got) == 24
    for k, w in want.items():
        assert got[k]["covered"] and got[k]["dent"] == (w["prominence"] < -0.05)
        for name, value in w.items():
            assert got[k][name] == pytest.approx(value, abs=1e-7), (k, name)
    assert any(r["dent"] for r in got.values()) and not all(r["dent"] for r in got.values())


def test_acceptance_along_and_across(spark):
    n = 64
    shape = np.exp(-(((np.arange(n) + 0.5) / n - 0.4) ** 2) / 0.02) * 2.0
    profile, rows, strips = [], [], []
    # What each case has beside a good result: (share of the request met, change of its sections, strip, levels, asked for)
    cases = {
        "good": (1.0, {}, False, True), "short": (0.5, {}, False, True), "dent": (1.0, {"dent": True}, False, True), "wide": (1.0, {"width": 10.2}, False, True), "narrow": (1.0, {"width": 8.0}, False, True),
        "outward": (1.0, {"right_lateral": 5.1}, False, True), "strip": (1.0, {}, True, True), "still": (1.0, {"central_height": 20.0}, False, True), "none": (0.0, {"dent": True}, True, False),
    }
    for case, (share, change, strip, asks) in cases.items():
        profile += [(case, i, (i + 0.5) / n, 20.0, 20.0 - float(r) * share * asks, 20.0 - float(r) * asks, float(r) * asks, 2.0 * asks) for i, r in enumerate(shape)]
        strips.append((case, strip))
        for level in ("upper_dorsum", "mid_dorsum"):
            source = {"central_height": 20.0, "width": 10.0, "left_lateral": -5.0, "right_lateral": 5.0, "dent": False}
            after = source | {"central_height": 18.5, "width": 9.6, "left_lateral": -4.9, "right_lateral": 4.9} | (change if level == "mid_dorsum" or case == "still" else {})
            rows += [(case, level, surface, *[float(x[c]) for c in ("central_height", "width", "left_lateral", "right_lateral")], x["dent"]) for surface, x in (("source", source), ("simulated", after))]
    got = {
        r.case_id: r
        for r in sections.reduction_acceptance(
            spark.createDataFrame(profile, "case_id string, position int, normalized double, source double, final double, target double, requested double, applied double"),
            spark.createDataFrame(rows, "case_id string, level string, surface string, central_height double, width double, left_lateral double, right_lateral double, dent boolean"),
            spark.createDataFrame(strips, "case_id string, strip boolean"),
        ).collect()
    }
    assert {c for c, r in got.items() if r.passed} == {"good", "none"}
    assert got["good"].corrected_sections == 2 and not got["short"].profile_passed and got["short"].frontal_passed
    assert [c for c in got if not got[c].no_central_dent] == ["dent"] or {c for c, r in got.items() if not r.no_central_dent} == {"dent", "still"}
    assert not got["wide"].no_width_expansion and not got["narrow"].mild_narrowing and not got["outward"].sidewalls_not_outward and not got["strip"].no_center_strip
    assert got["still"].corrected_sections == 0 and not got["still"].frontal_passed
