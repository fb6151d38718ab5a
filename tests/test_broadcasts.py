"""What grows with a mesh or a cloud isn't sent to the driver to be broadcast."""

import pytest
from gaugeflow.operators import compare, quantiles, robust, scale, smoothing, surfaces
from gaugeflow.sources.scratch import written
from pyspark.sql import functions as F


@pytest.fixture
def plans(monkeypatch):
    """The plans of scratch tables as they are written, by name."""
    seen = {}

    def noted(df, name):
        seen.setdefault(name, []).append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    for module in (surfaces, smoothing, robust):
        monkeypatch.setattr(module, "written", noted)
    return seen


def test_points_of_cells_meet_triangles_by_a_shuffle(spark, plans):
    points = written(spark.createDataFrame([(1, 0.2, 0.2, 0.5), (2, 5.0, 5.0, 0.0)], "point_id long, x double, y double, z double"), "points")
    triangles = spark.createDataFrame([(7, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0)], "fid long, " + ", ".join(f"{n}{c} double" for n in "abc" for c in "xyz"))
    got = {r.point_id: r.distance for r in surfaces.closest_on_surface(points, triangles, 1.0).collect()}
    assert got[1] == 0.5 and abs(got[2] - 40.5**0.5) < 1e-12
    assert len(plans["closest"]) > 1 and not any("Broadcast" in p for p in plans["closest"])


def test_no_round_of_a_solution_is_broadcast(spark, plans):
    role = lambda i: "boundary" if i % 6 in (0, 5) or i < 6 or i >= 30 else "free" if i % 2 else "constraint"
    nodes = spark.createDataFrame([("m", i, role(i), 0.1, 0.0, 0.5, 0.2) for i in range(36)], "mesh string, vid long, role string, target0 double, target1 double, limit0 double, limit1 double")
    faces = spark.createDataFrame([("m", 2 * i + h, *((i, i + 1, i + 6), (i + 1, i + 7, i + 6))[h]) for i in range(30) if i % 6 < 5 for h in (0, 1)], "mesh string, fid long, v0 long, v1 long, v2 long")
    assert smoothing.smooth_offsets(faces, nodes).count() == 36
    products = plans["cg"][1::2]  # each round writes the state, then the product
    assert products and not any("Broadcast" in p for p in products)


def test_pairs_of_a_large_group_are_spread(spark, monkeypatch):
    monkeypatch.setattr(compare, "BLOCK", 16)
    ids = [("g", i, float(i % 7)) for i in range(100)] + [("h", i, 1.0) for i in range(3)] + [(None, i, 1.0) for i in range(2)]
    pairs = compare.pairs_within(written(spark.createDataFrame(ids, "k string, id long, v double"), "rows"), ["k"], "id", "v")
    got = sorted(map(tuple, pairs.collect()))
    assert got == sorted((g, i, j, abs(v - w)) for g, i, v in ids for h, j, w in ids if g and g == h and i < j)
    made = pairs.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()
    assert len(made) > 8 and max(r["count"] for r in made) < 1200  # of 4,953


def test_pixels_are_not_broadcast(spark):
    frames = written(spark.createDataFrame([(1,), (2,)], "frame_id long"), "frames")
    pixels = frames.selectExpr("frame_id", "explode(sequence(0L, 3L)) AS p").selectExpr("frame_id", "p DIV 2 AS px", "p % 2 AS py", "1D AS depth", "2L AS confidence")
    seen = spark.createDataFrame([("i", 5, 2.0, 0.0, 1.0, None), ("j", 6, 4.0, 1.0, 1.0, 200), ("j", 7, 4.0, 1.0, 1.0, 9)], "image string, point_id long, z double, u double, v double, mask int")
    index = spark.createDataFrame([("i", 1), ("j", 2)], "image string, frame_id long")
    got = scale.depth_ratios(seen, index, pixels, 2.0, 2.0, 2, 2)
    assert sorted(map(tuple, got.collect())) == [("i", 5, 0.5), ("j", 6, 0.25)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_values_of_filtered_groups_meet_their_counts_by_a_shuffle(spark, plans):
    rows = [(g, float(v)) for g in range(15) for v in [10, 11, 12, 13, 90][: 5 if g else 3]] + [(None, 10.0)] * 9
    found = robust.mad_filtered(written(spark.createDataFrame(rows, "g long, v double"), "rows"), "g", "v", least=5)
    assert tuple(found.first()) == (14, 70, 56, 11.5, pytest.approx(100 / 11.5), False)
    assert plans["ratios"] and not any("Broadcast" in p for p in plans["ratios"])


def test_values_are_not_shuffled_to_the_bounds_of_their_percentile(spark, tmp_path):
    spark.range(30_000).selectExpr("id % 29989 * 1D AS v").write.parquet(str(tmp_path / "v"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where a table is too large for Spark to see that its bounds are one row
    try:
        out = quantiles.exact_percentiles(spark.read.parquet(str(tmp_path / "v")), [], {"m": (F.col("v"), 0.5)})
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        values = sorted(i % 29989 for i in range(30_000))
        assert out.first()["m"] == (values[14999] + values[15000]) / 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
