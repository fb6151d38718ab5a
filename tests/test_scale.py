"""Faults that showed on larger tables only, on small ones made to hold them."""

import numpy as np
from pyspark.sql import functions as F

from gaugeflow.functions.text import duration_label
from gaugeflow.operators import mesh, neighbors, quantiles
from gaugeflow.plans import roles


def test_durations_are_rounded_by_their_exact_value(spark):
    s = [8820.0, 9000.0, 6660.0, 5399.999999999999, 5397.0, 93.0, 99.0, 1e12, 2.0**52] + (np.arange(150, 90_000, 7) * 0.7001).tolist()
    got = [r.d for r in spark.createDataFrame([(i, x) for i, x in enumerate(s)], "i long, s double").withColumn("d", duration_label(F.col("s"))).orderBy("i").collect()]
    assert got == [f"{x:.0f}s" if x < 90 else f"{x / 60:.1f}m" if x < 5400 else f"{x / 3600:.1f}h" for x in s]


def test_percentiles_of_large_and_small_groups_broadcast_their_bounds_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quantiles, "SMALL", 2000)
    g = np.random.default_rng(1)
    values = {"a": g.normal(size=9000), "b": np.repeat([1.0, 2.0, 5.0], 2000), "c": np.array([3.0, 4.0]), None: g.uniform(size=4000)}
    rows = [(k, float(v)) for k, vs in values.items() for v in vs] + [("d", None)]
    spark.createDataFrame(rows, "k string, v double").write.parquet(str(tmp_path / "v"))
    out = quantiles.exact_percentiles(spark.read.parquet(str(tmp_path / "v")), ["k"], {"m": (F.col("v"), 0.5), "h": (F.col("v"), 0.95)})
    assert "BuildLeft" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.k: (r.m, r.h) for r in out.collect()}
    assert got.pop("d") == (None, None) and set(got) == set(values)
    for k, v in values.items():
        np.testing.assert_allclose(got[k], np.quantile(v, [0.5, 0.95]), rtol=1e-12)


def test_faces_arent_shuffled_to_meet_few_vertices_and_shuffles_start_with_partitions_for_the_input(spark, tmp_path, monkeypatch):
    v = spark.range(20_000).selectExpr("'m' AS mesh", "id AS vid", "CAST(id AS DOUBLE) AS x", "0D AS y", "1D AS z")
    f = spark.createDataFrame([("m", 0, 1, 2, 5), ("m", 1, 1, 2, 99_999)], "mesh string, fid long, v0 long, v1 long, v2 long")
    got = mesh.with_points(f, v)
    assert [(r.fid, r.p0.x, r.p2.x) for r in got.collect()] == [(0, 1.0, 5.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    name, size = "spark.sql.adaptive.coalescePartitions.initialPartitionNum", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    monkeypatch.setattr(roles, "SPREAD_BYTES", 10)
    spark.range(1000).write.parquet(str(tmp_path / "t.parquet"))
    assert roles.table(spark, str(tmp_path), "t").count() == 1000 and int(spark.conf.get(name)) > 100
    spark.conf.unset(name)
    spark.conf.set(size, before)


def test_nearest_within_and_parted_pairs_are_those_of_brute_force(spark, monkeypatch):
    g = np.random.default_rng(3)
    p = np.concatenate([g.normal(scale=0.02, size=(150, 3)), g.uniform(-1, 1, (5, 3))])
    q = np.concatenate([g.normal(scale=0.02, size=(60, 3)), g.uniform(-1, 1, (30, 3))])
    table = lambda a, start: spark.createDataFrame([(start + i, *map(float, x)) for i, x in enumerate(a)], "point_id long, x double, y double, z double")
    far = np.linalg.norm(q[:, None] - p[None], axis=2)
    points, queries = table(p, 0), table(q, 1000)
    size = neighbors.fine_size(points, 0.4)
    assert size < 0.4
    got = {r.point_id: (r.neighbor_id, r.distance) for r in neighbors.nearest_within(points, queries, 0.4, size).collect()}
    assert set(got) == {1000 + i for i in range(len(q)) if far[i].min() <= 0.4}
    for k, (i, d) in got.items():
        assert i == far[k - 1000].argmin() and abs(d - far[k - 1000].min()) < 1e-12
    whole = {(r.point_id, r.neighbor_id) for r in neighbors.radius_pairs(points, 0.1, queries).collect()}
    monkeypatch.setattr(neighbors, "POINTS_A_PART", 30)
    rows = neighbors.radius_pairs(points, 0.1, queries.withColumn("own", F.col("z")), keep=("own",), places=True).collect()
    assert len(rows) == len(whole) and {(r.point_id, r.neighbor_id) for r in rows} == whole == {(1000 + i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(far <= 0.1)))}
    assert all(r.nx == p[r.neighbor_id][0] and r.own == q[r.point_id - 1000][2] for r in rows)
