"""Smooth fields over surfaces, the reduction of a ridge, oriented normals, and rays that meet a surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import captures, deformation, exports, mesh, neighbors, orientation, rays, repeatability, smoothing, solve
from ..operators.profiles import profile_acceptance
from ..sources.scratch import written
from .registry import query, rounded
from .roles import SQL, cloud, faces, repeated_cases, ridged_case, sheet, sheet_triangles, table, vertices


@query()
def smooth_offsets(spark, d):
    """Constraints and boundary on the sheet's grid; ``residual`` is the solution's, relative to what pulls."""
    points = table(spark, d, "embeddings").selectExpr("vec_id AS vid", "vec_id % 50 AS i", "vec_id DIV 50 AS j", "abs(CAST(embedding[0] AS DOUBLE)) AS target0", "CAST(embedding[1] AS DOUBLE) AS target1")
    size = points.agg(F.max("j").alias("last"))
    edge = F.least(F.col("i"), 49 - F.col("i"), F.col("j"), F.col("last") - F.col("j"))
    role = F.when(edge == 0, "boundary").when((edge == 1) | (F.col("vid") % 3 == 0), "free").otherwise("constraint")
    nodes = points.join(size, F.lit(True)).select(F.lit("sheet").alias("mesh"), "vid", role.alias("role"), "target0", "target1", F.lit(0.5).alias("limit0"), F.lit(0.2).alias("limit1"))
    cells = points.where("i < 49").join(size, F.lit(True)).where("j < last")
    corners = F.explode(F.expr("array(struct(vid * 2 AS fid, vid AS v0, vid + 1 AS v1, vid + 50 AS v2), struct(vid * 2 + 1 AS fid, vid + 1 AS v0, vid + 51 AS v1, vid + 50 AS v2))")).alias("f")
    faces = cells.select(F.lit("sheet").alias("mesh"), corners).select("mesh", "f.*")
    return rounded(smoothing.smooth_offsets(faces, nodes, tolerance=1e-11).drop("mesh"), "offset0", "offset1")


@query()
def ridge_reduction(spark, d):
    """Two millimetres off the ridge of a made case; what moved, how far, and where."""
    moved, _ = deformation.reduce_ridge(*ridged_case(spark, d), 2.0)
    return rounded(moved.select("case_id", "vid", "role", "posterior_mm", "lateral_mm", "displacement_mm", "x", "y", "z"), "posterior_mm", "lateral_mm", "displacement_mm")


@query()
def ridge_acceptance(spark, d):
    """Whether that reduction met what was asked of it."""
    _, profiles = deformation.reduce_ridge(*ridged_case(spark, d), 2.0)
    return profile_acceptance(profiles, "case_id")


@query()
def oriented_normals(spark, d):
    """Planes through the sheet's points and their nearest ones, all made to point up on the whole."""
    points = sheet(spark, d).withColumnRenamed("vid", "point_id")
    near = neighbors.knn(points, 8, 0.02)
    at = points.select(F.col("point_id").alias("neighbor_id"), *[F.col(c).alias("n" + c) for c in "xyz"])
    planes = solve.local_planes(near.join(at, "neighbor_id")).select("point_id", *[F.col("normal")[i].alias(f"n{c}") for i, c in enumerate("xyz")])
    up = points.select("point_id", F.lit(0.0).alias("rx"), F.lit(0.0).alias("ry"), F.lit(1.0).alias("rz"))
    return rounded(orientation.orient_normals(planes, near, up).select("point_id", "nx", "ny", "nz", "turned", "component").drop("turned"), "nx", "ny", "nz")




@query(f"""WITH {SQL["sheet"]}, {SQL["triangles"]},
rays AS (SELECT vec_id AS ray_id, vec_id % 50 * CAST(0.01 AS DOUBLE) + CAST(0.003 AS DOUBLE) AS ox, vec_id // 50 * CAST(0.01 AS DOUBLE) + CAST(0.004 AS DOUBLE) AS oy, CAST(0.3 AS DOUBLE) AS oz,
CAST(embedding[3] AS DOUBLE) AS dx, CAST(embedding[4] AS DOUBLE) AS dy, CAST(-1 AS DOUBLE) AS dz, label AS landmark FROM embeddings),
e AS (SELECT *, bx - ax AS ux, "by" - ay AS uy, bz - az AS uz, cx - ax AS vx, cy - ay AS vy, cz - az AS vz FROM triangles),
p AS (SELECT ray_id, ox, oy, oz, dx, dy, dz, landmark, fid, ux, uy, uz, vx, vy, vz, dy * vz - dz * vy AS px, dz * vx - dx * vz AS py, dx * vy - dy * vx AS pz, ox - ax AS sx, oy - ay AS sy, oz - az AS sz FROM rays, e),
q AS (SELECT *, ux * px + uy * py + uz * pz AS det, sx * px + sy * py + sz * pz AS su, sy * uz - sz * uy AS qx, sz * ux - sx * uz AS qy, sx * uy - sy * ux AS qz FROM p),
h AS (SELECT *, su / det AS u, (dx * qx + dy * qy + dz * qz) / det AS v, (vx * qx + vy * qy + vz * qz) / det AS t FROM q WHERE det <> 0),
m AS (SELECT *, row_number() OVER (PARTITION BY ray_id ORDER BY t, fid) AS k FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t > 0)
SELECT ray_id, landmark, fid, round(t, 9) AS t, round(ox + t * dx, 9) AS x, round(oy + t * dy, 9) AS y, round(oz + t * dz, 9) AS z FROM m
WHERE k = 1 AND sqrt((ox + t * dx - CAST(0.25 AS DOUBLE)) ** 2 + (oy + t * dy - CAST(0.05 AS DOUBLE)) ** 2 + (oz + t * dz) ** 2) <= CAST(0.2 AS DOUBLE)""")
def surface_observations(spark, d):
    """Rays from above in many directions; hits within 0.2 of the middle of the sheet."""
    up = table(spark, d, "embeddings").selectExpr("vec_id AS ray_id", "vec_id % 50 * 0.01D + 0.003D AS ox", "vec_id DIV 50 * 0.01D + 0.004D AS oy", "0.3D AS oz", "CAST(embedding[2] AS DOUBLE) AS dx", "CAST(embedding[3] AS DOUBLE) AS dy", "-1D AS dz", "label AS landmark")
    middle = up.select("landmark").distinct().select("landmark", *[v.alias(f"e{c}") for v, c in zip(V.numbers(0.25, 0.05, 0.0), "xyz")])
    return rounded(rays.surface_observations(up, sheet_triangles(spark, d), middle, 0.2), "t", "x", "y", "z", digits=9)


@query()
def surface_repeatability(spark, d):
    """Three captures of one surface, compared in pairs after rigid alignment."""
    got = repeatability.surface_repeatability(*repeated_cases(spark, d), least_nasal=100)
    return rounded(got, "landmark_scale", "icp_fitness", "icp_rmse_mm", "median_mm", "p95_mm", "p99_mm", digits=4)


@query(f"""WITH {SQL["mesh"]}, f AS (SELECT *, mesh || '|' || v0 || '|' || v1 || '|' || v2 AS fid, (v0 * 31 + v1 * 17 + v2) % 97 AS k FROM faces),
c AS (SELECT mesh, fid, k, unnest([0, 1, 2]) AS corner, unnest([v0, v1, v2]) AS a, unnest(CASE WHEN k = 2 THEN [v1, v0, v2] ELSE [v0, v1, v2] END) AS b FROM f),
j AS (SELECT c.mesh, fid, k, a, b, sqrt((pa.x - pb.x) ** 2 + (pa.y - pb.y) ** 2 + (pa.z - CASE WHEN k = 1 THEN pb.z + CAST(0.25 AS DOUBLE) ELSE pb.z END) ** 2) AS d FROM c JOIN vertices pa ON pa.mesh = c.mesh AND pa.vid = a JOIN vertices pb ON pb.mesh = c.mesh AND pb.vid = b WHERE k <> 3),
e AS (SELECT mesh, fid, any_value(k) AS k, max(d) AS d, count(*) FILTER (WHERE d > 1e-6) AS bad FROM j GROUP BY 1, 2)
SELECT f.mesh, count(*) AS faces, count(*) FILTER (WHERE f.k <> 3) AS rendered_faces, count(*) FILTER (WHERE f.k = 3) AS missing, round(max(d), 9) AS maximum_deviation, count(*) FILTER (WHERE bad > 0 AND f.k = 2) AS swapped, count(*) FILTER (WHERE bad > 0 AND f.k <> 2) AS moved
FROM f LEFT JOIN e ON f.mesh = e.mesh AND f.fid = e.fid GROUP BY f.mesh""")
def export_verification(spark, d):
    """The meshes of lineitem, rendered with vertices of each face's own; some faces are off, some turned, some lost."""
    f = faces(spark, d)
    few = table(spark, d, "embeddings").count() <= 1 << 20
    # Short ids, as corners below 2^20 fit one number; larger ones are spelt out.
    fid = F.expr("shiftleft(v0, 40) | shiftleft(v1, 20) | v2") if few else F.concat_ws("|", "v0", "v1", "v2")
    own_vid = (lambda corner: F.col("fid") * 4 + corner) if few else (lambda corner: F.concat_ws("#", "fid", corner))
    f = written(f.select("mesh", fid.alias("fid"), "v0", "v1", "v2"), "faces")
    marked = f.withColumn("k", (F.col("v0") * 31 + F.col("v1") * 17 + F.col("v2")) % 97)
    own = marked.where("k <> 3").select("mesh", "fid", "k", F.posexplode(F.expr("IF(k = 2, array(v1, v0, v2), array(v0, v1, v2))")).alias("corner", "at"))
    at = mesh.placed(own, vertices(spark, d), {"at": "p"}, most=exports.MOST_PLACES).withColumn("vid", own_vid(F.col("corner")))
    points = at.selectExpr("mesh", "vid", "p.x", "p.y", "IF(k = 1, p.z + 0.25D, p.z) AS z")
    rendered = marked.where("k <> 3").select("mesh", "fid", *[own_vid(F.lit(i)).alias(f"v{i}") for i in range(3)])
    got = exports.export_verification(vertices(spark, d), f, points, rendered)
    return rounded(got.select("mesh", "faces", "rendered_faces", "missing", "maximum_deviation", "swapped", "moved"), "maximum_deviation", digits=9)


_TURN = "least(1, abs((qx*pqx + qy*pqy + qz*pqz + qw*pqw) / (sqrt(qx*qx+qy*qy+qz*qz+qw*qw) * sqrt(pqx*pqx+pqy*pqy+pqz*pqz+pqw*pqw))))"


@query(f"""WITH {SQL["cloud"]}, l AS (SELECT *, {", ".join(f"lag({c}) OVER w AS p{c}" for c in ("x", "y", "z", "qx", "qy", "qz", "qw", "ts"))} FROM cloud WINDOW w AS (PARTITION BY case_id ORDER BY point_id)),
m AS (SELECT *, ts - pts AS interval, sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)) AS step, degrees(2 * acos({_TURN})) AS angle FROM l),
d AS (SELECT case_id, point_id, -2 * (qx * qz + qy * qw) / n AS vx, -2 * (qy * qz - qx * qw) / n AS vy, -(1 - 2 * (qx * qx + qy * qy) / n) AS vz FROM (SELECT *, qx*qx + qy*qy + qz*qz + qw*qw AS n FROM cloud)),
u AS (SELECT case_id, point_id, vx / s AS vx, vy / s AS vy, vz / s AS vz FROM (SELECT *, sqrt(vx*vx + vy*vy + vz*vz) AS s FROM d)),
o AS (SELECT a.case_id, degrees(acos(greatest(-1, min(a.vx*b.vx + a.vy*b.vy + a.vz*b.vz)))) AS coverage FROM u a JOIN u b ON a.case_id = b.case_id AND a.point_id < b.point_id GROUP BY 1)
SELECT case_id, count(*) AS frame_count, CAST(1920 AS INTEGER) AS longest_side, round(any_value(coverage), 2) AS orientation_coverage_degrees, count(*) FILTER (WHERE step > 0.15) AS tracking_jump_count, round(quantile_cont(step / interval, 0.95), 3) AS linear_speed_p95_m_per_s, round(quantile_cont(angle / interval, 0.95), 2) AS angular_speed_p95_deg_per_s,
round((max(1500 + abs(x)) - min(1500 + abs(x))) / avg(1500 + abs(x)) * 100, 3) AS focal_length_drift_percent, count(*) FILTER (WHERE point_id % 5 <> 0) AS depth_frame_count, round_even(count(*) FILTER (WHERE point_id % 5 <> 0) / count(*), 4) AS depth_frame_coverage FROM m JOIN o USING (case_id) GROUP BY case_id""")
def capture_validation(spark, d):
    """Cases of embeddings as captures: four frames in five have depth."""
    frames = cloud(spark, d).selectExpr("*", "point_id AS frame_id", "1500 + abs(x) AS fx", "point_id % 5 <> 0 AS has_depth", "false AS has_confidence")
    sizes = frames.select("case_id").distinct().selectExpr("case_id", "1920 AS width", "1440 AS height")
    got = captures.capture_validation(frames, sizes)
    return got.select("case_id", "frame_count", "longest_side", "orientation_coverage_degrees", "tracking_jump_count", "linear_speed_p95_m_per_s", "angular_speed_p95_deg_per_s", "focal_length_drift_percent", "depth_frame_count", "depth_frame_coverage")
