"""One query an operator, over whole tables. Numbers whose last digits depend on the order of a sum are rounded."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..functions.text import duration_label, reduction_label
from ..operators import compare, gates, geometry, mesh, neighbors, profiles, registration, reports, robust, scale, sections, solve, state, surfaces
from ..operators import series as S
from ..operators.components import connected_components
from ..sources.scratch import written
from .registry import query, rounded
from .roles import SQL, cases, cloud, faces, probes, series, sheet, sheet_triangles, table, triangles_of, vertices


@query(f"""WITH {SQL["series"]}, b AS (SELECT min(us) t0, max(us) t1, least(count(*), 120) n FROM series),
p AS (SELECT ((us - t0) * n) // (t1 - t0 + 1) AS "window", event_id, us, value FROM series, b),
r AS (SELECT *, row_number() OVER (PARTITION BY "window" ORDER BY value DESC, event_id) AS k FROM p)
SELECT "window", event_id, us, value FROM r WHERE k = 1 AND value >= 35""")
def window_top1(spark, d):
    return S.window_top1(series(spark, d), "us", "value", "event_id", 120, 35.0)


_Q = "least(1, abs((qx*pqx + qy*pqy + qz*pqz + qw*pqw) / (sqrt(qx*qx+qy*qy+qz*qz+qw*qw) * sqrt(pqx*pqx+pqy*pqy+pqz*pqz+pqw*pqw))))"


@query(f"""WITH {SQL["cloud"]}, l AS (SELECT *, {", ".join(f"lag({c}) OVER w AS p{c}" for c in ("x", "y", "z", "qx", "qy", "qz", "qw", "ts"))} FROM cloud WINDOW w AS (PARTITION BY case_id ORDER BY point_id)),
m AS (SELECT *, ts - pts AS interval, sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)) AS step, degrees(2 * acos({_Q})) AS angle FROM l)
SELECT case_id, count(*) AS n, round(max(ts) - min(ts), 6) AS duration, round((count(*) - 1) / (max(ts) - min(ts)), 6) AS rate, round(quantile_cont(interval, 0.95) * 1000, 6) AS interval_p95_ms, round(sum(step), 6) AS path_length,
round(sqrt((max(x)-min(x))*(max(x)-min(x)) + (max(y)-min(y))*(max(y)-min(y)) + (max(z)-min(z))*(max(z)-min(z))), 6) AS span, count(*) FILTER (WHERE step > 0.15) AS jumps,
round(quantile_cont(step / interval, 0.95), 6) AS linear_p95, round(quantile_cont(angle / interval, 0.95), 6) AS angular_p95, min(interval) > 0 AS strictly_increasing FROM m GROUP BY case_id""")
def step_speed_summary(spark, d):
    q = tuple(F.col(c) for c in ("qx", "qy", "qz", "qw"))
    moved = S.adjacent_motion(cloud(spark, d), "case_id", "point_id", "ts", V.columns(""), q)
    return rounded(S.motion_summary(moved, "case_id", "ts", V.columns("")), "duration", "rate", "interval_p95_ms", "path_length", "span", "linear_p95", "angular_p95")


@query(f"""WITH {SQL["series"]} SELECT event_type, round(quantile_cont(value, 0.1) FILTER (WHERE user_id % 2 = 0), 6) AS selected_p10, round(quantile_cont(value, 0.5) FILTER (WHERE user_id % 2 = 0), 6) AS selected_p50,
round(quantile_cont(value, 0.5), 6) AS all_p50, round(quantile_cont(value, 0.95) - quantile_cont(value, 0.05), 6) AS all_range FROM series GROUP BY event_type""")
def series_quality_summary(spark, d):
    return rounded(S.conditional_percentiles(series(spark, d), ["event_type"], "value", F.col("user_id") % 2 == 0), "selected_p10", "selected_p50", "all_p50", "all_range")


@query(f"""WITH {SQL["series"]}, l AS (SELECT user_id, us - lag(us) OVER (PARTITION BY user_id ORDER BY event_id) AS gap FROM series)
SELECT user_id, count(*) AS n, coalesce(min(gap) > 0, true) AS strictly_increasing, min(gap) AS shortest FROM l GROUP BY user_id""")
def strict_monotonic_check(spark, d):
    gap = series(spark, d).selectExpr("user_id", "us - lag(us) OVER (PARTITION BY user_id ORDER BY event_id) AS gap")
    return gap.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.min("gap") > 0, F.lit(True)).alias("strictly_increasing"), F.min("gap").alias("shortest"))


@query("SELECT conv_id, count(*) AS n, coalesce(min(turn) = 0 AND max(turn) = count(turn) - 1 AND count(DISTINCT turn) = count(*), false) AS contiguous FROM conversations GROUP BY conv_id")
def contiguity_check(spark, d):
    return S.contiguity(table(spark, d, "conversations"), "conv_id", "turn")


#: Gates for the metrics of a user's events, in whole cents where they are money.
_USER_GATES = [("volume", "user.events", "min", 60.0, None, 45.0, None, ""), ("value", "user.top", "max", None, 30000.0, None, 40000.0, "cent"), ("value", "user.mean", "range", 3000.0, 6000.0, 2000.0, 8000.0, "cent"), ("value", "user.sparse", "min", 1.0, None, 0.5, None, "")]
_CHECKS = f"""{SQL["series"]}, m AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(max(round(value * 100)) AS DOUBLE) AS top, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE) / count(*) AS mean FROM series GROUP BY user_id),
c AS (SELECT user_id, 'volume' AS section, 'user.events' AS check_id, n AS value, CASE WHEN n >= 60 THEN 'PASS' WHEN n >= 45 THEN 'WARN' ELSE 'FAIL' END AS status FROM m
UNION ALL SELECT user_id, 'value', 'user.top', top, CASE WHEN top <= 30000 THEN 'PASS' WHEN top <= 40000 THEN 'WARN' ELSE 'FAIL' END FROM m
UNION ALL SELECT user_id, 'value', 'user.mean', mean, CASE WHEN mean BETWEEN 3000 AND 6000 THEN 'PASS' WHEN mean < 2000 OR mean > 8000 THEN 'FAIL' ELSE 'WARN' END FROM m
UNION ALL SELECT user_id, 'value', 'user.sparse', CAST(NULL AS DOUBLE), 'WARN' FROM m WHERE user_id % 5 = 0
UNION ALL SELECT user_id, 'value', 'user.sparse', CAST(1 AS DOUBLE), 'PASS' FROM m WHERE user_id % 5 <> 0)"""


def _user_checks(spark, d) -> DataFrame:
    cents = F.rint(F.col("value") * 100).cast("long")
    m = series(spark, d).groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.max(cents).cast("double").alias("top"), (F.sum(cents).cast("double") / F.count(F.lit(1))).alias("mean"), F.when(F.col("user_id") % 5 != 0, 1.0).alias("sparse"))
    rows = gates.unpivot(m, ["user_id"], {"n": "user.events", "top": "user.top", "mean": "user.mean", "sparse": "user.sparse"})
    return gates.evaluate(rows, gates.thresholds(spark, _USER_GATES))


@query(f"WITH {_CHECKS} SELECT user_id, section, check_id, value, status FROM c")
def gate_min_max_range(spark, d):
    return _user_checks(spark, d).select("user_id", "section", "check_id", "value", "status")


_RANK = "CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END"


@query(f"WITH {_CHECKS} SELECT user_id, section, {_RANK} AS status, count(*) AS checks FROM c GROUP BY user_id, section UNION ALL SELECT DISTINCT user_id, 'notes', 'WARN', 0 FROM c")
def gate_rollup_worst(spark, d):
    checks = _user_checks(spark, d)
    sections = checks.select("user_id").distinct().withColumn("section", F.explode(F.array(F.lit("volume"), F.lit("value"), F.lit("notes"))))
    return gates.worst(checks, ["user_id", "section"], sections)


@query(f"""WITH {_CHECKS} SELECT user_id, {_RANK} AS status, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (WHERE status = 'FAIL'), '') AS failed, coalesce(string_agg(check_id, ',' ORDER BY check_id) FILTER (WHERE status = 'WARN'), '') AS warned, count(DISTINCT section) AS sections FROM c GROUP BY user_id""")
def gate_report_lists(spark, d):
    r = gates.report(_user_checks(spark, d), ["user_id"])
    return r.select("user_id", "status", F.array_join("failed", ",").alias("failed"), F.array_join("warned", ",").alias("warned"), F.size("sections").cast("long").alias("sections"))


@query(f"""WITH {SQL["series"]}, u AS (SELECT user_id, event_type, CAST(round(value * 100) AS BIGINT) AS u FROM series), s AS (SELECT user_id, event_type, count(*) AS n, CAST(sum(u) AS BIGINT) AS s, CAST(sum(u * u) AS BIGINT) AS q, max(u) - min(u) AS r FROM u GROUP BY ALL HAVING count(*) >= 2),
t AS (SELECT *, s / (CAST(100 AS DOUBLE) * n) AS mean, sqrt(CAST(n * q - s * s AS DOUBLE) / CAST(n * (n - 1) AS DOUBLE)) / CAST(100 AS DOUBLE) AS sd FROM s)
SELECT user_id, event_type, n, mean, sd, CASE WHEN s <> 0 THEN abs(sd / mean) * 100 END AS cv_percent, r / CAST(100 AS DOUBLE) AS range FROM t""")
def repeatability_stats(spark, d):
    return compare.repeatability(series(spark, d), ["user_id", "event_type"], "value", 100)


_YEAR = "SELECT o_custkey, nullif(o_orderpriority, '1-URGENT') AS priority, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents FROM orders WHERE year(o_orderdate) % 2 = {} GROUP BY ALL"


@query(f"""WITH t AS ({_YEAR.format(0)}), p AS ({_YEAR.format(1)})
SELECT coalesce(t.o_custkey, p.o_custkey) AS o_custkey, coalesce(t.priority, p.priority) AS priority, t.cents AS true_value, p.cents AS predicted, p.cents - t.cents AS error, abs(p.cents - t.cents) AS absolute_error
FROM t FULL JOIN p ON t.o_custkey IS NOT DISTINCT FROM p.o_custkey AND t.priority IS NOT DISTINCT FROM p.priority""")
def outer_compare(spark, d):
    o = table(spark, d, "orders").withColumn("priority", F.nullif("o_orderpriority", F.lit("1-URGENT")))
    half = lambda k: o.where(F.year("o_orderdate") % 2 == k).groupBy("o_custkey", "priority").agg(F.sum(F.rint(F.col("o_totalprice") * 100).cast("long")).alias("cents"))
    return compare.outer_compare(half(0), half(1), ["o_custkey", "priority"], "cents", "cents")


@query("SELECT a.s_nationkey, a.s_suppkey AS a, b.s_suppkey AS b, round(abs(a.s_acctbal - b.s_acctbal), 4) AS difference FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def pairwise_ptp(spark, d):
    return rounded(compare.pairs_within(table(spark, d, "supplier"), ["s_nationkey"], "s_suppkey", "s_acctbal"), "difference", digits=4)


@query("SELECT DISTINCT c_custkey AS custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def missing_keys(spark, d):
    return compare.missing_keys(table(spark, d, "customer").selectExpr("c_custkey AS custkey"), table(spark, d, "orders").selectExpr("o_custkey AS custkey"), ["custkey"])


@query("""WITH a AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 0), b AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 2 = 1),
c AS (SELECT * FROM a JOIN b USING (user_id, event_type)) SELECT user_id, event_type, n FROM c JOIN (SELECT user_id, count(*) AS n FROM c GROUP BY user_id HAVING count(*) >= 5) USING (user_id)""")
def common_landmarks(spark, d):
    e = table(spark, d, "events")
    return compare.common_keys(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"), "event_type", ["user_id"], 5)


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS \"values\" FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1")
def dependency_conflicts(spark, d):
    return compare.conflicting_keys(table(spark, d, "lineitem"), "l_partkey", "l_suppkey")


_VIEW = "qx*qx + qy*qy + qz*qz + qw*qw"
_VIEWS = f"v AS (SELECT point_id, case_id, -(s * (qx*qz + qy*qw)) AS a, -(s * (qy*qz - qx*qw)) AS b, -(1 - s * (qx*qx + qy*qy)) AS c FROM (SELECT *, CAST(2 AS DOUBLE) / CASE WHEN {_VIEW} < 1e-12 THEN 1 ELSE {_VIEW} END AS s FROM cloud)), views AS (SELECT point_id, case_id, a / sqrt(a*a + b*b + c*c) AS x, b / sqrt(a*a + b*b + c*c) AS y, c / sqrt(a*a + b*b + c*c) AS z FROM v)"


@query(f"""WITH {SQL["cloud"]}, {_VIEWS} SELECT a.case_id, round(degrees(acos(greatest(-1, least(1, min(a.x*b.x + a.y*b.y + a.z*b.z))))), 5) AS max_angle
FROM views a JOIN views b ON a.case_id = b.case_id AND a.point_id < b.point_id GROUP BY 1""")
def max_pairwise_angle(spark, d):
    """How far apart a case's views look."""
    v = V.view_direction(tuple(F.col(c) for c in ("qx", "qy", "qz", "qw")))
    views = cloud(spark, d).select("case_id", "point_id", *[x.alias(n) for x, n in zip(v, "xyz")])
    return rounded(geometry.max_pairwise_angle(views, ["case_id"], "point_id", ("x", "y", "z")), "max_angle", digits=5)


@query(f"""WITH {SQL["cloud"]}, {_VIEWS} SELECT point_id, round(x, 9) AS vx, round(y, 9) AS vy, round(z, 9) AS vz FROM views""")
def view_directions(spark, d):
    v = V.view_direction(tuple(F.col(c) for c in ("qx", "qy", "qz", "qw")))
    return rounded(cloud(spark, d).select("point_id", *[x.alias(n) for x, n in zip(v, ("vx", "vy", "vz"))]), "vx", "vy", "vz", digits=9)


@query("""WITH r AS (SELECT l_suppkey, l_extendedprice / l_quantity AS ratio FROM lineitem), g AS (SELECT l_suppkey FROM r GROUP BY 1 HAVING count(ratio) >= 15), o AS (SELECT r.* FROM r JOIN g USING (l_suppkey)),
m AS (SELECT quantile_cont(ratio, 0.5) AS m FROM o), s AS (SELECT quantile_cont(abs(ratio - m), 0.5) AS s FROM o, m), k AS (SELECT *, abs(ratio - m) <= greatest(3.5 * s, 0.01 * m) AS k FROM o, m, s), c AS (SELECT quantile_cont(ratio, 0.5) AS c FROM k WHERE k)
SELECT count(DISTINCT l_suppkey) AS groups, count(*) AS n, count(*) FILTER (WHERE k) AS kept, round(max(c), 6) AS median, round(quantile_cont(abs(ratio - c), 0.5) FILTER (WHERE k) * 100 / max(c), 6) AS mad_percent, count(DISTINCT l_suppkey) >= 15 AS enough FROM k, c""")
def mad_filtered_ratio(spark, d):
    r = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_extendedprice") / F.col("l_quantity")).alias("ratio"))
    return rounded(robust.mad_filtered(r, "l_suppkey", "ratio"), "median", "mad_percent")


@query("""WITH c AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.04) AS cut FROM lineitem GROUP BY 1) SELECT l_returnflag, count(*) AS n, round(min(l_extendedprice), 4) AS least FROM lineitem JOIN c USING (l_returnflag) WHERE l_extendedprice >= cut GROUP BY 1""")
def percentile_trim(spark, d):
    kept = robust.percentile_trim(table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    return kept.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("l_extendedprice"), 4).alias("least"))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events WHERE isfinite(value) GROUP BY 1")
def finite_percentiles(spark, d):
    return rounded(robust.finite_percentiles(table(spark, d, "events"), ["event_type"], "value", [0.05, 0.5, 0.95]), "p05", "p50", "p95")


_BANDS = [("near", 0.0, 10.0), ("middle", 10.0, 30.0), ("far", 30.0, 60.0)]


@query("""WITH b(band, lo, hi) AS (VALUES ('near', 0, 10), ('middle', 10, 30), ('far', 30, 60)), r AS (SELECT l_quantity AS dist, l_discount AS v FROM lineitem)
SELECT band, count(v) AS n, coalesce(round(quantile_cont(v, 0.5), 6), 0) AS median, coalesce(round(avg(CASE WHEN v > 0.05 THEN 1.0 ELSE 0.0 END), 6), 0) AS share FROM b LEFT JOIN r ON dist >= lo AND dist < hi GROUP BY band""")
def displacement_bands(spark, d):
    return rounded(robust.band_summary(table(spark, d, "lineitem"), "l_quantity", "l_discount", _BANDS, 0.05), "median", "share")


@query("""WITH t AS (SELECT p_brand, max(p_retailprice) AS top FROM part GROUP BY 1) SELECT p_brand, CASE WHEN count(*) FILTER (WHERE p_retailprice >= top - 50) >= 2 THEN CAST(max(p_size) FILTER (WHERE p_retailprice >= top - 50) - min(p_size) FILTER (WHERE p_retailprice >= top - 50) AS DOUBLE) ELSE 0 END AS width FROM part JOIN t USING (p_brand) GROUP BY 1""")
def section_width(spark, d):
    return robust.section_width(table(spark, d, "part"), ["p_brand"], "p_size", "p_retailprice", 50.0)


@query(f"WITH {SQL['cloud']} SELECT point_id FROM cloud WHERE sqrt((x - 0.05)*(x - 0.05) + (y + 0.02)*(y + 0.02) + (z - 0.01)*(z - 0.01)) <= 0.12")
def sphere_roi(spark, d):
    return cloud(spark, d).where(geometry.in_sphere(V.columns(""), V.numbers(0.05, -0.02, 0.01), 0.12)).select("point_id")


@query(f"""WITH {SQL["cloud"]}, s AS (SELECT *, ((x + 0.1) * 0.2 + (y + 0.1) * 0.2 + z * 0.1) / (0.2*0.2 + 0.2*0.2 + 0.1*0.1) AS t FROM cloud)
SELECT point_id FROM s WHERE t BETWEEN 0.1 AND 0.9 AND sqrt(power(x - (-0.1 + 0.2 * greatest(0, least(1, t))), 2) + power(y - (-0.1 + 0.2 * greatest(0, least(1, t))), 2) + power(z - 0.1 * greatest(0, least(1, t)), 2)) <= 0.1""")
def segment_roi(spark, d):
    inside = geometry.in_segment_tube(V.columns(""), V.numbers(-0.1, -0.1, 0.0), V.numbers(0.1, 0.1, 0.1), 0.1, 0.1, 0.9)
    return cloud(spark, d).where(inside).select("point_id")


@query(f"WITH {SQL['cloud']}, a AS (SELECT point_id, least(sqrt(power(x - 0.1, 2) + y*y + z*z), sqrt(x*x + power(y - 0.1, 2) + z*z), sqrt(x*x + y*y + power(z - 0.1, 2))) AS dist FROM cloud) SELECT point_id, round(dist, 9) AS anchor_distance FROM a WHERE dist <= 0.15")
def anchor_roi(spark, d):
    near = geometry.near_any(cloud(spark, d), ("x", "y", "z"), [(0.1, 0, 0), (0, 0.1, 0), (0, 0, 0.1)], 0.15)
    return rounded(near.select("point_id", "anchor_distance"), "anchor_distance", digits=9)


@query(f"WITH {SQL['cloud']}, i AS (SELECT *, x*x + y*y + z*z <= 0.0225 AS inside FROM cloud), n AS (SELECT case_id, count(*) FILTER (WHERE inside) AS n FROM i GROUP BY 1) SELECT point_id, case_id FROM i JOIN n USING (case_id) WHERE n < 15 OR inside")
def central_points(spark, d):
    return geometry.central_or_all(cloud(spark, d), "case_id", ("x", "y", "z"), (0.0, 0.0, 0.0), 0.15, 15).select("point_id", "case_id")


@query(f"WITH {SQL['cloud']} SELECT point_id, round((x - 0.1) * 0.6 + y * 0.8, 9) AS s, round(-(x - 0.1) * 0.8 + y * 0.6, 9) AS l, round(z - 0.2, 9) AS a FROM cloud")
def basis_projection(spark, d):
    got = geometry.basis_coordinates(V.columns(""), V.numbers(0.1, 0.0, 0.2), (V.numbers(0.6, 0.8, 0.0), V.numbers(-0.8, 0.6, 0.0), V.numbers(0.0, 0.0, 1.0)))
    return rounded(cloud(spark, d).select("point_id", *[x.alias(n) for x, n in zip(got, "sla")]), "s", "l", "a", digits=9)


@query(f"WITH {SQL['cloud']} SELECT point_id, round(0.5 * x - 0.25 * y + 1, 9) AS tx, round(0.25 * x + 0.5 * y - 2, 9) AS ty, round(2 * z + 0.5, 9) AS tz FROM cloud")
def affine_points(spark, d):
    t = V.affine(V.columns(""), [[0.5, -0.25, 0, 1], [0.25, 0.5, 0, -2], [0, 0, 2, 0.5]])
    return rounded(cloud(spark, d).select("point_id", *[x.alias("t" + n) for x, n in zip(t, "xyz")]), "tx", "ty", "tz", digits=9)


@query(f"""WITH {SQL["cloud"]} SELECT case_id, count(*) AS points, 0 AS nonfinite, {", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}, (max({c}) - min({c})) * 10 AS extent_{c}" for c in "xyz")} FROM cloud GROUP BY 1""")
def bbox_finite(spark, d):
    return geometry.bounding_box(cloud(spark, d), ["case_id"], 10.0)


@query("""WITH p AS (SELECT p_partkey, CAST(1300 + p_size AS DOUBLE) AS fx, CAST(1310 + p_size AS DOUBLE) AS fy, CAST(p_retailprice AS DOUBLE) AS cx, CAST(700 + p_size AS DOUBLE) AS cy, ['none', 'clockwise', 'counterclockwise', 'half'][1 + p_partkey % 4] AS r FROM part)
SELECT p_partkey, (CASE WHEN r IN ('none', 'half') THEN fx ELSE fy END) * 0.5 AS fx, (CASE WHEN r IN ('none', 'half') THEN fy ELSE fx END) * 0.5 AS fy,
round((CASE r WHEN 'none' THEN cx WHEN 'clockwise' THEN 1439 - cy WHEN 'counterclockwise' THEN cy ELSE 1919 - cx END) * 0.5, 6) AS cx, round((CASE r WHEN 'none' THEN cy WHEN 'clockwise' THEN cx WHEN 'counterclockwise' THEN 1919 - cx ELSE 1439 - cy END) * 0.5, 6) AS cy FROM p""")
def intrinsics_rotation(spark, d):
    p = table(spark, d, "part").selectExpr("p_partkey", "CAST(1300 + p_size AS DOUBLE) AS fx", "CAST(1310 + p_size AS DOUBLE) AS fy", "p_retailprice AS cx", "CAST(700 + p_size AS DOUBLE) AS cy", "array('none', 'clockwise', 'counterclockwise', 'half')[CAST(p_partkey % 4 AS INT)] AS r")
    k = geometry.rotated_intrinsics(F.col("fx"), F.col("fy"), F.col("cx"), F.col("cy"), F.lit(1920.0), F.lit(1440.0), F.col("r"), F.lit(0.5))
    return rounded(p.select("p_partkey", *[x.alias(n) for x, n in zip(k, ("fx", "fy", "cx", "cy"))]), "cx", "cy")


_LM = ", ".join(f"max(x) FILTER (WHERE k = {i}) AS x{i}, max(y) FILTER (WHERE k = {i}) AS y{i}, max(z) FILTER (WHERE k = {i}) AS z{i}" for i in range(10))
_D = lambda a, b: f"sqrt(power(x{a}-x{b},2)+power(y{a}-y{b},2)+power(z{a}-z{b},2))"
_ANG = lambda a, o, b: f"degrees(acos(greatest(-1, least(1, ((x{a}-x{o})*(x{b}-x{o})+(y{a}-y{o})*(y{b}-y{o})+(z{a}-z{o})*(z{b}-z{o}))/({_D(a, o)}*{_D(b, o)})))))"
_LANDMARKS = f"""r AS (SELECT point_id // 10 AS case_no, point_id % 10 AS k, x * 1000 AS x, y * 1000 AS y, z * 1000 AS z FROM cloud), w AS (SELECT case_no, {_LM} FROM r GROUP BY 1 HAVING count(DISTINCT k) = 10)"""


def _landmarks(spark, d) -> DataFrame:
    """Ten points after each other are a case's landmarks; what is left over at the end is no case."""
    names = F.array(*[F.lit(n) for n in geometry.LANDMARKS])
    rows = cloud(spark, d).select(F.expr("point_id DIV 10").alias("case_no"), names[(F.col("point_id") % 10).cast("int")].alias("landmark"), *[(F.col(c) * 1000).alias(c) for c in "xyz"])
    return geometry.pivot_landmarks(rows, "case_no").where(" AND ".join(f"{n} IS NOT NULL" for n in geometry.LANDMARKS))


@query(f"""WITH {SQL["cloud"]}, {_LANDMARKS},
c AS (SELECT *, (x6+x7)/2 AS x10, (y6+y7)/2 AS y10, (z6+z7)/2 AS z10, (x8+x9)/2 AS ex, (y8+y9)/2 AS ey, (z8+z9)/2 AS ez FROM w)
SELECT case_no, round_even({_ANG(0, 1, 2)}, 1) AS nasofrontal_angle_deg, round_even({_ANG(4, 3, 5)}, 1) AS nasolabial_angle_deg, round_even({_D(2, 10)} / {_D(2, 1)}, 3) AS goode_ratio, round_even({_D(2, 1)}, 2) AS nose_length_mm, round_even({_D(6, 7)}, 2) AS nose_width_mm,
round_even(abs(((x2-ex)*(x9-x8)+(y2-ey)*(y9-y8)+(z2-ez)*(z9-z8)) / {_D(8, 9)}), 2) AS midline_deviation_mm FROM c""")
def angle_measures(spark, d):
    return geometry.measurements(_landmarks(spark, d), "case_no")


_CROSS = lambda a, b: [f"({a}y*{b}z-{a}z*{b}y)", f"({a}z*{b}x-{a}x*{b}z)", f"({a}x*{b}y-{a}y*{b}x)"]
_NORM = lambda v: f"sqrt({'+'.join(f'{x}*{x}' for x in v)})"


@query(f"""WITH {SQL["cloud"]}, {_LANDMARKS}, p AS (SELECT case_no, {", ".join(f"({c}3-{c}1)/{_D(3, 1)} AS v{c}, {c}2-{c}1 AS t{c}, {c}7-{c}6 AS o{c}" for c in "xyz")}, {_D(7, 6)} AS alar_width_mm FROM w),
q AS (SELECT *, tx*vx+ty*vy+tz*vz AS tip_longitudinal_mm FROM p), r2 AS (SELECT *, {", ".join(f"t{c}-tip_longitudinal_mm*v{c} AS h{c}" for c in "xyz")} FROM q),
u AS (SELECT *, {", ".join(f"h{c}/{_NORM(['hx', 'hy', 'hz'])} AS g{c}" for c in "xyz")} FROM r2), k AS (SELECT *, {", ".join(f"{x} AS l{c}" for c, x in zip("xyz", _CROSS("v", "g")))} FROM u),
f AS (SELECT *, CASE WHEN lx*ox+ly*oy+lz*oz < 0 THEN -1 ELSE 1 END / {_NORM(['lx', 'ly', 'lz'])} AS s FROM k), m AS (SELECT * REPLACE (lx*s AS lx, ly*s AS ly, lz*s AS lz) FROM f), n AS (SELECT *, {", ".join(f"{x} AS a{c}" for c, x in zip("xyz", _CROSS("l", "v")))} FROM m),
z AS (SELECT *, CASE WHEN ax*hx+ay*hy+az*hz < 0 THEN -1 ELSE 1 END AS b, {_NORM(['ax', 'ay', 'az'])} AS an, least(0.82 * tip_longitudinal_mm, tip_longitudinal_mm - 6) AS roi_end_mm FROM n)
SELECT case_no, {", ".join(f"round(v{c}, 6) AS v{c}, round(b*a{c}/an, 6) AS a{c}, round(b*l{c}, 6) AS l{c}" for c in "xyz")}, round(tip_longitudinal_mm, 6) AS tip_longitudinal_mm, round(roi_end_mm, 6) AS roi_end_mm, round(least(12, greatest(6, 0.28 * alar_width_mm)), 6) AS half_width_mm, tip_longitudinal_mm >= 15 AND alar_width_mm >= 10 AND roi_end_mm >= 12 AS usable FROM z""")
def anatomical_frame(spark, d):
    f = geometry.anatomical_frame(_landmarks(spark, d), "case_no")
    axes = [F.round(F.col(f"{n}.{c}"), 6).alias(f"{n[0]}{c}") for n in ("vertical", "anterior", "lateral") for c in "xyz"]
    return f.select("case_no", *axes, *[F.round(c, 6).alias(c) for c in ("tip_longitudinal_mm", "roi_end_mm", "half_width_mm")], "usable")


_SIDES = """e AS (SELECT mesh, v0 AS u, v1 AS v FROM faces UNION ALL SELECT mesh, v1, v2 FROM faces UNION ALL SELECT mesh, v2, v0 FROM faces),
q AS (SELECT mesh, least(u, v) AS a, greatest(u, v) AS b, count(*) AS uses, count(*) FILTER (WHERE u < v) AS along FROM e WHERE u <> v GROUP BY 1, 2, 3)"""
_EDGES = f"{SQL['faces']}, {_SIDES}"


@query(f"WITH {_EDGES} SELECT mesh, a, b, uses, along FROM q")
def unique_edges(spark, d):
    return mesh.unique_edges(faces(spark, d))


@query(f"WITH {_EDGES} SELECT mesh, count(*) AS edges, count(*) FILTER (WHERE uses = 1) AS boundary, count(*) FILTER (WHERE uses > 2) AS nonmanifold, count(*) FILTER (WHERE uses = 1 OR uses > 2) = 0 AS watertight, count(*) FILTER (WHERE along > 1 OR uses - along > 1) = 0 AS winding_consistent FROM q GROUP BY mesh")
def boundary_nonmanifold_edges(spark, d):
    return mesh.edge_summary(faces(spark, d))


def _lengths(source: str) -> str:
    return f"""WITH {SQL["cloud"]}, {SQL["vertices"]}, {_EDGES}, d AS (SELECT s.mesh, sqrt(power(m.x-n.x,2)+power(m.y-n.y,2)+power(m.z-n.z,2)) AS d FROM {source} s JOIN vertices m ON m.mesh = s.mesh AND m.vid = s.a JOIN vertices n ON n.mesh = s.mesh AND n.vid = s.b)
SELECT mesh, round(quantile_cont(d, 0.5), 6) AS edge_median, round(quantile_cont(d, 0.95), 6) AS edge_p95 FROM d GROUP BY 1"""


@query(_lengths("q"))
def edge_lengths_unique(spark, d):
    return rounded(mesh.edge_lengths(faces(spark, d), vertices(spark, d), True), "edge_median", "edge_p95")


@query(_lengths("(SELECT mesh, u AS a, v AS b FROM e)"))
def edge_lengths_directed(spark, d):
    return rounded(mesh.edge_lengths(faces(spark, d), vertices(spark, d), False), "edge_median", "edge_p95")


_TRI = f"""WITH {SQL["mesh"]}, t AS (SELECT f.*, b.x-a.x AS ux, b.y-a.y AS uy, b.z-a.z AS uz, c.x-a.x AS wx, c.y-a.y AS wy, c.z-a.z AS wz FROM faces f JOIN vertices a ON a.mesh=f.mesh AND a.vid=f.v0 JOIN vertices b ON b.mesh=f.mesh AND b.vid=f.v1 JOIN vertices c ON c.mesh=f.mesh AND c.vid=f.v2),
n AS (SELECT *, uy*wz-uz*wy AS nx, uz*wx-ux*wz AS ny, ux*wy-uy*wx AS nz FROM t)"""


@query(f"{_TRI}, x AS (SELECT mesh, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM vertices GROUP BY 1) SELECT n.mesh, count(*) AS faces, count(*) FILTER (WHERE v0 = v1 OR v1 = v2 OR v0 = v2 OR sqrt(nx*nx+ny*ny+nz*nz) <= greatest(2.220446049250313e-16 * greatest(extent * extent, 1) * 100, 1e-30)) AS degenerate FROM n JOIN x ON n.mesh = x.mesh GROUP BY 1")
def degenerate_faces(spark, d):
    return mesh.degenerate_faces(faces(spark, d), vertices(spark, d))


@query(f"""{_TRI}, s AS (SELECT mesh, vid, sum(nx) AS nx, sum(ny) AS ny, sum(nz) AS nz FROM (SELECT mesh, unnest([v0, v1, v2]) AS vid, nx, ny, nz FROM n) GROUP BY 1, 2), l AS (SELECT *, sqrt(nx*nx+ny*ny+nz*nz) AS len FROM s)
SELECT mesh, vid, round(CASE WHEN len > 1e-12 THEN nx / len END, 6) AS nx, round(CASE WHEN len > 1e-12 THEN ny / len END, 6) AS ny, round(CASE WHEN len > 1e-12 THEN nz / len END, 6) AS nz FROM l""")
def vertex_normals(spark, d):
    return rounded(mesh.vertex_normals(faces(spark, d), vertices(spark, d)), "nx", "ny", "nz")


@query(f"""WITH {SQL["mesh"]}, r AS (SELECT mesh, vid FROM vertices WHERE x > -0.1), i AS (SELECT f.* FROM faces f JOIN r a ON a.mesh=f.mesh AND a.vid=f.v0 JOIN r b ON b.mesh=f.mesh AND b.vid=f.v1 JOIN r c ON c.mesh=f.mesh AND c.vid=f.v2),
u AS (SELECT DISTINCT mesh, unnest([v0, v1, v2]) AS vid FROM i) SELECT mesh, vid, row_number() OVER (PARTITION BY mesh ORDER BY vid) - 1 AS new_vid FROM u""")
def roi_reindex(spark, d):
    return mesh.reindexed(mesh.roi_faces(faces(spark, d), vertices(spark, d).where("x > -0.1")))


def _chains(spark, d) -> DataFrame:
    """Every vector hangs on the one at half its number, but for the first seven, which hang on themselves; the first three have nothing on them."""
    return connected_components(table(spark, d, "embeddings").selectExpr("vec_id AS a", "IF(vec_id < 7, vec_id, vec_id DIV 2) AS b"))


_ROOTS = "WITH RECURSIVE w AS (SELECT vec_id AS node, vec_id AS up FROM embeddings UNION ALL SELECT node, up // 2 FROM w WHERE up >= 7), c AS (SELECT node, up AS component FROM w WHERE up BETWEEN 3 AND 6)"


@query(f"{_ROOTS} SELECT node, component FROM c")
def components(spark, d):
    return _chains(spark, d)


@query(f"{_ROOTS}, s AS (SELECT component, count(*) AS n FROM c GROUP BY 1) SELECT count(*) AS components, (SELECT component FROM s ORDER BY n DESC, component LIMIT 1) AS component, max(n) AS nodes, CAST(max(n) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS share FROM s")
def largest_component(spark, d):
    return mesh.largest_component(_chains(spark, d))


_KNN = f"{SQL['cloud']}, p AS (SELECT a.point_id, b.point_id AS neighbor_id, sqrt(power(a.x-b.x,2)+power(a.y-b.y,2)+power(a.z-b.z,2)) AS distance FROM cloud a JOIN cloud b ON a.point_id <> b.point_id), k AS (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, neighbor_id) AS rank FROM p)"


@query(f"WITH {_KNN} SELECT point_id, rank, neighbor_id, round(distance, 9) AS distance FROM k WHERE rank <= 6")
def knn(spark, d):
    return rounded(neighbors.knn(cloud(spark, d), 6, 0.1), "distance", digits=9)


@query(f"WITH {_KNN} SELECT point_id, neighbor_id, round(distance, 9) AS distance FROM k WHERE distance <= 0.04")
def radius_neighbors(spark, d):
    return rounded(neighbors.radius_pairs(cloud(spark, d), 0.04), "distance", digits=9)


@query(f"WITH {_KNN}, m AS (SELECT point_id, avg(distance) AS m FROM k WHERE rank <= 6 GROUP BY 1) SELECT point_id, round(m, 9) AS mean_distance, m > (SELECT avg(m) + 2 * stddev_samp(m) FROM m) AS outlier FROM m")
def outlier_removal(spark, d):
    return rounded(neighbors.outliers(neighbors.knn(cloud(spark, d), 6, 0.1), 2.0), "mean_distance", digits=9)


@query(f"WITH {SQL['cloud']} SELECT case_id, CAST(floor(x / 0.1) AS BIGINT) AS vx, CAST(floor(y / 0.1) AS BIGINT) AS vy, CAST(floor(z / 0.1) AS BIGINT) AS vz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS points FROM cloud GROUP BY 1, 2, 3, 4")
def voxel_downsample(spark, d):
    return rounded(neighbors.voxel_means(cloud(spark, d), ["case_id"], 0.1), "x", "y", "z", digits=9)


_PROFILE = "p AS (SELECT event_type, CAST(floor(CAST(event_id % 640 AS DOUBLE) * (64.0 / 640.0)) AS INTEGER) AS bin, value FROM events), g AS (SELECT event_type, bin, quantile_cont(value, 0.9) AS level, count(*) AS points FROM p GROUP BY 1, 2), s AS (SELECT DISTINCT event_type, unnest(range(64)) AS bin FROM events), f AS (SELECT s.event_type, s.bin, CASE WHEN points >= 25 THEN level END AS level, coalesce(points, 0) AS points FROM s LEFT JOIN g ON s.event_type = g.event_type AND s.bin = g.bin)"


def _profile(spark, d) -> DataFrame:
    return S.binned_profile(table(spark, d, "events"), ["event_type"], (F.col("event_id") % 640).cast("double"), "value", 0.0, 640.0, 64, least=25)


@query(f"WITH {_PROFILE} SELECT event_type, bin, round(level, 6) AS level, points FROM f")
def binned_p90_profile(spark, d):
    return rounded(_profile(spark, d), "level")


_GAPS = f"""{_PROFILE}, n AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS pa, last_value(level IGNORE NULLS) OVER b AS va, first_value(CASE WHEN level IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS pb, first_value(level IGNORE NULLS) OVER a AS vb FROM f
WINDOW b AS (PARTITION BY event_type ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY event_type ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT event_type, bin, coalesce(level, va + (vb - va) * CAST(bin - pa AS DOUBLE) / CAST(nullif(pb - pa, 0) AS DOUBLE), va, vb) AS filled FROM n)"""


@query(f"WITH {_GAPS} SELECT event_type, bin, round(filled, 6) AS filled FROM h")
def gap_interpolate(spark, d):
    return rounded(S.interpolate_gaps(_profile(spark, d), "event_type", "bin", "level").select("event_type", "bin", "filled"), "filled")


_WEIGHTS = [math.exp(-0.5 * (k / 1.6) ** 2) for k in range(-5, 6)]


@query(f"""WITH {_GAPS}, w(k, w) AS (VALUES {", ".join(f"({k}, {x / sum(_WEIGHTS)!r})" for k, x in zip(range(-5, 6), _WEIGHTS))})
SELECT a.event_type, a.bin, round(sum(w * b.filled), 6) AS smooth FROM h a CROSS JOIN w JOIN h b ON a.event_type = b.event_type AND b.bin = greatest(0, least(63, a.bin + k)) GROUP BY 1, 2""")
def gaussian_smooth(spark, d):
    filled = S.interpolate_gaps(_profile(spark, d), "event_type", "bin", "level")
    return rounded(S.gaussian_smooth(filled, "event_type", "bin", "filled").select("event_type", "bin", "smooth"), "smooth")


@query(f"WITH {_GAPS}, c AS (SELECT event_type, max(CASE WHEN bin = 20 THEN filled END) AS a, max(CASE WHEN bin = 21 THEN filled END) AS b FROM h GROUP BY 1) SELECT event_type, round(a + (b - a) * 0.25, 6) AS level_value FROM c")
def point_interpolation(spark, d):
    filled = S.interpolate_gaps(_profile(spark, d), "event_type", "bin", "level")
    return rounded(S.interpolate_at(filled, "event_type", "bin", "filled", 20.25), "level_value")


@query("WITH l AS (SELECT user_id, abs(value - 2 * lag(value, 1) OVER w + lag(value, 2) OVER w) AS d FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, round(max(d), 6) AS max_second_difference FROM l GROUP BY 1")
def second_difference(spark, d):
    return rounded(S.second_difference(table(spark, d, "events"), "user_id", "event_id", "value"), "max_second_difference")


@query("""WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id FROM r WHERE n <= 12 OR pos IN (SELECT CAST(round_even(i * (CAST(n - 1 AS DOUBLE) / 11), 0) AS BIGINT) FROM range(12) t(i))""")
def uniform_subsample(spark, d):
    return S.uniform_subsample(table(spark, d, "events"), "user_id", "event_id", 12).select("user_id", "event_id")


@query("WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) SELECT o_custkey, o_orderkey, o_totalprice FROM r WHERE k = 1")
def first_argmax(spark, d):
    return S.first_argmax(table(spark, d, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("""WITH h AS (SELECT o_orderstatus, o_orderkey, sha256(CAST(o_orderkey AS VARCHAR) || ',' || CAST(o_custkey AS VARCHAR) || ',' || o_orderpriority) AS h FROM orders),
s1 AS (SELECT o_orderstatus, o_orderkey // 4096 AS s, sha256(string_agg(h, ',' ORDER BY o_orderkey, h)) AS h FROM h GROUP BY 1, 2), s AS (SELECT o_orderstatus, s // 4096 AS s, sha256(string_agg(h, ',' ORDER BY s)) AS h FROM s1 GROUP BY 1, s // 4096) SELECT o_orderstatus, 'sha256:' || sha256(string_agg(h, ',' ORDER BY s)) AS identity FROM s GROUP BY 1""")
def content_identity(spark, d):
    return state.content_identity(table(spark, d, "orders"), ["o_orderstatus"], "o_orderkey", ["o_custkey", "o_orderpriority"])


@query("""WITH r AS (SELECT conv_id, role, turn, length(text) AS size, md5(text) AS signature, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC, length(text) DESC, md5(text) DESC) AS k FROM conversations)
SELECT conv_id, role, turn, size, signature, signature LIKE 'a%' AS flagged FROM r WHERE k = 1""")
def state_latest_current(spark, d):
    log = table(spark, d, "conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("size"), F.md5("text").alias("signature"))
    return state.latest_state(log, "conv_id", "role", "turn", ["size", "signature"]).withColumn("flagged", F.col("signature").startswith("a"))


@query("SELECT DISTINCT p_brand AS variant, depth FROM part, (VALUES (7), (8), (9), (10)) AS d(depth)")
def variant_depth_grid(spark, d):
    return state.variant_grid(table(spark, d, "part").selectExpr("p_brand AS variant").distinct(), [7, 8, 9, 10])


@query("SELECT p_partkey, CASE WHEN s LIKE '%.' THEN s || '0' ELSE s END AS label FROM (SELECT p_partkey, rtrim(printf('%.3f', CAST(p_size AS DOUBLE) / 8), '0') AS s FROM part)")
def reduction_labels(spark, d):
    return table(spark, d, "part").select("p_partkey", reduction_label(F.col("p_size") / 8).alias("label"))


@query("SELECT user_id, avg(CAST(json_extract_string(props, '$.k') IS NOT NULL AS INTEGER)) AS has_k FROM events GROUP BY 1")
def document_fields(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.avg(F.get_json_object("props", "$.k").isNotNull().cast("int")).alias("has_k"))


def _elements(fit: DataFrame, digits: int, *keys: str) -> DataFrame:
    """r and t as columns r1 to r9 and t1 to t3, rounded; 0.0 added, so that no zero is negative."""
    names = [F.round(F.col(c)[i], digits) + 0.0 for c, n in (("r", 9), ("t", 3)) for i in range(n)]
    return fit.select(*keys, *[v.alias(f"{c}{i + 1}") for v, (c, i) in zip(names, [("r", i) for i in range(9)] + [("t", i) for i in range(3)])])


_MOTION = ", ".join(f"CAST({v} AS DOUBLE) AS {n}" for n, v in zip([f"r{i}" for i in range(1, 10)] + ["t1", "t2", "t3"], (0, -1, 0, 1, 0, 0, 0, 0, 1, 3, -2, 7)))


@query(f"""WITH {SQL["cloud"]} SELECT case_id, count(*) AS n, CAST(2 AS DOUBLE) AS scale, {_MOTION} FROM cloud GROUP BY 1""")
def umeyama_fit(spark, d):
    """Recovers a known similarity of every case's points."""
    p = cloud(spark, d)
    pairs = p.select("case_id", *[F.col(c).alias("s" + c) for c in "xyz"], (2 * -F.col("y") + 3).alias("tx"), (2 * F.col("x") - 2).alias("ty"), (2 * F.col("z") + 7).alias("tz"))
    return _elements(rounded(solve.umeyama_fit(pairs, ["case_id"]), "scale", digits=9), 9, "case_id", "n", "scale")


@query(f"""WITH {SQL["cloud"]} SELECT case_id, count(*) FILTER (WHERE point_id % 10 <> 0) AS inliers, count(*) FILTER (WHERE point_id % 10 <> 0) AS n, count(*) FILTER (WHERE point_id % 10 <> 0) >= greatest(20, round_even(count(*) * 0.5, 0)) AS accepted, CAST(2 AS DOUBLE) AS scale, {_MOTION} FROM cloud GROUP BY 1""")
def ransac_fit(spark, d):
    """The same with every tenth target moved away: these are no inliers, and the fit is that of the others."""
    p = cloud(spark, d).withColumn("off", F.when(F.col("point_id") % 10 == 0, 0.5).otherwise(0.0))
    pairs = p.select("case_id", "point_id", *[F.col(c).alias("s" + c) for c in "xyz"], (2 * -F.col("y") + 3 + F.col("off")).alias("tx"), (2 * F.col("x") - 2).alias("ty"), (2 * F.col("z") + 7).alias("tz"))
    return _elements(rounded(solve.ransac_fit(pairs, ["case_id"], "point_id"), "scale", digits=9), 9, "case_id", "inliers", "n", "accepted", "scale")


@query()
def consensus_point(spark, d):
    return rounded(solve.consensus_point(cloud(spark, d), ["case_id"], 0.1, 0.5), "x", "y", "z", digits=9)


@query()
def triangulated_rays(spark, d):
    """Rays from each point through the origin, slightly off."""
    rays = cloud(spark, d).select("case_id", *[(F.col(c) * 5).alias("c" + c) for c in "xyz"], *[(-F.col(c) + F.col("qx") * 0.001).alias("d" + c) for c in "xyz"])
    return solve.robust_rays(rays, ["case_id"])


@query()
def local_plane(spark, d):
    p = cloud(spark, d)
    return solve.local_planes(neighbors.radius_pairs(p, 0.15, places=True))


_TURN = {"r1": "cos(0.02)", "r2": "sin(0.02)", "r3": "0", "r4": "-sin(0.02)", "r5": "cos(0.02)", "r6": "0", "r7": "0", "r8": "0", "r9": "1", "t1": "-0.01 * cos(0.02)", "t2": "0.01 * sin(0.02)", "t3": "0.005"}


@query(f"""WITH {SQL["cloud"]} SELECT count(*) AS n, true AS converged, {", ".join(f"round(CAST({v} AS DOUBLE), 6) + 0.0 AS {n}" for n, v in _TURN.items())} FROM cloud""")
def surface_registration(spark, d):
    """Takes the cloud, slightly turned and shifted, back to itself: every point to its own, by the inverse motion."""
    p, a = cloud(spark, d), 0.02
    turned = p.withColumns({"x": math.cos(a) * F.col("x") - math.sin(a) * F.col("y") + 0.01, "y": math.sin(a) * F.col("x") + math.cos(a) * F.col("y"), "z": F.col("z") - 0.005})
    return _elements(registration.closest_points(turned, p, voxel=0.0001, reach=0.1), 6, "n", "converged")


_KERNEL = """d AS (SELECT *, (bx-ax)*(x-ax)+(by_-ay)*(y-ay)+(bz-az)*(z-az) AS d1, (cx-ax)*(x-ax)+(cy-ay)*(y-ay)+(cz-az)*(z-az) AS d2, (bx-ax)*(x-bx)+(by_-ay)*(y-by_)+(bz-az)*(z-bz) AS d3, (cx-ax)*(x-bx)+(cy-ay)*(y-by_)+(cz-az)*(z-bz) AS d4,
(bx-ax)*(x-cx)+(by_-ay)*(y-cy)+(bz-az)*(z-cz) AS d5, (cx-ax)*(x-cx)+(cy-ay)*(y-cy)+(cz-az)*(z-cz) AS d6 FROM met),
e AS (SELECT *, d1*d4-d3*d2 AS vc, d5*d2-d1*d6 AS vb, d3*d6-d5*d4 AS va FROM d),
g AS (SELECT *, CASE WHEN d1 <= 0 AND d2 <= 0 THEN 0 WHEN d3 >= 0 AND d4 <= d3 THEN 1 WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN d1/(d1-d3) WHEN d6 >= 0 AND d5 <= d6 THEN 0 WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN 0 WHEN va <= 0 AND d4-d3 >= 0 AND d5-d6 >= 0 THEN 1-(d4-d3)/((d4-d3)+(d5-d6)) ELSE vb/(va+vb+vc) END AS v,
CASE WHEN d1 <= 0 AND d2 <= 0 THEN 0 WHEN d3 >= 0 AND d4 <= d3 THEN 0 WHEN vc <= 0 AND d1 >= 0 AND d3 <= 0 THEN 0 WHEN d6 >= 0 AND d5 <= d6 THEN 1 WHEN vb <= 0 AND d2 >= 0 AND d6 <= 0 THEN d2/(d2-d6) WHEN va <= 0 AND d4-d3 >= 0 AND d5-d6 >= 0 THEN (d4-d3)/((d4-d3)+(d5-d6)) ELSE vc/(va+vb+vc) END AS w FROM e),
h AS (SELECT *, sqrt(power((1-v-w)*ax+v*bx+w*cx-x,2)+power((1-v-w)*ay+v*by_+w*cy-y,2)+power((1-v-w)*az+v*bz+w*cz-z,2)) AS distance FROM g)"""
_SURFACE = f"""{SQL['sheet']}, {SQL['probes']}, {SQL['triangles']}, met AS (SELECT point_id, x, y, z, fid, ax, ay, az, bx, "by" AS by_, bz, cx, cy, cz FROM probes, triangles), {_KERNEL}"""


@query(f"WITH {_SURFACE} SELECT point_id, round(min(distance), 9) AS distance FROM h GROUP BY 1")
def closest_on_surface(spark, d):
    """The triangle isn't returned: on an edge, two are equally near."""
    got = surfaces.closest_on_surface(probes(spark, d), sheet_triangles(spark, d), 0.02)
    return rounded(got.select("point_id", "distance"), "distance", digits=9)


_OTHER = """other AS (SELECT vec_id AS vid, vec_id % 50 * CAST(0.01 AS DOUBLE) AS x, vec_id // 50 * CAST(0.01 AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) * CAST(0.05 AS DOUBLE) + CAST(0.004 AS DOUBLE) AS z FROM embeddings)"""
_OTHER_TRIANGLES = SQL["triangles"].replace("FROM sheet", "FROM other").replace("JOIN sheet", "JOIN other").replace("ids AS", "ids2 AS").replace("FROM ids ", "FROM ids2 ").replace("triangles AS", "triangles2 AS")
_BOTH = """met AS (SELECT p.vid AS point_id, 1 AS side, x, y, z, fid, ax, ay, az, bx, "by" AS by_, bz, cx, cy, cz FROM sheet p, triangles2
UNION ALL SELECT p.vid, 2, x, y, z, fid, ax, ay, az, bx, "by", bz, cx, cy, cz FROM other p, triangles)"""


@query(f"""WITH {SQL["sheet"]}, {SQL["triangles"]}, {_OTHER}, {_OTHER_TRIANGLES}, {_BOTH}, {_KERNEL},
j AS (SELECT min(distance) AS distance FROM h GROUP BY side, point_id)
SELECT count(*) AS samples, round(quantile_cont(distance, 0.5), 9) AS median, round(quantile_cont(distance, 0.95), 9) AS p95, round(quantile_cont(distance, 0.99), 9) AS p99 FROM j""")
def surface_distances(spark, d):
    """Each of two different surfaces' vertices from the other surface."""
    other = table(spark, d, "embeddings").selectExpr("vec_id AS vid", "vec_id % 50 * 0.01D AS x", "vec_id DIV 50 * 0.01D AS y", "CAST(embedding[1] AS DOUBLE) * 0.05D + 0.004D AS z")
    one, points = sheet(spark, d), lambda v: v.withColumnRenamed("vid", "point_id")
    got = surfaces.two_way_distances(points(one), sheet_triangles(spark, d), points(other), triangles_of(other), 0.02)
    return rounded(got, "median", "p95", "p99", digits=9)


@query(f"""WITH {_KNN}, n AS (SELECT k.point_id, p.case_id, greatest(-1, least(1, (p.qx*o.qx+p.qy*o.qy+p.qz*o.qz) / (sqrt(p.qx*p.qx+p.qy*p.qy+p.qz*p.qz) * sqrt(o.qx*o.qx+o.qy*o.qy+o.qz*o.qz)))) AS dot FROM k JOIN cloud p USING (point_id) JOIN cloud o ON o.point_id = k.neighbor_id WHERE rank <= 6)
SELECT case_id, count(*) AS pairs, round(avg((dot < 0)::INT), 9) AS below_0, round(avg((dot < -0.5)::INT), 9) AS below_half, round(avg((dot < -0.9)::INT), 9) AS below_most, {", ".join(f"round(quantile_cont(degrees(acos(dot)), {q}), 6) AS angle_p{round(100 * q)}, round(quantile_cont(degrees(acos(abs(dot))), {q}), 6) AS plane_p{round(100 * q)}" for q in (0.5, 0.9, 0.95, 0.99))} FROM n GROUP BY 1""")
def normal_agreement(spark, d):
    p = cloud(spark, d)
    near = neighbors.knn(p, 6, 0.1).join(p.selectExpr("point_id", "case_id", "qx AS nx", "qy AS ny", "qz AS nz"), "point_id").join(p.selectExpr("point_id AS neighbor_id", "qx AS ox", "qy AS oy", "qz AS oz"), "neighbor_id")
    got = surfaces.normal_agreement(near, ["case_id"])
    return rounded(rounded(got, "below_0", "below_half", "below_most", digits=9), *[f"{n}_p{q}" for n in ("angle", "plane") for q in (50, 90, 95, 99)])


def _top(c: reports.Check) -> float:
    return 1.25 * max(x for x in c.limits if x is not None) if any(c.limits) else 1.0


_KNOWN = [(i, c) for i, c in enumerate(reports.CHECKS) if c.kind != "gone"]
_DOCUMENTS = [(i, d) for i, (_, _, d) in enumerate(reports.SECTIONS) if d]
_FLAGS = ("fail", "warn", "tri", "always")


def _case_metrics(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Made-up values of every check, from each user's events: about a tenth is missing."""
    c = cases(spark, d)
    each = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(k.check_id).alias("check_id"), F.lit(float(_top(k))).alias("top"), F.lit(k.kind in _FLAGS).alias("flag")) for i, k in _KNOWN]))
    rows = c.withColumn("k", each).selectExpr("case_id", "k.check_id", "k.top", "k.flag", "(m * (k.i + 7) + n) % 1000 AS raw").where("raw % 10 <> 0")
    metrics = rows.selectExpr("case_id", "check_id", "CASE WHEN flag THEN CAST(raw % 2 AS DOUBLE) ELSE raw / 999D * top END AS value")
    documents = c.withColumn("k", F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(name).alias("document")) for i, name in _DOCUMENTS]))).where("(n + k.i) % 7 <> 0").selectExpr("case_id", "k.document")
    return c, metrics, documents


_NEEDS = {s: d for s, _, d in reports.SECTIONS}
_TEXT = lambda x: "NULL" if x is None else f"'{x}'"
_CATALOGUE = ", ".join(f"({i}, {_TEXT(c.section)}, {_TEXT(c.check_id)}, {_TEXT(c.kind)}, {', '.join(f'CAST({x!r} AS DOUBLE)' if x is not None else 'CAST(NULL AS DOUBLE)' for x in c.limits)}, {c.when == 'present'}, {_TEXT(c.absent)}, {_TEXT(_NEEDS[c.section])}, CAST({_top(c)!r} AS DOUBLE))" for i, c in enumerate(reports.CHECKS))
_CASE_CHECKS = f"""{SQL["cases"]}, c(position, section, check_id, kind, pl, ph, wl, wh, present, absent, document, top) AS (VALUES {_CATALOGUE}), t(i, document) AS (VALUES {", ".join(f"({i}, '{d}')" for i, d in _DOCUMENTS)}),
r AS (SELECT cases.*, c.*, (m * (position + 7) + n) % 1000 AS raw, coalesce((n + t.i) % 7 <> 0, true) AS has FROM cases CROSS JOIN c LEFT JOIN t ON t.document = c.document),
v AS (SELECT *, CASE WHEN kind = 'gone' OR raw % 10 = 0 THEN NULL WHEN kind IN ('fail', 'warn', 'tri', 'always') THEN CAST(raw % 2 AS DOUBLE) ELSE raw / CAST(999 AS DOUBLE) * top END AS value FROM r WHERE (kind = 'gone') <> has),
checks AS (SELECT *, CASE WHEN kind = 'gone' THEN absent WHEN kind = 'always' THEN 'WARN' WHEN kind = 'fail' THEN CASE WHEN coalesce(value, 0) = 1 THEN 'PASS' ELSE 'FAIL' END WHEN kind = 'warn' THEN CASE WHEN coalesce(value, 0) = 1 THEN 'PASS' ELSE 'WARN' END
WHEN value IS NULL THEN 'WARN' WHEN kind = 'tri' THEN CASE WHEN value = 1 THEN 'PASS' ELSE 'FAIL' END WHEN kind = 'min' THEN CASE WHEN value >= pl THEN 'PASS' WHEN value >= wl THEN 'WARN' ELSE 'FAIL' END WHEN kind = 'max' THEN CASE WHEN value <= ph THEN 'PASS' WHEN value <= wh THEN 'WARN' ELSE 'FAIL' END
WHEN value BETWEEN pl AND ph THEN 'PASS' WHEN value < wl OR value > wh THEN 'FAIL' ELSE 'WARN' END AS status FROM v WHERE NOT present OR value IS NOT NULL)"""


@query(f"WITH {_CASE_CHECKS} SELECT case_id, section, check_id, status, round(value, 9) AS value FROM checks")
def case_checks(spark, d):
    return rounded(reports.case_checks(*_case_metrics(spark, d)).select("case_id", "section", "check_id", "status", "value"), "value", digits=9)


_LABELS = ", ".join(f"({i}, '{s}', '{name}')" for i, (s, name, _) in enumerate(reports.SECTIONS))


@query(f"""WITH {_CASE_CHECKS}, l(place, section, label) AS (VALUES {_LABELS}), s AS (SELECT case_id, place, label, max(CASE status WHEN 'FAIL' THEN 2 WHEN 'WARN' THEN 1 ELSE 0 END) AS r, count(*) AS checks FROM checks JOIN l USING (section) GROUP BY ALL)
SELECT case_id, CASE max(r) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'WARN' ELSE 'PASS' END AS overall_status, coalesce(string_agg(label, '; ' ORDER BY place) FILTER (WHERE r = 2), '') AS failed_sections, coalesce(string_agg(label, '; ' ORDER BY place) FILTER (WHERE r = 1), '') AS warning_sections, count(*) AS sections, CAST(sum(checks) AS BIGINT) AS checks, false AS clinical_use_authorized FROM s GROUP BY 1""")
def case_report(spark, d):
    r = reports.case_report(reports.case_checks(*_case_metrics(spark, d)))
    checks = F.aggregate("sections", F.lit(0).cast("long"), lambda n, s: n + F.size(s["checks"]))
    return r.select("case_id", "overall_status", F.array_join("failed_sections", "; ").alias("failed_sections"), F.array_join("warning_sections", "; ").alias("warning_sections"), F.size("sections").cast("long").alias("sections"), checks.alias("checks"), "clinical_use_authorized")


_MEASURES = list(reports.REPEATABILITY_LIMITS)
_LIMITS = ", ".join(f"({i}, '{n}', CAST({p!r} AS DOUBLE), CAST({f!r} AS DOUBLE), '{u}')" for i, (n, (p, f, u)) in enumerate(reports.REPEATABILITY_LIMITS.items()))


@query(f"""WITH {SQL["series"]}, l(i, measurement, p, f, unit) AS (VALUES {_LIMITS}), b AS (SELECT user_id, event_type, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS m FROM series GROUP BY 1, 2), u AS (SELECT user_id FROM b GROUP BY 1 HAVING count(*) >= 2),
r AS (SELECT user_id AS subject_id, event_type AS case_id, l.*, 40 + (m % 29 + i * 3) % 29 * f / 17 AS value FROM b JOIN u USING (user_id) CROSS JOIN l),
g AS (SELECT subject_id, measurement, unit, p, f, count(*) AS cases, avg(value) AS mean, stddev_samp(value) AS sd, max(value) - min(value) AS d FROM r GROUP BY ALL), s AS (SELECT *, CASE WHEN d <= p THEN 0 WHEN d <= f THEN 1 ELSE 2 END AS r FROM g)
SELECT subject_id, measurement, cases, round_even(mean, 4) AS mean, round_even(sd, 4) AS sample_standard_deviation, round_even(abs(sd / mean) * 100, 3) AS coefficient_of_variation_percent, round_even(d, 4) AS maximum_pairwise_difference, unit, ['PASS', 'WARN', 'FAIL'][r + 1] AS status, ['PASS', 'WARN', 'FAIL'][max(r) OVER (PARTITION BY subject_id) + 1] AS overall_status FROM s""")
def repeatability_report(spark, d):
    b = series(spark, d).groupBy("user_id", "event_type").agg(F.sum(F.rint(F.col("value") * 100).cast("long")).alias("m"))
    enough = b.groupBy("user_id").count().where("count >= 2").select("user_id")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("measurement"), F.lit(f).alias("f")) for i, (n, (_, f, _)) in enumerate(reports.REPEATABILITY_LIMITS.items())]))
    rows = b.join(enough, "user_id").withColumn("l", each).selectExpr("user_id AS subject_id", "event_type AS case_id", "l.measurement", "40 + (m % 29 + l.i * 3) % 29 * l.f / 17 AS value")
    return reports.repeatability_report(rows)


@query("""WITH r AS (SELECT conv_id AS case_id, turn || '-' || role AS stage, length(text) % 3 <> 0 AS done, length(text) / CAST(8 AS DOUBLE) AS t FROM conversations), g AS (SELECT case_id, coalesce(sum(t) FILTER (WHERE done), 0) AS runtime, list_sort(list_distinct(list(stage) FILTER (WHERE NOT done))) AS names FROM r GROUP BY 1)
SELECT case_id, round_even(runtime, 3) AS runtime, coalesce(array_to_string(names, ','), '') AS incomplete, coalesce(len(names), 0) = 0 AS complete FROM g""")
def stage_runtime(spark, d):
    stages = table(spark, d, "conversations").selectExpr("conv_id AS case_id", "concat(turn, '-', role) AS stage", "CASE WHEN length(text) % 3 <> 0 THEN 'complete' ELSE 'failed' END AS status", "length(text) / 8D AS elapsed_seconds")
    return reports.stage_runtime(stages).withColumn("incomplete", F.array_join("incomplete", ","))


@query("""WITH r AS (SELECT l_suppkey AS case_id, l_orderkey || '-' || l_linenumber AS landmark, l_quantity / CAST(50 AS DOUBLE) AS ratio, CASE WHEN l_partkey % 50 <> 0 THEN l_discount END AS residual, l_tax AS snap FROM lineitem)
SELECT case_id, count(DISTINCT landmark) AS landmark_count, round_even(min(ratio), 4) AS minimum_inlier_ratio, round_even(max(coalesce(residual, 'infinity'::DOUBLE)), 3) AS maximum_median_ray_residual_mm, round_even(max(snap), 3) AS maximum_surface_snap_distance_mm, max({'a': snap, 'b': landmark}).b AS worst_surface_snap_landmark FROM r GROUP BY 1""")
def landmark_metrics(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey AS case_id", "concat(l_orderkey, '-', l_linenumber) AS landmark", "CAST(l_quantity AS DOUBLE) AS inliers", "50D AS observations", "CASE WHEN l_partkey % 50 <> 0 THEN l_discount END AS ray_residual_mm", "l_tax AS snap_mm")
    return reports.landmark_metrics(rows)


@query("WITH s AS (SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) * CAST(0.7001 AS DOUBLE) AS s FROM orders) SELECT o_orderkey, CASE WHEN s < 90 THEN printf('%.0fs', s) WHEN s < 5400 THEN printf('%.1fm', s / 60) ELSE printf('%.1fh', s / 3600) END AS label FROM s")
def duration_labels(spark, d):
    return table(spark, d, "orders").select("o_orderkey", duration_label(F.col("o_orderkey") * 0.7001).alias("label"))


@query("SELECT l_suppkey, coalesce(quantile_cont(l_discount, 0.5) FILTER (WHERE l_discount > 0.02), 0) AS median FROM lineitem GROUP BY 1")
def positive_medians(spark, d):
    return robust.positive_medians(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_discount"), 0.02)


_T = "least(1, greatest(0, l_discount * 12))"


@query(f"SELECT l_orderkey, l_linenumber, round({_T} * {_T} * {_T} * ({_T} * ({_T} * 6 - 15) + 10), 9) AS weight FROM lineitem")
def smootherstep_weights(spark, d):
    return rounded(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", V.smootherstep(F.col("l_discount") * 12).alias("weight")), "weight", digits=9)


_FRAMES = "frames AS (SELECT c_custkey AS frame_id, CAST(c_nationkey AS DOUBLE) AS x, CAST(c_acctbal AS DOUBLE) / 100 AS y, CAST(c_custkey AS DOUBLE) AS z FROM customer), index AS (SELECT o_orderkey AS image, o_custkey AS frame_id FROM orders)"


@query(f"WITH {_FRAMES}, i AS (SELECT o_orderkey AS image, o_totalprice AS x, o_totalprice / 2 AS y, o_totalprice / 4 AS z FROM orders), p AS (SELECT image, frame_id, i.x AS sx, i.y AS sy, i.z AS sz, f.x AS tx, f.y AS ty, f.z AS tz FROM i JOIN index USING (image) JOIN frames f USING (frame_id)) SELECT *, (SELECT count(*) FROM p) >= 30 AS enough FROM p")
def pose_pairs(spark, d):
    o = table(spark, d, "orders")
    frames = table(spark, d, "customer").selectExpr("c_custkey AS frame_id", "CAST(c_nationkey AS DOUBLE) AS x", "CAST(c_acctbal AS DOUBLE) / 100 AS y", "CAST(c_custkey AS DOUBLE) AS z")
    images = o.selectExpr("o_orderkey AS image", "o_totalprice AS x", "o_totalprice / 2 AS y", "o_totalprice / 4 AS z")
    return scale.pose_pairs(images, o.selectExpr("o_orderkey AS image", "o_custkey AS frame_id"), frames)


@query("""WITH g AS (SELECT c_custkey AS frame_id, px, py, 0.2 + (c_custkey * 7 + px * 3 + py * 5) % 17 / CAST(10 AS DOUBLE) AS depth, (c_custkey + px + py) % 4 AS confidence FROM customer, range(4) a(px), range(4) b(py)),
o AS (SELECT l_orderkey AS image, l_orderkey * 10 + l_linenumber AS point_id, (p_size - 3) / CAST(10 AS DOUBLE) AS z, CAST(l_quantity AS DOUBLE) - 2 AS u, l_discount * 100 AS v, CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 256 END AS mask FROM lineitem JOIN part ON l_partkey = p_partkey),
q AS (SELECT *, greatest(0, least(3, CAST(floor(u / 45 * 4) AS BIGINT))) AS px, greatest(0, least(3, CAST(floor(v / 9 * 4) AS BIGINT))) AS py FROM o WHERE z > 0 AND u >= 0 AND u < 45 AND v >= 0 AND v < 9 AND coalesce(mask, 255) >= 128)
SELECT image, point_id, round(depth / z, 9) AS ratio FROM q JOIN orders ON o_orderkey = image JOIN g ON g.frame_id = o_custkey AND g.px = q.px AND g.py = q.py WHERE confidence >= 2 AND depth BETWEEN 0.25 AND 1.5""")
def depth_ratios(spark, d):
    pixels = table(spark, d, "customer").selectExpr("c_custkey AS frame_id", "explode(sequence(0L, 15L)) AS p").selectExpr("frame_id", "p DIV 4 AS px", "p % 4 AS py").selectExpr("*", "0.2D + (frame_id * 7 + px * 3 + py * 5) % 17 / 10D AS depth", "(frame_id + px + py) % 4 AS confidence")
    seen = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).selectExpr("l_orderkey AS image", "l_orderkey * 10 + l_linenumber AS point_id", "(p_size - 3) / 10D AS z", "CAST(l_quantity AS DOUBLE) - 2 AS u", "l_discount * 100 AS v", "CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 256 END AS mask")
    index = table(spark, d, "orders").selectExpr("o_orderkey AS image", "o_custkey AS frame_id")
    return rounded(scale.depth_ratios(seen, index, pixels, 45.0, 9.0, 4, 4), "ratio", digits=9)


@query("""WITH p AS (SELECT o_custkey AS case_id, sum(CAST(round(o_totalprice * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS pose_scale FROM orders GROUP BY 1), d AS (SELECT o_custkey AS case_id, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / CAST(100 AS DOUBLE) AS depth_scale FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
b AS (SELECT case_id, pose_scale, depth_scale, abs(depth_scale - pose_scale) / pose_scale * 100 AS off FROM p LEFT JOIN d USING (case_id)) SELECT case_id, round(pose_scale, 2) AS pose_scale, round(depth_scale, 2) AS depth_scale, round_even(off, 3) AS scale_disagreement_percent, off <= 2 AS scale_verified, round(pose_scale * 1000, 2) AS scale_mm_per_unit FROM b""")
def combined_scale(spark, d):
    o, cents = table(spark, d, "orders"), lambda c: F.sum(F.rint(F.col(c) * 100).cast("long")) / 100.0
    pose = o.groupBy(F.col("o_custkey").alias("case_id")).agg(cents("o_totalprice").alias("pose_scale"))
    depth = o.join(table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("case_id")).agg(cents("l_extendedprice").alias("depth_scale"))
    return rounded(scale.combined_scale(pose, depth, "case_id"), "pose_scale", "depth_scale", "scale_mm_per_unit", digits=2)


@query("SELECT l_suppkey AS case_id, count(DISTINCT l_returnflag) = 3 AND count(DISTINCT l_partkey % 2) = 1 AS matches FROM lineitem GROUP BY 1")
def one_identity(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey AS case_id", "l_returnflag AS part", "l_partkey % 2 AS identity")
    return scale.one_identity(rows, "case_id", "part", "identity", ("A", "N", "R"))


@query(f"""{_TRI}, {_SIDES},
x AS (SELECT mesh, count(*) AS vertices, count(*) FILTER (WHERE NOT isfinite(x)) + count(*) FILTER (WHERE NOT isfinite(y)) + count(*) FILTER (WHERE NOT isfinite(z)) AS nonfinite, greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) AS extent FROM vertices GROUP BY 1),
g AS (SELECT n.mesh, count(*) AS faces, count(*) FILTER (WHERE v0 = v1 OR v1 = v2 OR v0 = v2 OR sqrt(nx*nx+ny*ny+nz*nz) <= greatest(2.220446049250313e-16 * greatest(extent * extent, 1) * 100, 1e-30)) AS degenerate FROM n JOIN x ON n.mesh = x.mesh GROUP BY 1),
s AS (SELECT mesh, count(*) FILTER (WHERE uses = 1) AS boundary, count(*) FILTER (WHERE uses > 2) AS nonmanifold, count(*) FILTER (WHERE uses = 1 OR uses > 2) = 0 AS watertight, count(*) FILTER (WHERE along > 1 OR uses - along > 1) = 0 AS winding_consistent FROM q GROUP BY 1),
l AS (SELECT q.mesh, quantile_cont(sqrt(power(m.x-o.x,2)+power(m.y-o.y,2)+power(m.z-o.z,2)) * 10, 0.5) AS edge_median, quantile_cont(sqrt(power(m.x-o.x,2)+power(m.y-o.y,2)+power(m.z-o.z,2)) * 10, 0.95) AS edge_p95 FROM q JOIN vertices m ON m.mesh = q.mesh AND m.vid = q.a JOIN vertices o ON o.mesh = q.mesh AND o.vid = q.b GROUP BY 1)
SELECT mesh, vertices, faces, nonfinite, degenerate, boundary, nonmanifold, watertight, winding_consistent, round(edge_median, 6) AS edge_median, round(edge_p95, 6) AS edge_p95 FROM x JOIN g USING (mesh) JOIN s USING (mesh) JOIN l USING (mesh)""")
def mesh_audit(spark, d):
    return rounded(mesh.mesh_audit(faces(spark, d), vertices(spark, d), 10.0), "edge_median", "edge_p95")


@query("""WITH RECURSIVE v AS (SELECT vec_id AS vid FROM embeddings WHERE embedding[1] > -0.12), e AS (SELECT vec_id AS a, vec_id + 1 AS b FROM embeddings WHERE vec_id % 50 < 49 UNION ALL SELECT vec_id, vec_id + 50 FROM embeddings), k AS (SELECT a, b FROM e WHERE a IN (SELECT vid FROM v) AND b IN (SELECT vid FROM v)),
u AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k), s AS (SELECT min(least(a, b)) AS vid FROM k), r AS (SELECT vid FROM s UNION SELECT u.b FROM r JOIN u ON u.a = r.vid) SELECT vid FROM r""")
def seeded_component(spark, d):
    """The part of the sheet that holds the first vertex on an edge of the region."""
    e = table(spark, d, "embeddings")
    edges = e.where("vec_id % 50 < 49").selectExpr("vec_id AS a", "vec_id + 1 AS b").unionByName(e.selectExpr("vec_id AS a", "vec_id + 50 AS b"))
    inside = e.where("embedding[0] > -0.12").selectExpr("vec_id AS vid")
    first = edges.join(inside.withColumnRenamed("vid", "a"), "a", "left_semi").join(inside.withColumnRenamed("vid", "b"), "b", "left_semi").agg(F.min(F.least("a", "b"))).first()[0]
    return mesh.seeded_component(edges, inside, first)


@query("""WITH c AS (SELECT l_returnflag AS mesh, l_orderkey AS fid, l_quantity / CAST(64 AS DOUBLE) AS u, l_linenumber / CAST(8 AS DOUBLE) AS v FROM lineitem), p AS (SELECT r AS row, k AS "column", (r * 31 + k * 17) % 256 AS gray FROM range(64) a(r), range(32) b(k)),
f AS (SELECT mesh, fid, avg(u) AS u, avg(v) AS v FROM c GROUP BY 1, 2), q AS (SELECT mesh, greatest(0, least(63, CAST(round_even((1 - v) * 63, 0) AS BIGINT))) AS row, greatest(0, least(31, CAST(round_even(u * 31, 0) AS BIGINT))) AS "column" FROM f)
SELECT mesh, count(*) AS faces, round_even(avg((gray <= 5)::INT) * 100, 4) AS dark_percent, round_even(avg((gray >= 250)::INT) * 100, 4) AS bright_percent, quantile_cont(CAST(gray AS DOUBLE), 0.5) AS median FROM q JOIN p USING (row, "column") GROUP BY 1""")
def sampled_texture(spark, d):
    corners = table(spark, d, "lineitem").selectExpr("l_returnflag AS mesh", "l_orderkey AS fid", "l_quantity / 64D AS u", "l_linenumber / 8D AS v")
    pixels = spark.range(64 * 32).selectExpr("id DIV 32 AS row", "id % 32 AS column", "(id DIV 32 * 31 + id % 32 * 17) % 256 AS gray")
    return mesh.sampled_texture(corners, pixels, 32, 64)


@query("""WITH r AS (SELECT l_suppkey AS k, CAST(l_quantity AS DOUBLE) AS x, l_discount * 100 AS y FROM lineitem), s AS (SELECT k, count(*) AS n, sum(x) AS a1, sum(x*x) AS a2, sum(x*x*x) AS a3, sum(x*x*x*x) AS a4, sum(y) AS b0, sum(x*y) AS b1, sum(x*x*y) AS b2 FROM r GROUP BY 1 HAVING count(DISTINCT x) >= 3),
t AS (SELECT *, a4*(a2*n-a1*a1) - a3*(a3*n-a1*a2) + a2*(a3*a1-a2*a2) AS det FROM s) SELECT k, n, round((b2*(a2*n-a1*a1) - a3*(b1*n-a1*b0) + a2*(b1*a1-a2*b0)) / det, 6) AS a, round((a4*(b1*n-a1*b0) - b2*(a3*n-a1*a2) + a2*(a3*b0-b1*a2)) / det, 5) AS b, round((a4*(a2*b0-b1*a1) - a3*(a3*b0-b1*a2) + b2*(a3*a1-a2*a2)) / det, 4) AS c FROM t
UNION ALL SELECT k, count(*), NULL, NULL, NULL FROM r GROUP BY 1 HAVING count(DISTINCT x) < 3""")
def quadratic_fit(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_suppkey AS k", "CAST(l_quantity AS DOUBLE) AS x", "l_discount * 100 AS y")
    return rounded(rounded(rounded(robust.quadratic_fit(rows, ["k"], "x", "y"), "a"), "b", digits=5), "c", digits=4)


@query("SELECT l_suppkey, coalesce(quantile_cont(CAST(l_quantity AS DOUBLE), 0.5) FILTER (WHERE l_discount >= 0.08), 0) AS across_median, coalesce(quantile_cont(l_tax, 0.5) FILTER (WHERE l_discount >= 0.08), 0) AS height_median FROM lineitem GROUP BY 1")
def sidewall_position(spark, d):
    return robust.sidewall_position(table(spark, d, "lineitem"), ["l_suppkey"], F.col("l_discount") >= 0.08, "l_quantity", "l_tax")


_RIDGE = "ridge AS (SELECT event_type AS case_id, (event_id % 640) / CAST(20 AS DOUBLE) AS lon, CAST(user_id % 7 AS DOUBLE) - 3 AS lat, CAST(value AS DOUBLE) AS height FROM events), frames AS (SELECT DISTINCT event_type AS case_id, 24 + CAST(length(event_type) AS DOUBLE) / 2 AS roi_end FROM events)"


def _ridge(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "events")
    points = e.selectExpr("event_type AS case_id", "(event_id % 640) / 20D AS longitudinal", "CAST(user_id % 7 AS DOUBLE) - 3 AS lateral", "CAST(value AS DOUBLE) AS anterior")
    return points, e.select("event_type").distinct().selectExpr("event_type AS case_id", "24 + length(event_type) / 2D AS roi_end_mm", "6D AS half_width_mm")


def _smoothed(bins: int, least: int, sigma: float, binned: str) -> str:
    radius = max(2, math.ceil(3 * sigma))
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return f"""g AS (SELECT case_id, bin, quantile_cont(height, 0.9) AS level FROM ({binned}) GROUP BY 1, 2 HAVING count(*) >= {least}), s AS (SELECT DISTINCT case_id, unnest(range({bins})) AS bin FROM ({binned})), f AS (SELECT s.case_id, s.bin, level FROM s LEFT JOIN g USING (case_id, bin)),
n AS (SELECT *, last_value(CASE WHEN level IS NOT NULL THEN bin END IGNORE NULLS) OVER b AS pa, last_value(level IGNORE NULLS) OVER b AS va, first_value(CASE WHEN level IS NOT NULL THEN bin END IGNORE NULLS) OVER a AS pb, first_value(level IGNORE NULLS) OVER a AS vb FROM f
WINDOW b AS (PARTITION BY case_id ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY case_id ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
h AS (SELECT case_id, bin, coalesce(level, va + (vb - va) * CAST(bin - pa AS DOUBLE) / CAST(nullif(pb - pa, 0) AS DOUBLE), va, vb) AS filled FROM n), w(k, w) AS (VALUES {", ".join(f"({k}, CAST({x / sum(raw)!r} AS DOUBLE))" for k, x in zip(range(-radius, radius + 1), raw))}),
smooth AS (SELECT a.case_id, a.bin, sum(w * b.filled) AS level FROM h a CROSS JOIN w JOIN h b ON a.case_id = b.case_id AND b.bin = greatest(0, least({bins - 1}, a.bin + k)) GROUP BY 1, 2), known AS (SELECT case_id, count(*) AS n FROM g GROUP BY 1)"""


@query(f"""WITH {_RIDGE}, {_smoothed(64, 2, 1.6, "SELECT case_id, CAST(floor(lon / (roi_end / 64)) AS INTEGER) AS bin, height FROM ridge JOIN frames USING (case_id) WHERE abs(lat) <= least(2.5, 6 * 0.35) AND lon / (roi_end / 64) < 64")},
r AS (SELECT case_id, bin, (bin + 0.5) * roi_end / 64 AS center, level, coalesce(n, 0) >= 21 AS covered FROM smooth JOIN frames USING (case_id) LEFT JOIN known USING (case_id)),
l AS (SELECT case_id, quantile_cont(center, 0.5) FILTER (WHERE bin BETWEEN 1 AND 4) AS ac, quantile_cont(level, 0.5) FILTER (WHERE bin BETWEEN 1 AND 4) AS al, quantile_cont(center, 0.5) FILTER (WHERE bin BETWEEN 60 AND 63) AS bc, quantile_cont(level, 0.5) FILTER (WHERE bin BETWEEN 60 AND 63) AS bl FROM r GROUP BY 1)
SELECT case_id, bin, round(center, 6) AS center, round(level, 6) AS profile, round(al + (bl - al) / (bc - ac) * (center - ac), 6) AS target, covered FROM r JOIN l USING (case_id)""")
def ridge_profile(spark, d):
    return rounded(profiles.ridge_profile(*_ridge(spark, d), "case_id"), "center", "profile", "target")


@query(f"""WITH {_RIDGE}, {_smoothed(49, 1, 1.0, "SELECT case_id, CAST(floor((lat + 6) / (CAST(12 AS DOUBLE) / 49)) AS INTEGER) AS bin, height FROM ridge WHERE abs(lon - 12) <= 2")}
SELECT case_id, bin, round((bin + 0.5) * 2 / 49 * 6 - 6, 6) AS center, round(level, 6) AS height, coalesce(n, 0) >= 9 AS covered FROM smooth LEFT JOIN known USING (case_id)""")
def cross_section(spark, d):
    points, frames = _ridge(spark, d)
    levels = frames.selectExpr("case_id", "12D AS level_mm", "2D AS window_mm", "half_width_mm")
    return rounded(profiles.cross_section(points, levels, "case_id"), "center", "height")


_SECTIONS = f"""{_RIDGE.replace("SELECT event_type AS case_id, (event_id", "SELECT event_type AS case_id, event_id AS vid, (event_id", 1)}, l(level, level_mm, window_mm) AS (VALUES ('low', CAST(6 AS DOUBLE), CAST(2 AS DOUBLE)), ('high', CAST(17 AS DOUBLE), CAST(1 AS DOUBLE))),
p AS (SELECT case_id, vid, 'source' AS surface, lon, lat, height FROM ridge UNION ALL SELECT case_id, vid, 'target', lon, lat * CAST(0.9 AS DOUBLE), height - 1 FROM ridge UNION ALL SELECT case_id, vid, 'simulated', lon, lat * CAST(0.95 AS DOUBLE), height * CAST(0.99 AS DOUBLE) FROM ridge),
q AS (SELECT case_id || ':' || level || ':' || surface AS case_id, vid, lon, lat, height, level_mm, window_mm FROM p JOIN l ON abs(lon - level_mm) <= window_mm)"""


@query(f"""WITH {_SECTIONS}, {_smoothed(49, 1, 1.0, "SELECT case_id, CAST(floor((lat + 6) / (CAST(12 AS DOUBLE) / 49)) AS INTEGER) AS bin, height FROM q")},
c AS (SELECT case_id, bin, (bin + 0.5) * 2 / 49 * 6 - 6 AS center, level AS height FROM smooth),
e AS (SELECT case_id, max(height) FILTER (WHERE bin = 24) AS central_height, max(height) FILTER (WHERE abs(center) > 1 AND abs(center) <= 4) AS shoulder, max(height) AS top FROM c GROUP BY 1),
v AS (SELECT c.case_id, max(center) FILTER (WHERE height >= top - 1.5) - min(center) FILTER (WHERE height >= top - 1.5) AS envelope_width FROM c JOIN e USING (case_id) GROUP BY 1),
t AS (SELECT case_id, level, quantile_cont(height, 0.98) AS top FROM ridge JOIN l ON abs(lon - level_mm) <= window_mm GROUP BY 1, 2),
fo AS (SELECT r.case_id, l.level, vid, lat AS before, height >= top - 1.5 AS bridge, CASE WHEN height >= top - 5 AND abs(lat) BETWEEN 1.6 AND 4.6 THEN CASE WHEN lat < 0 THEN 'left' ELSE 'right' END END AS side FROM ridge r JOIN l ON abs(lon - level_mm) <= window_mm JOIN t ON t.case_id = r.case_id AND t.level = l.level),
m AS (SELECT fo.case_id || ':' || level || ':' || surface AS case_id, lat, height, bridge, side, CASE WHEN before < 0 THEN lat - before ELSE before - lat END AS inwards FROM fo JOIN p ON fo.case_id = p.case_id AND fo.vid = p.vid),
s2 AS (SELECT case_id, count(*) FILTER (WHERE bridge) AS n, max(lat) FILTER (WHERE bridge) - min(lat) FILTER (WHERE bridge) AS width, {", ".join(f"count(*) FILTER (WHERE side = '{n}') AS {n}_vertices, coalesce(quantile_cont(lat, 0.5) FILTER (WHERE side = '{n}'), 0) AS {n}_lateral, coalesce(quantile_cont(height, 0.5) FILTER (WHERE side = '{n}'), 0) AS {n}_anterior, coalesce(quantile_cont(inwards, 0.5) FILTER (WHERE side = '{n}' AND inwards > 1e-6), 0) AS {n}_medial" for n in ("left", "right"))} FROM m GROUP BY 1)
SELECT split_part(e.case_id, ':', 1) AS case_id, split_part(e.case_id, ':', 2) AS level, split_part(e.case_id, ':', 3) AS surface, round(CASE WHEN s2.n >= 2 THEN width ELSE envelope_width END, 6) AS width, round(envelope_width, 6) AS envelope_width, round(central_height, 6) AS central_height, round(central_height - shoulder, 6) AS prominence,
coalesce(known.n, 0) >= 9 AS covered, left_vertices, right_vertices, {", ".join(f"round({n}_{c}, 6) AS {n}_{c}" for n in ("left", "right") for c in ("lateral", "anterior", "medial"))} FROM e JOIN v USING (case_id) LEFT JOIN known USING (case_id) LEFT JOIN s2 USING (case_id)""")
def section_report(spark, d):
    """Two levels and three surfaces of every case: as they are, narrowed and lowered by 1 mm, and something between."""
    e = table(spark, d, "events").selectExpr("event_type AS case_id", "event_id AS vid", "(event_id % 640) / 20D AS longitudinal", "CAST(user_id % 7 AS DOUBLE) - 3 AS lateral", "CAST(value AS DOUBLE) AS anterior")
    surfaces_of = F.explode(F.expr("array(struct('source' AS surface, 1D AS a, 1D AS b, 0D AS c), struct('target' AS surface, 0.9D AS a, 1D AS b, 1D AS c), struct('simulated' AS surface, 0.95D AS a, 0.99D AS b, 0D AS c))"))
    points = e.withColumn("s", surfaces_of).selectExpr("case_id", "vid", "s.surface", "longitudinal", "lateral * s.a AS lateral", "anterior * s.b - s.c AS anterior")
    levels = F.explode(F.expr("array(struct('low' AS level, 6D AS level_mm, 2D AS window_mm), struct('high' AS level, 17D AS level_mm, 1D AS window_mm))"))
    at = e.select("case_id").distinct().withColumn("l", levels).selectExpr("case_id", "l.*", "6D AS half_width_mm", "1D AS core_mm", "4D AS bridge_mm")
    got = sections.section_report(points, at).drop("ridge_lateral", "curvature", "dent")
    return rounded(got, "width", "envelope_width", "central_height", "prominence", *[f"{n}_{c}" for n in ("left", "right") for c in ("lateral", "anterior", "medial")])


@query("""WITH p AS (SELECT user_id AS case_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position, value / CAST(100 AS DOUBLE) AS v FROM events), q AS (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM p),
r AS (SELECT case_id, position, CAST(position AS DOUBLE) / n AS t, v AS source, CAST(case_id % 3 AS DOUBLE) AS applied, CAST(case_id % 3 AS DOUBLE) * 4 * position / n * (1 - CAST(position AS DOUBLE) / n) AS requested FROM q), s AS (SELECT *, source - requested * (CAST(0.7 AS DOUBLE) + case_id % 5 / CAST(10 AS DOUBLE)) AS final, source - requested AS target FROM r),
b AS (SELECT *, abs(requested - 2 * lag(requested, 1) OVER w + lag(requested, 2) OVER w) AS bend, source - final AS done, abs(final - target) AS off, requested >= greatest(0.05, 0.05 * applied) AS active FROM s WINDOW w AS (PARTITION BY case_id ORDER BY position)),
g AS (SELECT case_id, max(applied) AS applied, count(*) FILTER (WHERE active) AS active, max({'r': requested, 'f': -position, 'd': done}) AS apex, quantile_cont(done / greatest(requested, 1e-9), 0.1) FILTER (WHERE active) AS p10, max(off) FILTER (WHERE active) AS off, max(bend) AS bend, coalesce(max(abs(done)) FILTER (WHERE t <= 0.03), 0) AS s, coalesce(max(abs(done)) FILTER (WHERE t >= 0.88), 0) AS e FROM b GROUP BY 1),
k AS (SELECT *, apex.d / greatest(apex.r, 1e-9) AS ratio FROM g)
SELECT case_id, active, round(ratio, 6) AS apex_achievement, round(p10, 6) AS p10_achievement, round(off, 6) AS maximum_target_error, round(bend, 6) AS maximum_second_difference, round(s, 6) AS maximum_at_start, round(e, 6) AS maximum_at_end,
applied <= 0 OR coalesce(active > 0 AND ratio BETWEEN 0.85 AND 1.15 AND p10 >= 0.8 AND off <= greatest(0.3, 0.15 * applied) AND bend <= greatest(0.1, 0.08 * applied) AND s <= greatest(0.25, 0.1 * applied) AND e <= greatest(0.25, 0.1 * applied), false) AS passed FROM k""")
def profile_acceptance(spark, d):
    p = table(spark, d, "events").selectExpr("user_id AS case_id", "row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position", "count(*) OVER (PARTITION BY user_id) AS n", "value / 100D AS source")
    p = p.selectExpr("*", "CAST(case_id % 3 AS DOUBLE) AS applied", "CAST(position AS DOUBLE) / n AS normalized", "CAST(case_id % 3 AS DOUBLE) * 4 * position / n * (1 - CAST(position AS DOUBLE) / n) AS requested")
    p = p.selectExpr("*", "source - requested * (0.7D + case_id % 5 / 10D) AS final", "source - requested AS target")
    got = profiles.profile_acceptance(p, "case_id")
    return rounded(got, *[c for c in got.columns if c not in ("case_id", "active", "passed")])


_MID = lambda a, b: {c: f"({c}{a}+{c}{b})/2" for c in "xyz"}
_CHEEK = lambda e, l: f"""sqrt({"+".join(f"power({c}-({_MID(e, l)[c]}+12*({_MID(e, l)[c]}-{_MID(8, 9)[c]})/sqrt({'+'.join(f'power({_MID(e, l)[k]}-{_MID(8, 9)[k]},2)' for k in 'xyz')})),2)" for c in "xyz")}) <= 10"""  # noqa: E731, E741


@query(f"""WITH {SQL["cloud"]}, {_LANDMARKS}, p AS (SELECT w.*, 0 AS point_id, x2 + 1 AS x, y2 + 2 AS y, z2 + 3 AS z FROM w UNION ALL SELECT w.*, 1, (x1 + x2) / 2 + 1, (y1 + y2) / 2 + 1, (z1 + z2) / 2 + 1 FROM w UNION ALL SELECT w.*, 2, {", ".join(f"{c}0+10*({c}0-{c}3)/{_D(0, 3)}" for c in "xyz")} FROM w UNION ALL SELECT w.*, 3, {", ".join(f"{_MID(8, 6)[c]}+9*({_MID(8, 6)[c]}-{_MID(8, 9)[c]})/sqrt({'+'.join(f'power({_MID(8, 6)[k]}-{_MID(8, 9)[k]},2)' for k in 'xyz')})" for c in "xyz")} FROM w),
t AS (SELECT *, ((x-x1)*(x2-x1)+(y-y1)*(y2-y1)+(z-z1)*(z2-z1)) / {_D(2, 1)} / {_D(2, 1)} AS t FROM p),
near AS (SELECT case_no, point_id, unnest([CASE WHEN sqrt({"+".join(f"power({c}-({c}0+14*({c}0-{c}3)/{_D(0, 3)}),2)" for c in "xyz")}) <= 10 THEN 'central_forehead' END, CASE WHEN {_CHEEK(8, 6)} THEN 'left_cheek' END, CASE WHEN {_CHEEK(9, 7)} THEN 'right_cheek' END, CASE WHEN sqrt({"+".join(f"power({c}-{c}2,2)" for c in "xyz")}) <= 6 THEN 'nasal_tip' END,
CASE WHEN t BETWEEN 0.15 AND 0.75 AND sqrt({"+".join(f"power({c}-({c}1+t*({c}2-{c}1)),2)" for c in "xyz")}) <= 4 THEN 'nasal_dorsum' END]) AS region FROM t) SELECT case_no, point_id, region FROM near WHERE region IS NOT NULL""")
def diagnostic_regions(spark, d):
    """Four points of each case: near the tip, the middle of the dorsum, above the glabella and beside the left cheek's anchor."""
    wide = _landmarks(spark, d)
    at = lambda n: tuple(F.col(f"{n}.{c}") for c in "xyz")
    middle = lambda a, b: tuple((x + y) / 2 for x, y in zip(at(a), at(b)))
    anchor, eyes = middle("left_endocanthion", "left_alare"), middle("left_endocanthion", "right_endocanthion")
    near = [
        tuple(x + k for x, k in zip(at("pronasale"), (1, 2, 3))), tuple(x + 1 for x in middle("nasion", "pronasale")),
        tuple(x + 10 * u for x, u in zip(at("glabella"), V.unit(V.minus(at("glabella"), at("subnasale"))))), tuple(x + 9 * u for x, u in zip(anchor, V.unit(V.minus(anchor, eyes)))),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("point_id"), *[x.alias(c) for x, c in zip(p, "xyz")]) for i, p in enumerate(near)])).alias("p")
    return profiles.diagnostic_regions(wide.select("case_no", each).select("case_no", "p.*"), wide, "case_no")


@query()
def plane_residuals(spark, d):
    return profiles.plane_residuals_within(cloud(spark, d), 0.15, ["case_id"], 4)
