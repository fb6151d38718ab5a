"""Views of the given tables in the parts of capture data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


SPREAD_BYTES = 4 << 20  # of a given table for each partition of a shuffle


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    _spread(spark, path)
    return spark.read.parquet(path)


def _spread(spark: SparkSession, path: str) -> None:
    """Shuffles start with as many partitions as the largest table needs, so what one task has to hold doesn't grow with the input; adaptive execution joins them again where they are small."""
    name = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    wanted = files.getContentSummary(hadoop).getLength() // SPREAD_BYTES if files.exists(hadoop) else 0
    if wanted > int(spark.conf.get(name, None) or spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set(name, str(wanted))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16m")


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a scored series (event_id, us: microseconds, value, user_id, event_type)."""
    return table(spark, sf_dir, "events").selectExpr("event_id", "unix_micros(to_timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'))) AS us", "value", "user_id", "event_type")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: points (point_id, x, y, z), directions (dx, dy, dz) and a case."""
    e = [f"CAST(embedding[{i}] AS DOUBLE)" for i in range(7)]
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS point_id", "label AS case_id", *[f"{x} AS {n}" for x, n in zip(e, ("x", "y", "z", "qx", "qy", "qz", "qw"))], "vec_id * 0.025D AS ts")


def faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem: triangles over all vertices, each key modulo the number of embeddings; a mesh a return flag. A face's id is its corners, as a number would overflow."""
    size = table(spark, sf_dir, "embeddings").agg(F.count(F.lit(1)).alias("size")).where("size > 0")
    keys = table(spark, sf_dir, "lineitem").crossJoin(F.broadcast(size))  # one row
    corners = keys.selectExpr("l_returnflag AS mesh", "l_orderkey % size AS v0", "l_partkey % size AS v1", "l_suppkey % size AS v2").distinct()
    return corners.selectExpr("mesh", "struct(v0, v1, v2) AS fid", "v0", "v1", "v2")


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, once for each mesh."""
    v = cloud(spark, sf_dir).selectExpr("point_id AS vid", "x", "y", "z")
    return v.withColumn("mesh", F.explode(F.array(*[F.lit(m) for m in "ANR"])))


def sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: a wavy surface (vid, x, y, z) over a grid 50 points wide, one point a vector."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS vid", "vec_id % 50 * 0.01D AS x", "vec_id DIV 50 * 0.01D AS y", "CAST(embedding[0] AS DOUBLE) * 0.05D AS z")


def sheet_triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two triangles in each cell of the sheet's grid: fid, a*, b*, c*."""
    return triangles_of(sheet(spark, sf_dir))


def triangles_of(v: DataFrame) -> DataFrame:
    """The same over any points (vid, x, y, z) of that grid."""
    corner = lambda n: v.select(F.col("vid").alias(f"{n}vid"), *[F.col(c).alias(f"{n}{c}") for c in "xyz"])
    ids = v.where("vid % 50 < 49").selectExpr("vid * 2 AS fid", "vid AS i", "vid + 1 AS j", "vid + 50 AS k").unionByName(v.where("vid % 50 < 49").selectExpr("vid * 2 + 1 AS fid", "vid + 1 AS i", "vid + 51 AS j", "vid + 50 AS k"))
    for at, n in zip("ijk", "abc"):
        ids = ids.join(corner(n), F.col(at) == F.col(f"{n}vid"))
    return ids.select("fid", *[f"{n}{c}" for n in "abc" for c in "xyz"])


def probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings: a point (point_id, x, y, z) near each vertex of the sheet."""
    return table(spark, sf_dir, "embeddings").selectExpr("vec_id AS point_id", "vec_id % 50 * 0.01D + 0.003D AS x", "vec_id DIV 50 * 0.01D + 0.004D AS y", "CAST(embedding[1] AS DOUBLE) * 0.05D AS z")


def ridged_case(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """embeddings: a surface with a ridge, 50 points long and as wide as there are vectors (case_id, vid, x, y, z in metres), its triangles, and landmarks around it in millimetres."""
    points = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS vid", "vec_id % 50 AS i", "vec_id DIV 50 AS j", "CAST(embedding[0] AS DOUBLE) AS e")
    points = points.join(points.agg(F.max("j").alias("last")), F.lit(True)).selectExpr("*", "i * 1.1D - 3 AS s", "(j / last - 0.5D) * 34 AS w")
    vertices = points.selectExpr("'one' AS case_id", "vid", "w / 1000 AS x", "s / 1000 AS y", "(0.32D * s + 2.5D * exp(-0.5D * pow((s - 20) / 6, 2)) - 0.018D * w * w + 0.1D * e) / 1000 AS z")
    corners = F.explode(F.expr("array(struct(vid * 2 AS fid, vid AS v0, vid + 1 AS v1, vid + 50 AS v2), struct(vid * 2 + 1 AS fid, vid + 1 AS v0, vid + 51 AS v1, vid + 50 AS v2))")).alias("f")
    faces = points.where("i < 49 AND j < last").select(F.lit("one").alias("case_id"), corners).select("case_id", "f.*")
    at = {"glabella": (0, -10, 1), "nasion": (0, 0, 0), "pronasale": (0, 50, 19), "subnasale": (0, 56, 0), "columella": (0, 54, 8), "labiale_superius": (0, 66, 3), "left_alare": (-17, 49, 3), "right_alare": (17, 49, 3), "left_endocanthion": (-16, 2, -6), "right_endocanthion": (16, 2, -6)}
    landmarks = spark.createDataFrame([("one", n, *map(float, p)) for n, p in at.items()], "case_id string, landmark string, x double, y double, z double")
    return vertices, faces, landmarks


def repeated_cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """embeddings: three captures of one surface in metres, each moved and with noise of its own (case_id, vid, x, y, z), their triangles and landmarks, and all pairs of them."""
    vertices, faces, landmarks = ridged_case(spark, sf_dir)
    noise = table(spark, sf_dir, "embeddings").selectExpr("vec_id AS vid", "CAST(embedding[1] AS DOUBLE) AS e1", "CAST(embedding[2] AS DOUBLE) AS e2")
    moves = F.explode(F.expr("array(struct('a' AS name, 0D AS turn, 0D AS step, 0D AS k1, 0D AS k2), struct('b' AS name, 0.1D AS turn, 0.02D AS step, 1D AS k1, 0D AS k2), struct('c' AS name, -0.2D AS turn, -0.05D AS step, 0D AS k1, 4D AS k2))")).alias("m")
    turned = {"x": "cos(m.turn) * x - sin(m.turn) * y + m.step", "y": "sin(m.turn) * x + cos(m.turn) * y - m.step / 2", "z": "z + m.step"}
    xyz = [f"{e} AS {c}" for c, e in turned.items()]
    rough = vertices.join(noise, "vid").withColumn("m", moves).withColumn("z", F.expr("z + (m.k1 * e1 + m.k2 * e2) / 1000"))
    marks = landmarks.selectExpr("landmark", "x / 1000 AS x", "y / 1000 AS y", "z / 1000 AS z").withColumn("m", moves)
    names = F.explode(F.expr("array('a', 'b', 'c')")).alias("case_id")
    pairs = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c")], "first string, second string")
    return rough.selectExpr("m.name AS case_id", "vid", *xyz), faces.drop("case_id").select(names, "*"), marks.selectExpr("m.name AS case_id", "landmark", *xyz), pairs


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events: a case a user, with a sum ``m`` of cents and a count ``n`` that stand for what a case was measured to be."""
    return series(spark, sf_dir).groupBy("user_id").agg(F.sum(F.rint(F.col("value") * 100).cast("long")).alias("m"), F.count(F.lit(1)).alias("n")).selectExpr("user_id AS case_id", "m", "n")


#: The same views for DuckDB.
SQL = {
    "series": "series AS (SELECT event_id, epoch_us(ts) AS us, value, user_id, event_type FROM events)",
    "cloud": "cloud AS (SELECT vec_id AS point_id, label AS case_id, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS {n}" for i, n in enumerate(("x", "y", "z", "qx", "qy", "qz", "qw"))) + ", vec_id * CAST(0.025 AS DOUBLE) AS ts FROM embeddings)",
    "faces": "faces AS (SELECT DISTINCT l_returnflag AS mesh, l_orderkey % size AS v0, l_partkey % size AS v1, l_suppkey % size AS v2 FROM lineitem, (SELECT count(*) AS size FROM embeddings))",
    "vertices": "vertices AS (SELECT mesh, point_id AS vid, x, y, z FROM cloud, (VALUES ('A'), ('N'), ('R')) AS m(mesh))",
    "sheet": "sheet AS (SELECT vec_id AS vid, vec_id % 50 * CAST(0.01 AS DOUBLE) AS x, vec_id // 50 * CAST(0.01 AS DOUBLE) AS y, CAST(embedding[1] AS DOUBLE) * CAST(0.05 AS DOUBLE) AS z FROM embeddings)",
    "probes": "probes AS (SELECT vec_id AS point_id, vec_id % 50 * CAST(0.01 AS DOUBLE) + CAST(0.003 AS DOUBLE) AS x, vec_id // 50 * CAST(0.01 AS DOUBLE) + CAST(0.004 AS DOUBLE) AS y, CAST(embedding[2] AS DOUBLE) * CAST(0.05 AS DOUBLE) AS z FROM embeddings)",
    "cases": "cases AS (SELECT user_id AS case_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS m, count(*) AS n FROM events GROUP BY 1)",
}
SQL["mesh"] = ", ".join(SQL[k] for k in ("cloud", "faces", "vertices"))
_CORNERS = ", ".join(f'{n}.{c} AS "{n}{c}"' for n in "abc" for c in "xyz")
SQL["triangles"] = f"""ids AS (SELECT vid * 2 AS fid, vid AS i, vid + 1 AS j, vid + 50 AS k FROM sheet WHERE vid % 50 < 49 UNION ALL SELECT vid * 2 + 1, vid + 1, vid + 51, vid + 50 FROM sheet WHERE vid % 50 < 49),
triangles AS (SELECT fid, {_CORNERS} FROM ids JOIN sheet a ON a.vid = i JOIN sheet b ON b.vid = j JOIN sheet c ON c.vid = k)"""
