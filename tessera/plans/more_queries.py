"""Queries of readers' keys, sizes, camera changes, supervision and rigid transforms, each with its SQL.

They add to those of ``driver_queries``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import transforms as tr
from ..operators import assign, keypoints, metrics, robust
from ..operators import supervision as sup
from ..shared import stored
from ..sources import corpus
from ..streaming import frames
from .driver_queries import GEO, POINTS, QUERIES, SQL, K, big, geo_points, points, pq, query, r6, table

__all__ = ["QUERIES", "SQL"]


def cells(m: Column, names: dict[str, int]) -> list[Column]:
    """Rounded cells of an array; a negative zero counts as zero."""
    return [(F.round(m[k], 6) + 0.0).alias(n) for n, k in names.items()]


# sources


@query("""WITH f AS (SELECT n_nationkey AS n, ['face', 'iris', 'hand', 'fingervein', 'voice'][n_nationkey % 5 + 1] AS modality, ['same', 'different', 'other'][n_nationkey % 3 + 1] AS kind, unnest(range(1 + n_nationkey % 4)) AS k FROM nation),
p AS (SELECT modality, kind, 'f' || n AS folder, '/data/' || modality || '/' || kind || '/f' || n || '/' || k || CASE WHEN k = 2 THEN '.txt' ELSE '.PNG' END AS path FROM f)
SELECT modality, kind = 'same' AS gt, modality || '/' || kind || '/' || folder AS pair_id, min(path) AS file1, max(path) AS file2 FROM p WHERE path NOT LIKE '%.txt' AND modality <> 'voice' AND kind <> 'other' GROUP BY modality, kind, folder HAVING count(*) = 2""")
def image_pair_scan(spark, d):
    at = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (F.col("n_nationkey") % n + 1).cast("int"))
    t = table(spark, d, "nation").select("n_nationkey", at(("face", "iris", "hand", "fingervein", "voice"), 5).alias("m"), at(("same", "different", "other"), 3).alias("s"), F.explode(F.sequence(F.lit(0), (F.col("n_nationkey") % 4).cast("int"))).alias("k"))
    files = t.select(F.concat(F.lit("/data/"), "m", F.lit("/"), "s", F.lit("/f"), F.col("n_nationkey").cast("string"), F.lit("/"), F.col("k").cast("string"), F.when(F.col("k") == 2, ".txt").otherwise(".PNG")).alias("path"))
    return corpus.image_pairs(files)


@query("SELECT page_id, CASE WHEN url LIKE 'http%' OR url LIKE 'rtsp%' THEN 'ip_camera' WHEN regexp_full_match(url, '[0-9]+') THEN 'camera' ELSE 'path' END AS kind FROM pages UNION ALL SELECT -1 - n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'camera' ELSE 'path' END FROM nation")
def frame_source_kind(spark, d):
    n = table(spark, d, "nation").select((-1 - F.col("n_nationkey")).alias("page_id"), F.concat(F.when(F.col("n_nationkey") % 2 == 0, "").otherwise("/"), F.col("n_nationkey").cast("string")).alias("url"))
    t = table(spark, d, "pages").select("page_id", "url").unionByName(n)
    return t.select(big("page_id").alias("page_id"), frames.source_kind(F.col("url")).alias("kind"))


@query(POINTS + "SELECT image_id, kp_idx FROM p WHERE kp_idx < 100")
def first_n_keypoints(spark, d):
    return keypoints.first_n(points(spark, d), 100).select("image_id", "kp_idx")


# sizes

SIZES = "WITH s AS (SELECT p_partkey, (p_size * 31 + 17)::DOUBLE AS w, (p_size * 23 + 40)::DOUBLE AS h FROM part) "


def sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").selectExpr("p_partkey", "CAST(p_size * 31 + 17 AS DOUBLE) AS w", "CAST(p_size * 23 + 40 AS DOUBLE) AS h")


@query(SIZES + """SELECT p_partkey, round_even(w * (512.0::DOUBLE / greatest(w, h)), 0)::BIGINT AS even_w, round_even(h * (512.0::DOUBLE / greatest(w, h)), 0)::BIGINT AS even_h, trunc(w * 512 / greatest(w, h))::BIGINT AS cut_w, trunc(h * 512 / greatest(w, h))::BIGINT AS cut_h,
trunc(w * (480.0::DOUBLE / w))::BIGINT AS ext_w, trunc(h * (640.0::DOUBLE / h))::BIGINT AS ext_h, round(480 / w, 9) AS scale_x, round(640 / h, 9) AS scale_y, (floor(w / 32) * 32)::BIGINT AS df_w, round(w / (floor(w / 32) * 32), 9) AS back_x, round(h / (floor(h / 32) * 32), 9) AS back_y FROM s""")
def more_resize_rules(spark, d):
    w, h = F.col("w"), F.col("h")
    even, cut, ext, back = keypoints.resize_long_side(w, h, 512), keypoints.resize_long_truncated(w, h, 512), keypoints.extractor_resize(w, h, [640, 480]), keypoints.rescale_to_multiple(w, h)
    whole = {"even_w": even[0], "even_h": even[1], "cut_w": cut[0], "cut_h": cut[1], "ext_w": ext[0], "ext_h": ext[1], "df_w": back[0]}
    return sizes(spark, d).select("p_partkey", *[big(v).alias(n) for n, v in whole.items()], *[F.round(v, 9).alias(n) for n, v in (("scale_x", ext[2]), ("scale_y", ext[3]), ("back_x", back[2]), ("back_y", back[3]))])


# cameras

SKEWED = (500.0, 3.0, 320.0, 0.0, 510.0, 240.0, 0.0, 0.0, 1.0)


@query(GEO + "SELECT id, round((x - 320 - 3 * (y - 240) / 510) / 500, 6) AS nx, round((y - 240) / 510, 6) AS ny, 1.0::DOUBLE AS nw FROM p")
def normalize_full_camera(spark, d):
    x, y = geo.normalize_full(geo.matrix(SKEWED), pq()[0])
    return geo_points(spark, d).select("id", r6(x).alias("nx"), r6(y).alias("ny"), geo.homogeneous((x, y))[2].alias("nw"))


@query(GEO + """SELECT id, round(500 / s, 6) AS fx, round(3 / s, 6) AS skew, round(510 / t, 6) AS fy, round(240 / t, 6) AS cy, CASE id % 4 WHEN 2 THEN 500 ELSE 510 END::DOUBLE AS turned_fx, CASE id % 4 WHEN 1 THEN 240 WHEN 2 THEN 639 - 320 ELSE 479 - 240 END::DOUBLE AS turned_cx, CASE id % 4 WHEN 2 THEN 510 ELSE 500 END::DOUBLE AS turned_fy, CASE id % 4 WHEN 1 THEN 639 - 320 WHEN 2 THEN 479 - 240 ELSE 320 END::DOUBLE AS turned_cy FROM (SELECT id, 1 + (id % 3)::DOUBLE AS s, 1 + (id % 5)::DOUBLE / 2 AS t FROM p)""")
def changed_cameras(spark, d):
    s, t = F.expr("1 + CAST(id % 3 AS DOUBLE)"), F.expr("1 + CAST(id % 5 AS DOUBLE) / 2")
    scaled = geo.scale_intrinsics(geo.matrix(SKEWED), s, t)
    turned = geo.rotate_intrinsics(geo.matrix(K), F.lit(640.0), F.lit(480.0), F.expr("id % 4"))
    return geo_points(spark, d).select("id", scaled.alias("s"), turned.alias("t")).select("id", *cells(F.col("s"), {"fx": 0, "skew": 1, "fy": 4, "cy": 5}), *cells(F.col("t"), {"turned_fx": 0, "turned_cx": 2, "turned_fy": 4, "turned_cy": 5}))


@query("""SELECT vec_id, round(CASE vec_id % 4 WHEN 0 THEN a WHEN 1 THEN e WHEN 2 THEN -a ELSE -e END, 6) + 0.0 AS m00, round(CASE vec_id % 4 WHEN 0 THEN e WHEN 1 THEN -a WHEN 2 THEN -e ELSE a END, 6) + 0.0 AS m10, CASE vec_id % 4 WHEN 0 THEN 0.5 WHEN 1 THEN -0.25 WHEN 2 THEN -0.5 ELSE 0.25 END::DOUBLE AS m03, round(c, 6) AS m20
FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS e, embedding[3]::DOUBLE AS c FROM embeddings)""")
def turned_poses(spark, d):
    e = lambda k: F.col("embedding")[k].cast("double")
    o, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(e(0), o, o, F.lit(0.5), e(1), one, o, F.lit(-0.25), e(2), o, one, F.lit(2.0), o, o, o, one)
    return table(spark, d, "embeddings").select("vec_id", geo.rotate_pose(pose, F.expr("vec_id % 4")).alias("m")).select("vec_id", *cells(F.col("m"), {"m00": 0, "m10": 4, "m03": 3, "m20": 8}))


VECTORS = "WITH v AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS e, embedding[5]::DOUBLE AS f, embedding[6]::DOUBLE AS g FROM embeddings), n AS (SELECT *, sqrt(a * a + b * b + c * c) AS l, sqrt(e * e + f * f + g * g) AS m FROM v), u AS (SELECT *, a / l AS x, b / l AS y, c / l AS z FROM n) "


def vectors(spark: SparkSession, d: str) -> DataFrame:
    part = lambda k: F.slice("embedding", k, 3).cast("array<double>")
    return table(spark, d, "embeddings").select("vec_id", part(1).alias("p"), part(4).alias("q"), F.slice("embedding", 1, 4).cast("array<double>").alias("h"), F.col("embedding")[6].cast("double").alias("angle"))


@query(VECTORS + "SELECT vec_id, round(l, 6) AS norm, round(x, 6) AS unit, round(b * g - c * f, 6) + 0.0 AS cross_x, round(a * f - b * e, 6) + 0.0 AS cross_z, round(acos((a * e + b * f + c * g) / (l * m)), 6) AS angle, round(acos(abs(a * e + b * f + c * g) / (l * m)), 6) AS undirected, round(-c, 6) + 0.0 AS skew01, round(b, 6) AS skew02 FROM n JOIN u USING (vec_id, a, b, c, e, f, g, l, m)")
def vector_functions(spark, d):
    p, q = F.col("p"), F.col("q")
    cross, s = tr.vector_product(p, q), geo.skew([p[k] for k in range(3)])
    return vectors(spark, d).select("vec_id", r6(tr.vector_norm(p)).alias("norm"), r6(tr.unit_vector(p)[0]).alias("unit"), *cells(cross, {"cross_x": 0, "cross_z": 2}), r6(tr.angle_between_vectors(p, q)).alias("angle"), r6(tr.angle_between_vectors(p, q, directed=False)).alias("undirected"), *cells(s, {"skew01": 1, "skew02": 2}))


# rigid transforms: p is a direction, q a point


@query(VECTORS + "SELECT vec_id, 1.0::DOUBLE AS i00, round(a, 6) + 0.0 AS t03, round(c, 6) + 0.0 AS back_z, round(1 - 2 * x * x, 6) AS r00, round(-2 * x * y, 6) + 0.0 AS r01, round(2 * (e * x + f * y + g * z) * z, 6) + 0.0 AS r23 FROM u")
def translation_and_reflection(spark, d):
    t, r = tr.translation_matrix([F.col("p")[k] for k in range(3)]), tr.reflection_matrix(F.col("q"), F.col("p"))
    return vectors(spark, d).select("vec_id", tr.identity_matrix()[0].alias("i00"), *cells(t, {"t03": 3}), *cells(tr.translation_from_matrix(t), {"back_z": 2}), *cells(r, {"r00": 0, "r01": 1, "r23": 11}))


ROTATED = VECTORS + ", r AS (SELECT vec_id, x, y, z, e, f, g, cos(t) + x * x * (1 - cos(t)) AS m00, x * y * (1 - cos(t)) - z * sin(t) AS m01, x * z * (1 - cos(t)) + y * sin(t) AS m02, cos(t) AS co FROM (SELECT u.*, embedding[7]::DOUBLE AS t FROM u JOIN embeddings USING (vec_id))) "


@query(ROTATED + "SELECT vec_id, round(m00, 6) AS m00, round(m01, 6) + 0.0 AS m01, round(m02, 6) + 0.0 AS m02, round(e - m00 * e - m01 * f - m02 * g, 6) + 0.0 AS m03 FROM r")
def rotation_about_point(spark, d):
    m = tr.rotation_matrix(F.col("angle"), F.col("p"), F.col("q"))
    return vectors(spark, d).select("vec_id", m.alias("m")).select("vec_id", *cells(F.col("m"), {"m00": 0, "m01": 1, "m02": 2, "m03": 3}))


@query(VECTORS + "SELECT vec_id, -1.5::DOUBLE AS s00, round(2.5 * e, 6) + 0.0 AS s03, round(1 - 2.5 * x * x, 6) AS d00, round(-2.5 * y * x, 6) + 0.0 AS d10, round(2.5 * (e * x + f * y + g * z) * y, 6) + 0.0 AS d13 FROM u")
def scale_matrices(spark, d):
    s, along = tr.scale_matrix(F.lit(-1.5), F.col("q")), tr.scale_matrix(F.lit(-1.5), F.col("q"), F.col("p"))
    return vectors(spark, d).select("vec_id", *cells(s, {"s00": 0, "s03": 3}), *cells(along, {"d00": 0, "d10": 4, "d13": 7}))


@query(VECTORS + """, w AS (SELECT *, e * x + f * y + g * z AS pn, x + 2 * y + 3 * z AS vn FROM u) SELECT vec_id, round(1 - x * x, 6) AS o00, round(pn * y, 6) + 0.0 AS o13, round(-x, 6) + 0.0 AS p30, round(vn, 6) + 0.0 AS p33, round((vn - pn) - 1 * x, 6) + 0.0 AS p00, round(pn * 2, 6) + 0.0 AS p13, round((vn - pn) - 1 * x - x * x, 6) + 0.0 AS q00, round(pn * (2 + y), 6) + 0.0 AS q13 FROM w""")
def projection_matrices(spark, d):
    eye = geo.matrix([1, 2, 3])
    o, p, q = tr.projection_matrix(F.col("q"), F.col("p")), tr.projection_matrix(F.col("q"), F.col("p"), perspective=eye), tr.projection_matrix(F.col("q"), F.col("p"), perspective=eye, pseudo=True)
    return vectors(spark, d).select("vec_id", *cells(o, {"o00": 0, "o13": 7}), *cells(p, {"p30": 12, "p33": 15, "p00": 0, "p13": 7}), *cells(q, {"q00": 0, "q13": 7}))


@query("SELECT p_partkey, round(2 / w, 6) AS o00, round(-(2 * l + w) / w, 6) AS o03, round(2 / 30.0, 6)::DOUBLE AS o22, round(-4 / w, 6) AS p00, round((2 * l + w) / w, 6) AS p02, round(-34 / 30.0, 6)::DOUBLE AS p22, round(128 / 30.0, 6)::DOUBLE AS p23 FROM (SELECT p_partkey, (p_size * 2 + 1)::DOUBLE AS w, -(p_size::DOUBLE) AS l FROM part)")
def clip_matrices(spark, d):
    w, left = F.expr("CAST(p_size * 2 + 1 AS DOUBLE)"), F.expr("-CAST(p_size AS DOUBLE)")
    sides = (left, left + w, F.lit(-1.0), F.lit(1.0), F.lit(2.0), F.lit(32.0))
    o, p = tr.clip_matrix(*sides), tr.clip_matrix(*sides, perspective=True)
    return table(spark, d, "part").select("p_partkey", *cells(o, {"o00": 0, "o03": 3, "o22": 10}), *cells(p, {"p00": 0, "p02": 2, "p22": 10, "p23": 11}))


@query(VECTORS + """, w AS (SELECT vec_id, x, y, z, e, f, g, -y / sqrt(x * x + y * y) AS dx, x / sqrt(x * x + y * y) AS dy, tan(0.3) AS k FROM u) SELECT vec_id, round(1 + k * dx * x, 6) AS m00, round(k * dx * y, 6) + 0.0 AS m01, round(k * dy * x, 6) + 0.0 AS m10, round(-k * (e * x + f * y + g * z) * dx, 6) + 0.0 AS m03 FROM w""")
def shear_matrices(spark, d):
    p = F.col("p")
    m = tr.shear_matrix(F.lit(0.3), F.array(-p[1], p[0], F.lit(0.0)), F.col("q"), p)
    return vectors(spark, d).select("vec_id", *cells(m, {"m00": 0, "m01": 1, "m10": 4, "m03": 3}))


@query("""SELECT p_partkey, round(a * sin(radians(80.0)) * sqrt(1 - co * co), 6) AS m00, round(-a * sin(radians(80.0)) * co, 6) + 0.0 AS m10, round(20 * sin(radians(70.0)), 6) AS m11, round(a * cos(radians(80.0)), 6) AS m20, 30.0::DOUBLE AS m22
FROM (SELECT p_partkey, p_size::DOUBLE AS a, (cos(radians(70.0)) * cos(radians(80.0)) - cos(radians(100.0))) / (sin(radians(70.0)) * sin(radians(80.0))) AS co FROM part)""")
def crystal_cells(spark, d):
    m = tr.orthogonalization_matrix(F.expr("CAST(p_size AS DOUBLE)"), *[F.lit(v) for v in (20.0, 30.0, 70.0, 80.0, 100.0)])
    return table(spark, d, "part").select("p_partkey", *cells(m, {"m00": 0, "m10": 4, "m11": 5, "m20": 8, "m22": 10}))


@query(ROTATED + """, h AS (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c, embedding[4]::DOUBLE AS e, embedding[7]::DOUBLE AS t FROM embeddings) SELECT vec_id, round(cos(t / 2), 6) AS qw, round(x * sin(t / 2), 6) + 0.0 AS qx, round(m00, 6) AS m00, round(m01, 6) + 0.0 AS m01, round(-h.b / (h.a ** 2 + h.b ** 2 + h.c ** 2 + h.e ** 2), 6) + 0.0 AS inv_x, round(h.a, 6) + 0.0 AS re, round(h.e, 6) + 0.0 AS im_z, round(-h.c, 6) + 0.0 AS conj_y FROM r JOIN h USING (vec_id)""")
def quaternion_functions(spark, d):
    q, h = tr.quaternion_about_axis(F.col("angle"), F.col("p")), F.col("h")
    t = vectors(spark, d).withColumn("turn", q).select("*", tr.quaternion_matrix(F.col("turn")).alias("m"))
    return t.select("vec_id", *cells(F.col("turn"), {"qw": 0, "qx": 1}), *cells(F.col("m"), {"m00": 0, "m01": 1}), *cells(tr.quaternion_inverse(h), {"inv_x": 1}), (r6(tr.quaternion_real(h)) + 0.0).alias("re"), *cells(tr.quaternion_imag(h), {"im_z": 2}), *cells(tr.quaternion_conjugate(h), {"conj_y": 2}))


@query("SELECT vec_id, true AS same, true AS back, true AS rotation_back, round(abs(embedding[7]::DOUBLE), 6) AS angle, 2.5::DOUBLE AS factor, round(embedding[4]::DOUBLE, 5) + 0.0 AS origin_x, true AS euler_back, true AS quaternion_back FROM embeddings")
def transforms_and_back(spark, d):
    """Matrices times their inverses, and what recoveries give again: the angle, the factor and the origin that were put in."""
    turn, move = tr.rotation_matrix(F.col("angle"), F.col("p")), tr.translation_matrix([F.col("q")[k] for k in range(3)])
    t = vectors(spark, d).withColumn("turn", turn).withColumn("m", tr.concatenate_matrices(move, F.col("turn")))
    t = stored(t, "transforms")  # else each use works the matrices out again
    t = t.withColumn("eye", tr.concatenate_matrices(tr.inverse_rigid(F.col("m")), F.col("m"))).withColumn("inverse", tr.apply("inverse_matrix")(F.col("m")))
    t = t.withColumn("spun", tr.apply("rotation_from_matrix")(F.col("turn"))).withColumn("s", tr.scale_matrix(F.lit(2.5), F.col("q"))).withColumn("stretched", tr.apply("scale_from_matrix")(F.col("s")))
    t = t.withColumn("angles", tr.apply("euler_from_matrix")(F.col("turn"))).withColumn("quaternion", tr.apply("quaternion_from_matrix")(F.col("turn")))
    t = stored(t, "recovered")
    again = tr.rotation_matrix(F.col("spun")[0], F.slice("spun", 2, 3))
    by_euler = tr.euler_matrix([F.col("angles")[k] for k in range(3)])
    values = [r6(F.abs(F.col("spun")[0])).alias("angle"), r6(F.col("stretched")[0]).alias("factor"), (F.round(F.col("stretched")[1], 5) + 0.0).alias("origin_x")]
    return t.select("vec_id", tr.is_same_transform(F.col("eye"), tr.identity_matrix()).alias("same"), tr.is_same_transform(F.col("inverse"), tr.inverse_rigid(F.col("m"))).alias("back"), tr.is_same_transform(again, F.col("turn")).alias("rotation_back"), *values, tr.is_same_transform(by_euler, F.col("turn")).alias("euler_back"), tr.is_same_transform(tr.quaternion_matrix(F.col("quaternion")), F.col("turn")).alias("quaternion_back"))


@query("SELECT vec_id, round(1 + abs(a), 4) AS sx, round(b, 4) + 0.0 AS shear_xy, round(c, 4) + 0.0 AS turn_x, round(a, 4) + 0.0 AS move_x FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)")
def decomposed_matrices(spark, d):
    e, o = lambda k: F.col("embedding")[k].cast("double"), F.lit(0.0)
    parts = F.array(1 + F.abs(e(0)), F.lit(1.5), F.lit(2.0), e(1), o, o, e(2), F.lit(0.2), F.lit(-0.1), e(0), F.lit(3.0), F.lit(4.0))
    t = table(spark, d, "embeddings").select("vec_id", tr.apply("compose_matrix")(parts).alias("m")).select("vec_id", tr.apply("decompose_matrix")(F.col("m")).alias("x"))
    return t.select("vec_id", *[(F.round(F.col("x")[k], 4) + 0.0).alias(n) for n, k in (("sx", 0), ("shear_xy", 3), ("turn_x", 6), ("move_x", 9))])


@query("SELECT DISTINCT vec_id % 10 AS pair_id, 1.0 + vec_id % 10 AS move_x, -2.0::DOUBLE AS move_y, round(0.2 + (vec_id % 10) / 10, 6) AS angle FROM embeddings")
def superimposed_points(spark, d):
    """Points in space and their places after one rigid motion for each pair: its move and angle."""
    pair = F.expr("vec_id % 10")
    m = tr.concatenate_matrices(tr.translation_matrix([1.0 + pair, F.lit(-2.0), F.lit(0.5)]), tr.rotation_matrix(0.2 + pair / 10, geo.matrix([1, 2, 2])))
    t = vectors(spark, d).withColumn("m", m)
    at = lambda r: sum((F.col("m")[4 * r + c] * F.col("q")[c] for c in range(3)), F.col("m")[4 * r + 3])
    t = t.select(pair.alias("pair_id"), *[F.col("q")[k].alias(n) for k, n in enumerate(("x1", "y1", "z1"))], *[at(k).alias(n) for k, n in enumerate(("x2", "y2", "z2"))])
    turn = F.acos((F.col("m")[0] + F.col("m")[5] + F.col("m")[10] - 1) / 2)
    return robust.superimpositions(t).select("pair_id", r6(F.col("m")[3]).alias("move_x"), r6(F.col("m")[7]).alias("move_y"), r6(turn).alias("angle"))


@query("SELECT vec_id, round(least(a, 360 - a), 2) AS r_err, round(least(b, 180 - b), 2) AS t_err FROM (SELECT vec_id, (vec_id * 7 % 360)::DOUBLE AS a, (vec_id * 11 % 180)::DOUBLE AS b FROM embeddings)")
def pose_differences(spark, d):
    """Between rotations and between directions, exact near no turn and near half a turn."""
    a, b, o = F.radians(F.expr("CAST(vec_id * 7 % 360 AS DOUBLE)")), F.radians(F.expr("CAST(vec_id * 11 % 180 AS DOUBLE)")), F.lit(0.0)
    turn = F.array(F.cos(a), -F.sin(a), o, F.sin(a), F.cos(a), o, o, o, F.lit(1.0))
    t = table(spark, d, "embeddings").select("vec_id", geo.matrix([1, 0, 0, 0, 1, 0, 0, 0, 1]).alias("r_true"), geo.matrix([3, 0, 0]).alias("t_true"), turn.alias("r"), F.array(F.cos(b) * 2, F.sin(b) * 2, o).alias("t"))
    return robust.pose_differences(t, "vec_id").select("vec_id", F.round("r_err", 2).alias("r_err"), F.round("t_err", 2).alias("t_err"))


@query("SELECT n_nationkey::BIGINT AS pair_id, true AS moves_corners, true AS again FROM nation")
def random_homographies(spark, d):
    """Of the unit square, whose corners move by less than the bound; the same in each run."""
    n = table(spark, d, "nation").select(big("n_nationkey").alias("pair_id"))
    h = robust.random_homographies(n, 0.25, 3)
    far = F.greatest(*[F.greatest(*[F.abs(v - F.lit(float(c))) for v, c in zip(geo.perspective(F.col("h"), (F.lit(float(x)), F.lit(float(y)))), (x, y), strict=True)]) for x in (0, 1) for y in (0, 1)])
    again = robust.random_homographies(n.repartition(3), 0.25, 3).select("pair_id", F.col("h").alias("h2"))
    return h.join(again, "pair_id").select("pair_id", (far <= 0.25 + 1e-9).alias("moves_corners"), (F.col("h") == F.col("h2")).alias("again"))


@query("SELECT s_suppkey AS pair_id, 0.0::DOUBLE AS none, round((1 + s_suppkey % 50) / 800.0::DOUBLE, 6) AS shifted FROM supplier")
def fundamental_distance(spark, d):
    """Of level epipolar lines from themselves, scaled, and from those so many pixels lower, in diagonals of 800."""
    t = table(spark, d, "supplier").select(big("s_suppkey").alias("pair_id"), (1 + F.col("s_suppkey") % 50).cast("double").alias("lower"))
    level = lambda by, down: F.array(*[F.lit(0.0)] * 5, -by, F.lit(0.0), by, by * down)
    size = geo.matrix([640, 480])
    pairs = t.select("pair_id", "lower", level(F.lit(1.0), F.lit(0.0)).alias("f1"), size.alias("size1"), size.alias("size2"))
    same = robust.fundamental_distance(pairs.withColumn("f2", level(F.col("lower"), F.lit(0.0))), samples=100)
    other = robust.fundamental_distance(pairs.withColumn("f2", level(F.lit(2.0), F.col("lower"))), samples=100)
    return same.join(other.select("pair_id", F.col("sgd").alias("other")), "pair_id").select("pair_id", (r6("sgd") + 0.0).alias("none"), r6("other").alias("shifted"))


@query(GEO + "SELECT id, round(abs(1e-3 * x * u + 2e-3 * y * v - 1.5 * u + 0.5 * v + 20) / (sqrt((1e-3 * x - 1.5) ** 2 + (2e-3 * y + 0.5) ** 2) + 1e-8), 6) AS d FROM p")
def epipolar_line_distance(spark, d):
    p, q = pq()
    line = geo.times(geo.matrix([1e-3, 0, -1.5, 0, 2e-3, 0.5, 0, 0, 20]), geo.homogeneous(p))
    return geo_points(spark, d).select("id", r6(geo.line_distance(line, q)).alias("d"))


# detectors and matches


@query("SELECT vec_id AS image_id, row_number() OVER (PARTITION BY vec_id ORDER BY k) - 1 AS kp_idx, (k % 8)::DOUBLE AS x, floor(k / 8.0)::DOUBLE AS y, 3.0::DOUBLE AS size FROM (SELECT vec_id, unnest(range(64)) AS k, unnest(embedding[1:64])::DOUBLE AS e FROM embeddings) WHERE abs(e) > 0.15")
def mask_keypoints(spark, d):
    t = table(spark, d, "embeddings").select(F.col("vec_id").alias("image_id"), F.posexplode("embedding").alias("k", "e"))
    t = t.select("image_id", F.floor(F.col("k") / 8).alias("y"), (F.col("k") % 8).alias("x"), F.abs(F.col("e").cast("double")).alias("p"))
    return keypoints.mask_to_keypoints(t, 0.15).select("image_id", big("kp_idx").alias("kp_idx"), "x", "y", "size")


@query("WITH e AS (SELECT n_nationkey AS p, 20 + n_nationkey % 10 AS w0, 10 + n_nationkey % 5 AS h0, 18 + n_nationkey % 7 AS w1, 12 + n_nationkey % 3 AS h1 FROM nation), s AS (SELECT label AS pair_id, vec_id AS i, (vec_id * 7) % 600 AS j FROM embeddings) SELECT pair_id::BIGINT AS pair_id, i, j FROM s JOIN e ON p = pair_id WHERE i % 32 BETWEEN 2 AND w0 - 3 AND floor(i / 32.0) BETWEEN 2 AND h0 - 3 AND j % 32 BETWEEN 2 AND w1 - 3 AND floor(j / 32.0) BETWEEN 2 AND h1 - 3")
def padded_border(spark, d):
    size = lambda w, h, a, b: table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS image_id", f"{a} + n_nationkey % {w} AS w", f"{b} + n_nationkey % {h} AS h")
    valid = lambda t: t.select("image_id", "w", F.explode(F.expr("sequence(0, CAST(h AS INT) - 1)")).alias("y")).select("image_id", F.explode(F.expr("transform(sequence(0, CAST(w AS INT) - 1), x -> y * 32 + x)")).alias("cell"))
    s = table(spark, d, "embeddings").selectExpr("CAST(label AS BIGINT) AS pair_id", "vec_id AS i", "(vec_id * 7) % 600 AS j")
    return assign.inside_padded_border(s, *[assign.extents(valid(size(*x)), 32) for x in ((10, 5, 20, 10), (7, 3, 18, 12))], 2, 32)


@query("SELECT vec_id % 10 AS pair_id, vec_id % 3 AS layer, vec_id AS cell, round(c, 6) AS conf, (vec_id % 20 * 8)::DOUBLE AS x1, (floor(vec_id / 20.0) * 8)::DOUBLE AS y1, round(a * 8, 6) + 0.0 AS x2 FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, CASE WHEN vec_id % 7 = 0 THEN 100.0 ELSE (embedding[3]::DOUBLE * 20 + embedding[4]::DOUBLE * 20) / 2 END AS c FROM embeddings) WHERE c < 2 OR vec_id = 0")
def flow_matches(spark, d):
    e = lambda k: F.col("embedding")[k].cast("double")
    t = table(spark, d, "embeddings").select(F.expr("vec_id % 10").alias("pair_id"), F.expr("vec_id % 3").alias("layer"), F.col("vec_id").alias("cell"), e(0).alias("fx"), e(1).alias("fy"), (e(2) * 20).alias("vx"), (e(3) * 20).alias("vy"))
    mask = t.where("cell % 7 <> 0").select("pair_id", "cell")
    return assign.flow_matches(t, 20, 8.0, mask=mask).select("pair_id", "layer", "cell", r6("conf").alias("conf"), "x1", "y1", (r6("x2") + 0.0).alias("x2"))


# supervision


@query("""WITH d AS (SELECT n_nationkey AS i, y, x, CASE WHEN (n_nationkey + y * 3 + x * 5) % 11 = 0 THEN 0.0 ELSE 1 + (n_nationkey + y * 7 + x * 2) % 9 END::DOUBLE AS z FROM nation, range(6) s(y), range(8) t(x)), p AS (SELECT n_nationkey AS i, k, (k * 0.73)::DOUBLE AS x, ((k * 0.41 + n_nationkey * 0.13) % 6)::DOUBLE AS y FROM nation, range(10) t(k)),
c AS (SELECT p.i, k, p.x - floor(p.x) AS dx, p.y - floor(p.y) AS dy, a.z AS d0, b.z AS d1, c.z AS d2, e.z AS d3 FROM p JOIN d a ON a.i = p.i AND a.y = floor(p.y) AND a.x = floor(p.x) JOIN d b ON b.i = p.i AND b.y = floor(p.y) AND b.x = ceil(p.x) JOIN d c ON c.i = p.i AND c.y = ceil(p.y) AND c.x = floor(p.x) JOIN d e ON e.i = p.i AND e.y = ceil(p.y) AND e.x = ceil(p.x) WHERE p.x > 0 AND p.x < 7 AND p.y > 0 AND p.y < 5 AND a.z > 0 AND b.z > 0 AND c.z > 0)
SELECT p.i::BIGINT AS image_id, p.k AS kp_idx, round((1 - dy) * (1 - dx) * d0 + (1 - dy) * dx * d1 + dy * (1 - dx) * d2 + dy * dx * d3, 6)::DOUBLE AS z FROM p LEFT JOIN c ON c.i = p.i AND c.k = p.k""")
def depth_interpolation(spark, d):
    n = table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS image_id")
    at = n.select("image_id", F.explode(F.expr("sequence(0L, 5L)")).alias("y")).select("image_id", "y", F.explode(F.expr("sequence(0L, 7L)")).alias("x"))
    depth = at.withColumn("depth", F.expr("CAST(CASE WHEN (image_id + y * 3 + x * 5) % 11 = 0 THEN 0 ELSE 1 + (image_id + y * 7 + x * 2) % 9 END AS DOUBLE)"))
    p = n.select("image_id", F.explode(F.expr("sequence(0L, 9L)")).alias("kp_idx")).selectExpr("image_id", "kp_idx", "CAST(kp_idx * 0.73 AS DOUBLE) AS x", "CAST((kp_idx * 0.41 + image_id * 0.13) % 6 AS DOUBLE) AS y")
    return sup.interpolate_depth(p, depth, n.selectExpr("image_id", "6 AS h", "8 AS w")).select("image_id", "kp_idx", r6("z").alias("z"))


@query(GEO + ", z AS (SELECT *, CASE WHEN id % 4 = 0 THEN NULL ELSE 2 + (id % 5) * 0.5 END AS z FROM p), c AS (SELECT id, (x - 320) / 500 * z + 0.1 AS cx, (y - 240) / 510 * z - 0.2 AS cy, z + 0.05 AS cz FROM z) SELECT id, round(coalesce(500 * cx / cz + 320, 1e5), 6)::DOUBLE AS px, round(coalesce(510 * cy / cz + 240, 1e5), 6)::DOUBLE AS py, cz IS NOT NULL AS valid FROM c")
def reprojection_with_depth(spark, d):
    k = geo.matrix(K)
    t = geo_points(spark, d).withColumn("z", F.expr("CAST(CASE WHEN id % 4 = 0 THEN NULL ELSE 2 + (id % 5) * 0.5 END AS DOUBLE)"))
    return sup.reproject(t, k, k, geo.matrix([1, 0, 0, 0, 1, 0, 0, 0, 1]), geo.matrix([0.1, -0.2, 0.05])).select("id", r6("px").alias("px"), r6("py").alias("py"), "valid")


NEAR = """WITH k AS (SELECT vec_id, (label % 2)::BIGINT AS pair_id, ((vec_id * 37) % 20)::DOUBLE AS x, ((vec_id * 91) % 15)::DOUBLE AS y, vec_id % 2 AS side, embedding::DOUBLE[] AS e FROM embeddings), l AS (SELECT pair_id, vec_id AS i, x, y, x + 1.25 AS px, y + 0.5 AS py, e FROM k WHERE side = 0), r AS (SELECT pair_id, vec_id AS j, x + 1.25 AS x, y + 0.5 AS y, x AS px, y AS py, e FROM k WHERE side = 1),
m AS (SELECT pair_id, i, j, greatest(sqrt((l.px - r.x) ** 2 + (l.py - r.y) ** 2), sqrt((r.px - l.x) ** 2 + (r.py - l.y) ** 2)) AS d, l.x AS ax, l.y AS ay, r.x AS bx, r.y AS by_ FROM l JOIN r USING (pair_id)),
f AS (SELECT *, row_number() OVER (PARTITION BY pair_id, i ORDER BY round(d, 9), j) AS a, row_number() OVER (PARTITION BY pair_id, j ORDER BY round(d, 9), i) AS b FROM m) """


def near_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, d, "embeddings").selectExpr("CAST(label % 2 AS BIGINT) AS pair_id", "vec_id AS idx", "CAST((vec_id * 37) % 20 AS DOUBLE) AS x", "CAST((vec_id * 91) % 15 AS DOUBLE) AS y", "embedding AS descriptor")
    there = lambda a, b: [(F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")]
    left = t.where("idx % 2 = 0").select("pair_id", "idx", "x", "y", (F.col("x") + 1.25).alias("px"), (F.col("y") + 0.5).alias("py"), "descriptor")
    right = t.where("idx % 2 = 1").select("pair_id", "idx", *there(1.25, 0.5), F.col("x").alias("px"), F.col("y").alias("py"), "descriptor")
    return left, right


@query(NEAR + "SELECT pair_id, i, j, round(d, 6) AS d, 'match' AS kind FROM f WHERE a = 1 AND b = 1 AND d < 3 UNION ALL SELECT pair_id, i, -1, -1, 'left' FROM f WHERE a = 1 AND d > 1.9 UNION ALL SELECT pair_id, -1, j, -1, 'right' FROM f WHERE b = 1 AND d > 1.9")
def ground_truth_matches(spark, d):
    m, alone_i, alone_j = sup.correspondences(*near_sides(spark, d), 3.0, 1.9)
    none = F.lit(-1).cast("long")
    return m.select("pair_id", "i", "j", r6("d").alias("d"), F.lit("match").alias("kind")).unionByName(alone_i.select("pair_id", "i", none.alias("j"), none.cast("double").alias("d"), F.lit("left").alias("kind"))).unionByName(alone_j.select("pair_id", none.alias("i"), "j", none.cast("double").alias("d"), F.lit("right").alias("kind")))


@query(NEAR + """, t AS (SELECT pair_id, i AS mi, j AS mj, ax, ay, bx, by_ FROM f WHERE a = 1 AND b = 1 AND d < 3), u AS (SELECT t.pair_id, mi, mj, l.i, r.j, list_inner_product(l.e, r.e) AS s, count(*) OVER (PARTITION BY t.pair_id, mi, mj) AS n FROM t JOIN l ON l.pair_id = t.pair_id AND l.x = ax AND l.y = ay JOIN r ON r.pair_id = t.pair_id AND r.x = bx AND r.y = by_)
SELECT pair_id, i, j FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, mi, mj ORDER BY round(s, 12) DESC, i, j) AS k FROM u) WHERE k = 1""")
def best_of_same_place(spark, d):
    left, right = near_sides(spark, d)
    return sup.best_of_same_place(sup.correspondences(left, right, 3.0, 1.9)[0], left, right)


@query("WITH t AS (SELECT vec_id AS i, embedding[1]::DOUBLE * 40 + 10 AS x, embedding[2]::DOUBLE * 40 + 8 AS y FROM embeddings), c AS (SELECT i, round_even(x, 0) AS cx, round_even(y, 0) AS cy FROM t), g AS (SELECT i, CASE WHEN cx >= 0 AND cx < 20 AND cy >= 0 AND cy < 16 THEN cx + cy * 20 ELSE 0 END::BIGINT AS j FROM c) SELECT (i % 10) AS pair_id, i, j FROM g WHERE i > 0 AND j > 0 AND (j * 3 + i) % 2 = 0")
def grid_matches(spark, d):
    e = lambda k: F.col("embedding")[k].cast("double")
    there = table(spark, d, "embeddings").select(F.expr("vec_id % 10").alias("pair_id"), F.col("vec_id").alias("i"), sup.cell_of(e(0) * 40 + 10, e(1) * 40 + 8, F.lit(20), F.lit(16)).alias("j"))
    back = there.where("(j * 3 + i) % 2 = 0").select("pair_id", "j", "i")  # cells that lead back
    return sup.grid_matches(there, back)


@query(GEO + "SELECT id, round((u - x) / 2 / 4, 6) AS ox, round((v - y) / 2 / 4, 6) AS oy FROM p")
def fine_offsets(spark, d):
    t = geo_points(spark, d).select("id", F.col("u").alias("wx"), F.col("v").alias("wy"), F.col("x").alias("x1"), F.col("y").alias("y1"))
    return sup.fine_offsets(t, 2.0, 4).select("id", r6("ox").alias("ox"), r6("oy").alias("oy"))


@query("SELECT vec_id AS image_id, vec_id AS cell, CASE WHEN vec_id % 3 = 0 THEN x ELSE 0 END AS x, CASE WHEN vec_id % 3 = 0 THEN y ELSE 0 END AS y FROM (SELECT vec_id, ((vec_id * 37) % 640)::DOUBLE AS x, ((vec_id * 91) % 480)::DOUBLE AS y FROM embeddings)")
def padded_points_to_zero(spark, d):
    t = table(spark, d, "embeddings").selectExpr("vec_id AS image_id", "vec_id AS cell", "CAST((vec_id * 37) % 640 AS DOUBLE) AS x", "CAST((vec_id * 91) % 480 AS DOUBLE) AS y")
    return sup.at_valid(t, t.where("cell % 3 = 0").select("image_id", "cell"))


@query("SELECT n_nationkey::BIGINT AS match_id, r, coalesce(fx * 100 + fy, -1)::BIGINT AS feature FROM (SELECT n_nationkey, r, (n_nationkey % 6) * 2 + r % 3 - 1 AS x, (n_nationkey % 4) * 2 + floor(r / 3.0)::BIGINT - 1 AS y FROM nation, range(9) t(r)) LEFT JOIN (SELECT x AS fx, y AS fy FROM range(12) a(x), range(8) b(y)) ON fx = x AND fy = y")
def fine_windows(spark, d):
    m = table(spark, d, "nation").selectExpr("CAST(n_nationkey AS BIGINT) AS match_id", "0 AS image_id", "n_nationkey % 6 AS cx", "n_nationkey % 4 AS cy")
    grid = spark.range(12).select(F.col("id").alias("x"), F.explode(F.expr("sequence(0L, 7L)")).alias("y")).selectExpr("0 AS image_id", "x", "y", "x * 100 + y AS feature")
    return assign.window_cells(m, grid, 3, 2).select("match_id", big("r").alias("r"), F.coalesce(big("feature"), F.lit(-1)).cast("long").alias("feature"))


@query("SELECT l AS pair_id, least(f, 20 - 5)::BIGINT AS found, (20 - least(f, 20 - 5))::BIGINT AS filled FROM (SELECT label::BIGINT AS l, count(*) FILTER (vec_id % 3 = 0) AS f FROM embeddings GROUP BY 1)")
def padded_samples(spark, d):
    t = table(spark, d, "embeddings").selectExpr("CAST(label AS BIGINT) AS pair_id", "vec_id AS i", "vec_id + 1 AS j")
    s = sup.padded_samples(t.where("i % 3 = 0").withColumn("conf", F.lit(0.5)), t.where("i % 3 = 1"), 20, 5, 7)
    return s.groupBy("pair_id").agg(big(F.count_if(F.col("conf") > 0)).alias("found"), big(F.count_if(F.col("conf") == 0)).alias("filled"))


@query("WITH n AS (SELECT count(*) AS n FROM events) SELECT r AS rank, ceil(n / 7.0)::BIGINT AS items, n AS different FROM n, range(7) t(r)")
def rank_split(spark, d):
    t = sup.rank_split(table(spark, d, "events").select("event_id"), 7, 5, "event_id")
    n = t.select("event_id").distinct().count()
    return t.groupBy(big("rank").alias("rank")).agg(F.count("*").alias("items")).withColumn("different", F.lit(n).cast("long"))


# metrics


@query(GEO + """, n AS (SELECT id, (x - 320) / 500 AS nx, (y - 240) / 510 AS ny, (u - 320) / 500 AS nu, (v - 240) / 510 AS nv FROM p), l AS (SELECT *, -0.3 * ny + 0.2 AS a, 0.3 * nx - 0.1 AS b, -0.2 * nx + 0.1 * ny AS c, 0.3 * nv - 0.2 AS s, -0.3 * nu + 0.1 AS t FROM n)
SELECT id % 10 AS pair_id, (id // 10) % 3 AS layer, CASE WHEN id % 2 = 0 THEN 'left' ELSE 'right' END AS side, round(avg((nu * a + nv * b + c) ** 2 * (1 / (a * a + b * b) + 1 / (s * s + t * t))), 6) AS err FROM l GROUP BY ALL""")
def layered_epipolar_errors(spark, d):
    m = geo_points(spark, d).selectExpr("id % 10 AS pair_id", "(id div 10) % 3 AS layer", "CASE WHEN id % 2 = 0 THEN 'left' ELSE 'right' END AS side", "x AS x1", "y AS y1", "u AS x2", "v AS y2")
    poses = m.select("pair_id").distinct().withColumn("rotation", geo.matrix([1, 0, 0, 0, 1, 0, 0, 0, 1])).withColumn("translation", geo.matrix([0.1, 0.2, 0.3])).withColumn("k0", geo.matrix(K)).withColumn("k1", geo.matrix(K))
    return metrics.epipolar_errors(m, poses).groupBy("pair_id", "layer", "side").agg(r6(F.avg("epi_err")).alias("err"))


@query("SELECT 'loss' AS name, round(avg(value), 6) AS value FROM events UNION ALL SELECT 'user', round(avg(user_id), 6) FROM events")
def rank_mean(spark, d):
    t = table(spark, d, "events").select(F.col("value").alias("loss"), F.col("user_id").alias("user"))
    return metrics.rank_mean(t, ["loss", "user"]).select("name", r6("value").alias("value"))
