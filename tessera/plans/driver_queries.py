"""The driver's queries of the feature-matching operators, each with its SQL.

Descriptors are ``embeddings`` (even ids against odd ids), keypoints derive
from the ids, errors are ``events.value``, and pairs of images are pairs of
labels.  Ratios are 0.98, since smaller ones leave nothing of these tables;
other constants are tested on planted data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import transforms as tr
from ..operators import assign, keypoints, knn, metrics, robust
from ..operators import assign_descriptors as descriptors
from ..streaming import frames
from . import registry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
RATIO = 0.98


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def big(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# descriptors


def sides(spark: SparkSession, d: str, by_label: bool = False) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings").select((F.col("label") if by_label else F.lit(0)).cast("int").alias("pair_id"), F.col("vec_id").alias("idx"), F.col("embedding").alias("descriptor"))
    return e.where("idx % 2 = 0"), e.where("idx % 2 = 1")


PAIRS = """WITH a AS (SELECT vec_id AS i, embedding::DOUBLE[] AS e, label AS la FROM embeddings WHERE vec_id % 2 = 0),
b AS (SELECT vec_id AS j, embedding::DOUBLE[] AS f, label AS lb FROM embeddings WHERE vec_id % 2 = 1),
n AS (SELECT i, j, la, lb, d, row_number() OVER (PARTITION BY i ORDER BY round(d, 12), j) AS r, row_number() OVER (PARTITION BY j ORDER BY round(d, 12), i) AS c
  FROM (SELECT i, j, la, lb, list_distance(e, f) AS d FROM a, b)),
two AS (SELECT i, max(CASE WHEN r = 1 THEN j END) AS j, max(CASE WHEN r = 1 THEN d END) AS d1, max(CASE WHEN r = 2 THEN d END) AS d2 FROM n WHERE r <= 2 GROUP BY i) """


@query(PAIRS + f"SELECT t.i, t.j, round(d1, 6) AS d1, round(d1 / d2, 6) AS ratio, la = lb AS same_label FROM two t JOIN n ON n.i = t.i AND n.j = t.j AND n.c = 1 WHERE d1 / d2 < {RATIO}")
def mutual_nn_match(spark, d):
    a, b = sides(spark, d)
    label = table(spark, d, "embeddings").select("vec_id", "label")
    m = knn.mutual_nn(a, b, RATIO).join(label.select(F.col("vec_id").alias("i"), F.col("label").alias("la")), "i").join(label.select(F.col("vec_id").alias("j"), F.col("label").alias("lb")), "j")
    return m.select("i", "j", r6("d1").alias("d1"), r6(F.col("d1") / F.col("d2")).alias("ratio"), (F.col("la") == F.col("lb")).alias("same_label"))


@query(PAIRS + "SELECT i, r AS rank, j, round(d, 6) AS d FROM n WHERE r <= 2")
def knn_top2(spark, d):
    return knn.nearest(*sides(spark, d), 2).select("i", big("rank").alias("rank"), "j", r6("d").alias("d"))


@query(PAIRS + f"SELECT i, j, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM two WHERE d1 < {RATIO} * d2")
def ratio_test_lowe(spark, d):
    t = knn.top_two(knn.nearest(*sides(spark, d), 2)).where(knn.lowe(F.col("d1"), F.col("d2"), RATIO))
    return t.select("i", "j", r6("d1").alias("d1"), r6("d2").alias("d2"))


@query(PAIRS + f"SELECT i, j, round(d1, 6) AS d1, round(d2, 6) AS d2 FROM two WHERE d1 / (d2 + 1e-12) < {RATIO}")
def ratio_test_nndr_eps(spark, d):
    t = knn.top_two(knn.nearest(*sides(spark, d), 2)).where(knn.nndr(F.col("d1"), F.col("d2"), RATIO))
    return t.select("i", "j", r6("d1").alias("d1"), r6("d2").alias("d2"))


@query(PAIRS + "SELECT i, j, round(d, 6) AS d FROM n WHERE r = 1 AND c = 1")
def cross_check_match(spark, d):
    return knn.match(*sides(spark, d), "nn", cross_check=True).select("i", "j", r6("d").alias("d"))


@query("""WITH a AS (SELECT vec_id AS i, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS j, embedding::DOUBLE[] AS f FROM embeddings WHERE vec_id % 2 = 1),
n AS (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY round(s, 12) DESC, j) AS r FROM (SELECT i, j, list_inner_product(e, f) AS s FROM a, b)),
two AS (SELECT i, max(CASE WHEN r = 1 THEN s END) AS s1, max(CASE WHEN r = 2 THEN s END) AS s2 FROM n WHERE r <= 2 GROUP BY i)
SELECT i, round(sqrt(abs(2 - 2 * s2)) / sqrt(abs(2 - 2 * s1)), 5) AS score FROM two""")
def inverse_ratio_score(spark, d):
    a, b = sides(spark, d)
    near = knn.nearest(a, b, 2).join(a.select(F.col("idx").alias("i"), F.col("descriptor").alias("x")), "i").join(b.select(F.col("idx").alias("j"), F.col("descriptor").alias("y")), "j")
    dot = F.aggregate(F.zip_with("x", "y", lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    t = near.withColumn("s", dot).groupBy("i").agg(F.max(F.when(F.col("rank") == 1, F.col("s"))).alias("s1"), F.max(F.when(F.col("rank") == 2, F.col("s"))).alias("s2"))
    return knn.inverse_ratio(t).select("i", F.round("score", 5).alias("score"))


COPIES = """WITH a AS (SELECT vec_id AS i, round(embedding[1]::DOUBLE * 4) AS x1, round(embedding[2]::DOUBLE * 4) AS x2 FROM embeddings WHERE vec_id % 2 = 0),
b AS (SELECT vec_id AS j, round(embedding[1]::DOUBLE * 4) AS y1, round(embedding[2]::DOUBLE * 4) AS y2 FROM embeddings WHERE vec_id % 2 = 1),
n AS (SELECT i, j, s, row_number() OVER (PARTITION BY i ORDER BY s, j) AS r, row_number() OVER (PARTITION BY j ORDER BY s, i) AS c FROM (SELECT i, j, (x1 - y1) ** 2 + (x2 - y2) ** 2 AS s FROM a, b)) """


def copied_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Descriptors of few different values, far from the origin: most are copies of others."""
    coarse = lambda k: F.round(F.col("descriptor")[k].cast("double") * 4) + 1_000_000
    return tuple(s.select("pair_id", "idx", F.array(coarse(0), coarse(1)).alias("descriptor")) for s in sides(spark, d))


@query(COPIES + "SELECT i, r AS rank, j, s AS square FROM n WHERE r <= 5")
def knn_of_copies(spark, d):
    return knn.nearest(*copied_sides(spark, d), 5).select("i", big("rank").alias("rank"), "j", F.round(F.col("d") * F.col("d"), 6).alias("square"))


@query(COPIES + "SELECT i, j FROM n WHERE r = 1 AND c = 1")
def mutual_nn_of_copies(spark, d):
    return knn.mutual_nn(*copied_sides(spark, d), None).select("i", "j")


@query("SELECT true AS every_row, true AS recall_90")
def approximate_knn(spark, d):
    """Every query row has two neighbours, and nine of ten are those of nearest."""
    a, b = sides(spark, d)
    found, exact = knn.approximate(a, b, 2), knn.nearest(a, b, 2).select("pair_id", "i", "j", F.lit(True).alias("near"))
    t = found.join(exact, ["pair_id", "i", "j"], "left").agg(F.count("*").alias("n"), F.count("near").alias("hits"))
    n = a.count()
    return t.select((F.col("n") == 2 * n).alias("every_row"), (F.col("hits") >= 0.9 * 2 * n).alias("recall_90"))


BITS = """WITH c AS (SELECT vec_id, list_sum([CASE WHEN embedding[k] > 0 THEN 1::BIGINT << (k - 1) ELSE 0 END FOR k IN range(1, 64)])::BIGINT + CASE WHEN embedding[64] > 0 THEN -9223372036854775808 ELSE 0 END AS w FROM embeddings),
a AS (SELECT vec_id AS i, w AS x FROM c WHERE vec_id % 2 = 0), b AS (SELECT vec_id AS j, w AS y FROM c WHERE vec_id % 2 = 1) """


def codes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return tuple(s.select("pair_id", "idx", knn.sign_bits(F.col("descriptor")).alias("descriptor")) for s in sides(spark, d))


@query(BITS + "SELECT i, r AS rank, j, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM (SELECT i, j, bit_count(xor(x, y))::BIGINT AS d FROM a, b)) WHERE r <= 2")
def hamming_knn(spark, d):
    return knn.hamming(*codes(spark, d)).select("i", big("rank").alias("rank"), "j", big("d").alias("d"))


@query(BITS + "SELECT i, j, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r, row_number() OVER (PARTITION BY j ORDER BY d, i) AS c FROM (SELECT i, j, bit_count(xor(x, y))::BIGINT AS d FROM a, b)) WHERE r = 1 AND c = 1")
def hamming_cross_check(spark, d):
    return knn.match(*codes(spark, d), "binary", cross_check=True).select("i", "j", big("d").alias("d"))


@query(BITS + ", t AS (SELECT unnest(range(6)) AS t), k AS (SELECT vec_id, t, list_sum([((w >> ((t * 11 + b * 5) % 64)) & 1) << b FOR b IN range(12)])::BIGINT AS v FROM c, t), m AS (SELECT DISTINCT p.vec_id AS i, q.vec_id AS j FROM k p JOIN k q ON p.t = q.t AND p.v = q.v WHERE p.vec_id % 2 = 0 AND q.vec_id % 2 = 1) SELECT i, r AS rank, j, d FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS r FROM (SELECT m.i, m.j, bit_count(xor(x, y))::BIGINT AS d FROM m JOIN a USING (i) JOIN b USING (j))) WHERE r <= 2")
def hamming_lsh_knn(spark, d):
    return knn.hamming_lsh(*codes(spark, d)).select("i", big("rank").alias("rank"), "j", big("d").alias("d"))


# keypoints

POINTS = "WITH p AS (SELECT vec_id AS kp_idx, (vec_id % 2)::BIGINT AS image_id, ((vec_id * 37) % 640)::DOUBLE AS x, ((vec_id * 91) % 480)::DOUBLE AS y, abs(embedding[3])::DOUBLE AS score, label FROM embeddings) "


def points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id AS kp_idx", "vec_id % 2 AS image_id", "CAST((vec_id * 37) % 640 AS DOUBLE) AS x", "CAST((vec_id * 91) % 480 AS DOUBLE) AS y", "CAST(abs(embedding[2]) AS DOUBLE) AS score", "label")


@query(POINTS + "SELECT image_id, kp_idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, kp_idx) AS rank FROM p) WHERE rank <= 100")
def topk_keypoints(spark, d):
    return keypoints.top_k(points(spark, d), 100).select("image_id", "kp_idx", big("rank").alias("rank"))


@query(POINTS + "SELECT image_id, kp_idx FROM p WHERE score > 0.1")
def score_threshold(spark, d):
    return keypoints.above(points(spark, d), 0.1).select("image_id", "kp_idx")


@query(POINTS + "SELECT image_id, kp_idx FROM p WHERE x >= 4 AND x < 640 - 4 AND y >= 4 AND y < 480 - 4")
def remove_borders(spark, d):
    return keypoints.remove_borders(points(spark, d), 4, F.lit(640), F.lit(480)).select("image_id", "kp_idx")


@query(POINTS + "SELECT kp_idx, round((x - 320) / (640 * 0.7), 6) AS nx, round((y - 240) / (640 * 0.7), 6) AS ny FROM p")
def normalize_keypoints_maxdim(spark, d):
    w, h = F.lit(640), F.lit(480)
    return points(spark, d).select("kp_idx", r6(keypoints.normalize_max_dim(F.col("x"), w, w, h)).alias("nx"), r6(keypoints.normalize_max_dim(F.col("y"), h, w, h)).alias("ny"))


@query(POINTS + "SELECT kp_idx, round((x - 320 + 0.5) / 640, 6) AS nx, round((y - 240 + 0.5) / 640, 6) AS ny FROM p")
def normalize_size(spark, d):
    w, h = F.lit(640), F.lit(480)
    return points(spark, d).select("kp_idx", r6(keypoints.normalize_size(F.col("x"), w, w, h)).alias("nx"), r6(keypoints.normalize_size(F.col("y"), h, w, h)).alias("ny"))


@query(POINTS + "SELECT kp_idx, round((x - 320) / 500, 6) AS nx, round((y - 240) / 510, 6) AS ny FROM p")
def normalize_intrinsics(spark, d):
    return points(spark, d).select("kp_idx", r6(keypoints.normalize_intrinsics(F.col("x"), F.lit(320), F.lit(500))).alias("nx"), r6(keypoints.normalize_intrinsics(F.col("y"), F.lit(240), F.lit(510))).alias("ny"))


@query("SELECT vec_id, round(list_sum([sqrt(abs(v / (s + 1e-8))) FOR v IN e]), 6) AS total, round(sqrt(abs(e[1] / (s + 1e-8))), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e, list_sum([abs(v) FOR v IN embedding::DOUBLE[]]) AS s FROM embeddings)")
def root_normalize(spark, d):
    t = table(spark, d, "embeddings").select("vec_id", keypoints.root_normalize(F.col("embedding").cast("array<double>")).alias("e"))
    return t.select("vec_id", r6(F.aggregate("e", F.lit(0.0), lambda a, v: a + v)).alias("total"), r6(F.col("e")[0]).alias("first"))


@query("SELECT vec_id, round(e[1] / greatest(sqrt(list_sum([v * v FOR v IN e])), 1e-12), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def l2_normalize(spark, d):
    return table(spark, d, "embeddings").select("vec_id", r6(keypoints.l2_normalize(F.col("embedding").cast("array<double>"))[0]).alias("first"))


@query("""SELECT p_partkey, trunc(w * s)::BIGINT AS keep_w, trunc(h * s)::BIGINT AS keep_h, round_even(w * (832.0::DOUBLE / greatest(w, h)), 0)::BIGINT AS long_w, round_even(h * (832.0::DOUBLE / greatest(w, h)), 0)::BIGINT AS long_h, (floor(w / 8.0) * 8)::BIGINT AS even_w
FROM (SELECT p_partkey, w, h, least(640.0::DOUBLE / w, 480.0::DOUBLE / h) AS s FROM (SELECT p_partkey, (p_size * 31 + 17)::DOUBLE AS w, (p_size * 23 + 40)::DOUBLE AS h FROM part))""")
def resize_rules(spark, d):
    t = table(spark, d, "part").selectExpr("p_partkey", "CAST(p_size * 31 + 17 AS DOUBLE) AS w", "CAST(p_size * 23 + 40 AS DOUBLE) AS h")
    w, h = F.col("w"), F.col("h")
    keep, long_ = keypoints.resize_keep_aspect(w, h, 640, 480), keypoints.process_resize(w, h, [832])
    return t.select("p_partkey", big(keep[0]).alias("keep_w"), big(keep[1]).alias("keep_h"), big(long_[0]).alias("long_w"), big(long_[1]).alias("long_h"), big(keypoints.floor_to_multiple(w, 8)).alias("even_w"))


NMS_STEP = """, h{n} AS (SELECT near.a AS kp_idx, bool_or(q.kept) AS hit FROM near JOIN k{m} q ON q.kp_idx = near.b GROUP BY near.a),
c{n} AS (SELECT p.image_id, p.kp_idx, p.score, k.kept, k.kept OR coalesce(h.hit, false) AS covered FROM p JOIN k{m} k ON k.kp_idx = p.kp_idx LEFT JOIN h{n} h ON h.kp_idx = p.kp_idx),
o{n} AS (SELECT near.a AS kp_idx, max(CASE WHEN o.covered THEN 0 ELSE o.score END) AS most FROM near JOIN c{n} o ON o.kp_idx = near.b GROUP BY near.a),
k{n} AS (SELECT c.image_id, c.kp_idx, c.kept OR (NOT c.covered AND c.score >= coalesce(o.most, 0)) AS kept FROM c{n} c LEFT JOIN o{n} o ON o.kp_idx = c.kp_idx)"""


@query(POINTS + """, near AS (SELECT p.kp_idx AS a, q.kp_idx AS b, q.score AS sb FROM p JOIN p q ON p.image_id = q.image_id AND p.kp_idx <> q.kp_idx AND abs(p.x - q.x) <= 20 AND abs(p.y - q.y) <= 20),
k0 AS (SELECT image_id, kp_idx, score >= coalesce(max(sb), 0) AS kept FROM p LEFT JOIN near ON a = kp_idx GROUP BY image_id, kp_idx, score)""" + NMS_STEP.format(n=1, m=0) + NMS_STEP.format(n=2, m=1) + " SELECT image_id, kp_idx FROM k2 WHERE kept")
def nms_grid(spark, d):
    return keypoints.nms(points(spark, d), 20).select("image_id", "kp_idx")


@query(PAIRS + """, m AS (SELECT t.i, t.j, ((t.i * 37) % 640)::DOUBLE AS x1, ((t.i * 91) % 480)::DOUBLE AS y1, ((t.j * 37) % 640)::DOUBLE AS x2, ((t.j * 91) % 480)::DOUBLE AS y2, CASE WHEN n.c = 1 THEN round(d2 / d1, 9) ELSE -1 END AS s FROM two t JOIN n ON n.i = t.i AND n.j = t.j),
d AS (SELECT a.i, a.s AS sa, b.s AS sb, sqrt((a.x1 - b.x1) ** 2 + (a.y1 - b.y1) ** 2) AS d1, sqrt((a.x2 - b.x2) ** 2 + (a.y2 - b.y2) ** 2) AS d2 FROM m a, m b),
r AS (SELECT 0.1 * avg(d1) AS r1, 0.1 * avg(d2) AS r2 FROM d), weak AS (SELECT DISTINCT i FROM d, r WHERE sa < sb AND NOT (d1 >= r1 AND d2 >= r2)),
k AS (SELECT i, j, CASE WHEN s < 1.001 OR i IN (SELECT i FROM weak) THEN -1 ELSE s END AS s FROM m)
SELECT rank, i, j, round(s, 6) AS score FROM (SELECT i, j, s, row_number() OVER (ORDER BY s DESC, i) AS rank, (count(*) FILTER (s > 0) OVER ()) AS alive FROM k) WHERE rank <= least(alive + 2, 64)""")
def seed_select(spark, d):
    a, b = sides(spark, d)
    two = knn.top_two(knn.nearest(a, b, 2))
    back = knn.nearest(b, a, 1).select("pair_id", F.col("i").alias("j"), F.col("j").alias("i"), F.lit(True).alias("back"))
    m = two.join(back, ["pair_id", "i", "j"], "left")
    at = lambda v, k, n: F.expr(f"CAST(({v} * {k}) % {n} AS DOUBLE)")
    m = m.select("pair_id", "i", "j", at("i", 37, 640).alias("x1"), at("i", 91, 480).alias("y1"), at("j", 37, 640).alias("x2"), at("j", 91, 480).alias("y2"), F.round(F.col("d2") / F.col("d1"), 9).alias("score"), F.coalesce("back", F.lit(False)).alias("mutual"))
    return keypoints.seeds(m, 64, 1.001, 0.1).select(big("rank").alias("rank"), "i", "j", r6("score").alias("score"))


@query(POINTS + "SELECT kp_idx, round(sin((x + 1) * exp(0)), 6) AS sx0, round(cos((x + 1) * exp(0)), 6) AS cx0, round(sin((y + 1) * exp(2 * -ln(10000.0::DOUBLE) / 4)), 6) AS sy1, round(cos((y + 1) * exp(2 * -ln(10000.0::DOUBLE) / 4)), 6) AS cy1 FROM p")
def position_encoding(spark, d):
    t = points(spark, d).select("kp_idx", keypoints.position_encoding(F.col("x"), F.col("y"), 8).alias("e"))
    return t.select("kp_idx", *[r6(F.col("e")[k]).alias(n) for k, n in ((0, "sx0"), (1, "cx0"), (6, "sy1"), (7, "cy1"))])


@query("SELECT vec_id, ((vec_id % 80) * 8)::BIGINT AS x, (floor(vec_id / 80.0) * 8)::BIGINT AS y FROM embeddings")
def cell_to_pixel(spark, d):
    x, y = keypoints.cell_to_pixel(F.col("vec_id"), 80, 8)
    return table(spark, d, "embeddings").select("vec_id", big(x).alias("x"), big(y).alias("y"))


@query("WITH g AS (SELECT n_nationkey AS image_id, unnest(range(4)) AS y FROM nation), h AS (SELECT image_id, y, unnest(range(4)) AS x FROM g) SELECT image_id::BIGINT AS image_id, y::BIGINT AS y, x::BIGINT AS x, CASE WHEN x < 3 AND y < 2 THEN (image_id + y * 10 + x)::DOUBLE ELSE 0 END AS value, x < 3 AND y < 2 AS valid FROM h")
def pad_bottom_right(spark, d):
    n = table(spark, d, "nation").select(big("n_nationkey").alias("image_id"))
    cells = n.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("y")).select("image_id", "y", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("x")).withColumn("value", (F.col("image_id") + F.col("y") * 10 + F.col("x")).cast("double"))
    return keypoints.pad_grid(cells, n.withColumn("pad", F.lit(4))).select("image_id", big("y").alias("y"), big("x").alias("x"), "value", "valid")


@query("SELECT p_partkey, round(CASE WHEN n < 300 THEN 1 - n / 300.0 * 0.2 WHEN n < 1000 THEN 0.8 - (n - 300) / 700.0 * 0.4 WHEN n < 2000 THEN 0.4 - (n - 1000) / 1000.0 * 0.2 ELSE 0.2 END::DOUBLE, 6) AS alpha, round(least(greatest(2 - (1 - least(n / 2000.0, 1.0)) * 2, 0.0), 1.0)::DOUBLE, 6) AS red FROM (SELECT p_partkey, (p_size * 47)::DOUBLE AS n FROM part)")
def drawing_values(spark, d):
    n = F.col("n")
    t = table(spark, d, "part").selectExpr("p_partkey", "CAST(p_size * 47 AS DOUBLE) AS n")
    return t.select("p_partkey", r6(keypoints.dynamic_alpha(n)).alias("alpha"), r6(keypoints.error_color(n, 1000.0)[0]).alias("red"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS p FROM events) WHERE p % 7 = 0 AND p < 7 * 100")
def skip_sample(spark, d):
    return frames.skipped(table(spark, d, "events").withColumn("position", F.col("event_id") - table(spark, d, "events").agg(F.min("event_id")).first()[0]), 7, 100).select("event_id")


@query("""WITH p AS (SELECT vec_id AS kp_idx, ((vec_id * 37) % 320)::DOUBLE + 4 AS x, ((vec_id * 91) % 240)::DOUBLE + 4 AS y FROM embeddings), u AS (SELECT kp_idx, (x - 3.5) / 8 AS u, (y - 3.5) / 8 AS v FROM p),
o AS (SELECT unnest([0, 0, 1, 1]) AS i, unnest([0, 1, 0, 1]) AS j), c AS (SELECT kp_idx, u, v, floor(u) + i AS gx, floor(v) + j AS gy FROM u, o WHERE floor(u) + i BETWEEN 0 AND 47 AND floor(v) + j BETWEEN 0 AND 35),
s AS (SELECT kp_idx, sum((1 - abs(u - gx)) * (1 - abs(v - gy)) * (gx + 1)) AS a, sum((1 - abs(u - gx)) * (1 - abs(v - gy)) * (gy + 2)) AS b FROM c GROUP BY kp_idx)
SELECT kp_idx, round(a / sqrt(a * a + b * b), 6) AS a, round(b / sqrt(a * a + b * b), 6) AS b FROM s""")
def sample_descriptors(spark, d):
    p = table(spark, d, "embeddings").selectExpr("CAST(0 AS BIGINT) AS image_id", "vec_id AS kp_idx", "CAST((vec_id * 37) % 320 AS DOUBLE) + 4 AS x", "CAST((vec_id * 91) % 240 AS DOUBLE) + 4 AS y")
    grid = spark.range(48).select(F.col("id").alias("gx"), F.explode(F.expr("sequence(0L, 35L)")).alias("gy")).selectExpr("CAST(0 AS BIGINT) AS image_id", "gx", "gy", "array(CAST(gx + 1 AS DOUBLE), CAST(gy + 2 AS DOUBLE)) AS descriptor")
    return keypoints.sample_descriptors(p, grid).select("kp_idx", r6(F.col("descriptor")[0]).alias("a"), r6(F.col("descriptor")[1]).alias("b"))


# assignment: the sets of each label are a pair

SCORES = """WITH s AS (SELECT a.label::BIGINT AS pair_id, a.vec_id AS i, b.vec_id AS j, 10 * list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1) """


def sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The sets of each label, as a pair; a score is ten times the product of two descriptors."""
    return tuple(t.withColumn("pair_id", big("pair_id")) for t in sides(spark, d, by_label=True))


SCALE = 10.0


DUAL = ", p AS (SELECT pair_id, i, j, exp(s) / sum(exp(s)) OVER (PARTITION BY pair_id, i) * exp(s) / sum(exp(s)) OVER (PARTITION BY pair_id, j) AS p FROM s) "


@query(SCORES + DUAL + "SELECT pair_id, i, min(j) AS j, round(max(p), 6) AS p FROM (SELECT *, max(p) OVER (PARTITION BY pair_id, i) AS r, max(p) OVER (PARTITION BY pair_id, j) AS c FROM p) WHERE p > 0.01 AND abs(p - r) < 1e-15 AND abs(p - c) < 1e-15 GROUP BY pair_id, i")
def dual_softmax_match(spark, d):
    return assign.mutual_max(descriptors.dual_softmax(*sets(spark, d), SCALE, 0.01), 0.01).select("pair_id", "i", "j", r6("p").alias("p"))


@query(SCORES + DUAL + "SELECT pair_id, i, min(j) AS j, round(max(p), 6) AS p FROM (SELECT *, max(p) OVER (PARTITION BY pair_id, i) AS r, max(p) OVER (PARTITION BY pair_id, j) AS c FROM p) WHERE p > 0.001 AND abs(p - r) < 1e-15 AND abs(p - c) < 1e-15 AND i % 40 BETWEEN 2 AND 37 AND floor(i / 40.0) BETWEEN 2 AND 47 AND j % 40 BETWEEN 2 AND 37 AND floor(j / 40.0) BETWEEN 2 AND 47 GROUP BY pair_id, i")
def coarse_match_border(spark, d):
    inside = assign.inside_border(F.col("i"), 2, 40, 50) & assign.inside_border(F.col("j"), 2, 40, 50)
    return assign.mutual_max(descriptors.dual_softmax(*sets(spark, d), SCALE, 0.001), 0.001, inside).select("pair_id", "i", "j", r6("p").alias("p"))


@query(SCORES + DUAL + "SELECT pair_id, i, j, round(p, 6) AS p FROM (SELECT *, row_number() OVER (PARTITION BY pair_id, i ORDER BY p DESC, j) AS r, row_number() OVER (PARTITION BY pair_id, j ORDER BY p DESC, i) AS c FROM p) WHERE r = 1 AND c = 1 AND p > 0.02")
def probability_match(spark, d):
    return assign.argmax_mutual(descriptors.dual_softmax(*sets(spark, d), SCALE, 0.02), 0.02).select("pair_id", "i", "j", r6("p").alias("p"))


BIN = -2.0
BINS = ", m AS (SELECT pair_id, count(DISTINCT i) AS m, count(DISTINCT j) AS n FROM s GROUP BY pair_id), z AS (SELECT * FROM s UNION ALL SELECT DISTINCT pair_id, i, -1, -2.0 FROM s UNION ALL SELECT DISTINCT pair_id, -1, j, -2.0 FROM s UNION ALL SELECT DISTINCT pair_id, -1, -1, -2.0 FROM s) "


def _sinkhorn_sql(iterations: int) -> str:
    out = BINS + ", t0 AS (SELECT z.pair_id, i, j, exp(s) / sum(exp(s)) OVER (PARTITION BY z.pair_id, i) AS p, (CASE WHEN i < 0 THEN m + 1 ELSE 1 END)::DOUBLE AS r, (CASE WHEN j < 0 THEN n + 1 ELSE 1 END)::DOUBLE AS c, 1.0::DOUBLE AS u, 1.0::DOUBLE AS v FROM z JOIN m USING (pair_id))"
    for k in range(iterations):
        out += f", u{k} AS (SELECT * EXCLUDE (u), r / (sum(p * v) OVER (PARTITION BY pair_id, i) + 1e-8) AS u FROM t{k}), t{k + 1} AS (SELECT * EXCLUDE (v), c / (sum(p * u) OVER (PARTITION BY pair_id, j) + 1e-8) AS v FROM u{k})"
    return out + f" SELECT pair_id, i, j, round(p * u * v, 6) AS p FROM t{iterations}"


@query(SCORES + _sinkhorn_sql(3))
def sinkhorn_3iter(spark, d):
    return descriptors.sinkhorn(*sets(spark, d), SCALE, BIN, 3, digits=6).select("pair_id", "i", "j", "p")


def _transport_sql(iterations: int) -> str:
    out = BINS + ", t0 AS (SELECT z.pair_id, i, j, s, -ln(m + n) AS norm, ln(CASE WHEN i < 0 THEN n ELSE 1 END) - ln(m + n) AS mu, ln(CASE WHEN j < 0 THEN m ELSE 1 END) - ln(m + n) AS nu, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v FROM z JOIN m USING (pair_id))"
    for k in range(iterations):
        out += f", u{k} AS (SELECT * EXCLUDE (u), mu - ln(sum(exp(s + v)) OVER (PARTITION BY pair_id, i)) AS u FROM t{k}), t{k + 1} AS (SELECT * EXCLUDE (v), nu - ln(sum(exp(s + u)) OVER (PARTITION BY pair_id, j)) AS v FROM u{k})"
    return out + f", l AS (SELECT pair_id, i, j, s + u + v - norm AS s FROM t{iterations})"


@query(SCORES + _transport_sql(3) + " SELECT pair_id, i, j, round(s, 6) AS s FROM l")
def log_optimal_transport(spark, d):
    return descriptors.Transport(*sets(spark, d), SCALE, BIN, 3).cells(digits=6).select("pair_id", "i", "j", "s")


@query(SCORES + _transport_sql(3) + ", f AS (SELECT *, row_number() OVER (PARTITION BY pair_id, i ORDER BY round(s, 12) DESC, j) AS r, row_number() OVER (PARTITION BY pair_id, j ORDER BY round(s, 12) DESC, i) AS c FROM l WHERE i >= 0 AND j >= 0), g AS (SELECT pair_id, i, j, exp(s) AS p FROM f WHERE r = 1 AND c = 1 AND exp(s) > 0.05) SELECT q.pair_id, q.i, coalesce(g.j, -1) AS match, round(coalesce(p, 0), 6) AS score FROM (SELECT DISTINCT pair_id, i FROM s) q LEFT JOIN g USING (pair_id, i)")
def assignment_readout(spark, d):
    left, right = sets(spark, d)
    rows = left.join(right.select("pair_id").distinct(), "pair_id", "left_semi").select("pair_id", F.col("idx").alias("i"))
    found = assign.argmax_mutual(descriptors.Transport(left, right, SCALE, BIN, 3).cells(0.05), 0.05)
    return assign.matched_points(found, rows).select("pair_id", "i", big("match").alias("match"), r6("score").alias("score"))


@query(SCORES + _transport_sql(3) + ", f AS (SELECT *, max(s) FILTER (j >= 0) OVER (PARTITION BY pair_id, i) AS rb, max(s) FILTER (i >= 0) OVER (PARTITION BY pair_id, j) AS cb, max(s) FILTER (j < 0) OVER (PARTITION BY pair_id, i) AS rd, max(s) FILTER (i < 0) OVER (PARTITION BY pair_id, j) AS cd FROM l) SELECT pair_id, i, j FROM f WHERE i >= 0 AND j >= 0 AND rb >= rd AND cb >= cd")
def dustbin_prefilter(spark, d):
    return descriptors.Transport(*sets(spark, d), SCALE, BIN, 3).without_dustbin_winners().select("pair_id", "i", "j")


@query("SELECT sum(least((p_size + 3) * 5, (p_size * 2 + 1) * 4))::BIGINT AS candidates FROM part")
def max_candidates(spark, d):
    return assign.most_candidates(table(spark, d, "part").selectExpr("p_size + 3 AS h0", "5 AS w0", "p_size * 2 + 1 AS h1", "4 AS w1")).select(big("candidates").alias("candidates"))


@query("""WITH h AS (SELECT vec_id AS match_id, unnest(range(25)) AS r, unnest(embedding[1:25])::DOUBLE * 8 AS s FROM embeddings), p AS (SELECT match_id, 2.0 * (r % 5) / 4 - 1 AS x, 2.0 * floor(r / 5.0) / 4 - 1 AS y, exp(s) / sum(exp(s)) OVER (PARTITION BY match_id) AS p FROM h),
e AS (SELECT match_id, sum(p * x) AS ex, sum(p * y) AS ey, sum(p * x * x) AS xx, sum(p * y * y) AS yy FROM p GROUP BY match_id) SELECT match_id, round(ex, 6) AS ex, round(ey, 6) AS ey, round(sqrt(greatest(xx - ex * ex, 1e-10)) + sqrt(greatest(yy - ey * ey, 1e-10)), 6) AS std, round(ex * 4, 6) AS dx FROM e""")
def fine_match(spark, d):
    h = table(spark, d, "embeddings").select(F.col("vec_id").alias("match_id"), F.posexplode(F.slice("embedding", 1, 25)).alias("r", "s")).withColumn("s", F.col("s").cast("double") * 8)
    return assign.fine_match(h, 5, 2.0).select("match_id", r6("ex").alias("ex"), r6("ey").alias("ey"), r6("std").alias("std"), r6("dx").alias("dx"))


# metrics: values of events are errors, users are pairs

AUC = """WITH e AS (SELECT value AS e, row_number() OVER (ORDER BY value) AS k, count(*) OVER () AS n FROM events), f AS (SELECT 0.0::DOUBLE AS e, 0::BIGINT AS k, 1::BIGINT AS n UNION ALL SELECT * FROM e), g AS (SELECT e, k / n::DOUBLE AS r, lag(e) OVER (ORDER BY k) AS e0, lag(k / n::DOUBLE) OVER (ORDER BY k) AS r0 FROM f),
t AS (SELECT unnest([5.0, 10.0, 20.0])::DOUBLE AS t) SELECT t AS threshold, round((sum((r + r0) / 2 * (e - e0)) + max(r) * (t - max(e))) / t, 6) AS auc FROM g, t WHERE e < t GROUP BY t"""


@query(AUC)
def pose_auc_exact(spark, d):
    return metrics.pose_auc(table(spark, d, "events"), [5, 10, 20], "value").select("threshold", r6("auc").alias("auc"))


@query("WITH b AS (SELECT unnest(range(6)) AS b), c AS (SELECT b, (SELECT count(*) FROM events WHERE value >= b * 5 AND (value < (b + 1) * 5 OR (b = 5 AND value = 30))) / (SELECT count(*) FROM events)::DOUBLE AS s FROM b), d AS (SELECT b, sum(s) OVER (ORDER BY b) AS q FROM c) SELECT ((b + 1) * 5)::DOUBLE AS upto, round(avg(q) OVER (ORDER BY b), 6) AS auc FROM d")
def pose_auc_approx(spark, d):
    return metrics.approximate_auc(table(spark, d, "events"), [0, 5, 10, 15, 20, 25, 30], "value").select("upto", r6("auc").alias("auc"))


@query("SELECT c.t AS threshold, round(avg(coalesce(p, 0)), 6) AS precision FROM (SELECT c_custkey, t FROM customer, (SELECT unnest([5.0, 20.0])::DOUBLE AS t)) c LEFT JOIN (SELECT user_id, s.t, avg(CASE WHEN value < s.t THEN 1.0 ELSE 0 END) AS p FROM events, (SELECT unnest([5.0, 20.0])::DOUBLE AS t) s GROUP BY ALL) e ON e.user_id = c_custkey AND e.t = c.t GROUP BY c.t")
def macro_precision(spark, d):
    users = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return metrics.macro_precision(users, table(spark, d, "events"), [5, 20], "user_id", "value").select("threshold", r6("precision").alias("precision"))


@query("SELECT user_id, event_type, value, event_id, first_seen FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS first_seen, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def dedupe_keep_last(spark, d):
    t = table(spark, d, "events").select("user_id", "event_type", "value", "event_id").withColumn("position", F.col("event_id"))
    return metrics.keep_last(t, ["user_id", "event_type"], "position").select("user_id", "event_type", "value", "event_id", "first_seen")


@query("""WITH l AS (SELECT user_id, max(value) FILTER (r = 1) AS v FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) GROUP BY user_id), x AS (SELECT user_id, greatest(v, v / 2 + 3) AS e, v FROM l),
k AS (SELECT e, row_number() OVER (ORDER BY e) AS k, count(*) OVER () AS n FROM x), f AS (SELECT 0.0::DOUBLE AS e, 0::BIGINT AS k, 1::BIGINT AS n UNION ALL SELECT * FROM k), g AS (SELECT e, k / n::DOUBLE AS r, lag(e) OVER (ORDER BY k) AS e0, lag(k / n::DOUBLE) OVER (ORDER BY k) AS r0 FROM f), t AS (SELECT unnest([5, 10, 20]) AS t)
SELECT 'auc@' || t AS metric, round((coalesce(sum((r + r0) / 2 * (e - e0)), 0) + max(r) * (t - max(e))) / t, 6) AS value FROM g, t WHERE e < t GROUP BY t UNION ALL SELECT 'precision', round(avg(CASE WHEN v < 10 THEN 1.0 WHEN v / 3 < 10 THEN 0.5 ELSE 0 END), 6) FROM x""")
def aggregate_metrics(spark, d):
    t = table(spark, d, "events").select(F.col("user_id").alias("identifier"), F.col("event_id").alias("position"), F.col("value").alias("r_err"), (F.col("value") / 2 + 3).alias("t_err"), F.array("value", F.col("value") / 3).alias("epi_errs"))
    return metrics.aggregate_metrics(t, 10.0).select("metric", r6("value").alias("value"))


VERIFY = """WITH v AS (SELECT a.label * 10 + b.label AS pair_id, a.label = b.label AS truth, ((a.vec_id + b.vec_id) % 7) / 7.0 AS q, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
g AS (SELECT pair_id::BIGINT AS pair_id, bool_or(truth) AS truth, avg(q)::DOUBLE AS ratio, avg(d) * 4 AS error FROM v GROUP BY pair_id) """


def verified(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("label").alias("lb"), F.col("embedding").alias("f"))
    dist = F.sqrt(F.aggregate(F.zip_with("embedding", "f", lambda u, v: (u.cast("double") - v.cast("double")) ** 2), F.lit(0.0), lambda acc, v: acc + v))
    t = e.join(b, "vec_id").select((F.col("label") * 10 + F.col("lb")).alias("pair_id"), (F.col("label") == F.col("lb")).alias("truth"), (F.expr("(2 * vec_id + 1) % 7") / 7.0).alias("q"), dist.alias("d"))
    return t.groupBy(big("pair_id").alias("pair_id")).agg(F.bool_or("truth").alias("truth"), F.avg("q").alias("ratio"), (F.avg("d") * 4).alias("error"))


@query(VERIFY + "SELECT pair_id, ratio >= 0.45 AS classical, ratio > 0.3 AS learned_detector, ratio > 0.2 AND error < 5 AS dense, ratio > 0.2 AND error < 5 AS sparse_graph, ratio > 0.4 AND error < 5 AS seeded_graph, ratio > 0.4 AND error < 5 AS coarse_to_fine FROM g")
def verify_decisions(spark, d):
    r, e = F.col("ratio"), F.col("error")
    return verified(spark, d).select("pair_id", *[metrics.decide(r, e, *c).alias(n) for n, c in metrics.DECISIONS.items()])


@query(VERIFY + "SELECT count(*) FILTER (p AND truth) AS tp, count(*) FILTER (p AND NOT truth) AS fp, count(*) FILTER (NOT p AND truth) AS fn, count(*) FILTER (NOT p AND NOT truth) AS tn FROM (SELECT *, ratio > 0.4 AND error < 5.7 AS p FROM g)")
def confusion_by_pair(spark, d):
    t = verified(spark, d).withColumn("predicted", metrics.decide(F.col("ratio"), F.col("error"), 0.4, 5.7))
    return metrics.confusion(t).select("tp", "fp", "fn", "tn")


@query("SELECT conv_id AS sequence, (first + unnest(range(n)))::BIGINT AS pair_index, first::BIGINT AS offset_ FROM (SELECT conv_id, n, coalesce(sum(n) OVER (ORDER BY conv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id))")
def pair_seq_expand(spark, d):
    t = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("sequence"), F.col("conv_id").alias("position"), "n")
    return metrics.expand_sequences(t).select("sequence", big("pair_index").alias("pair_index"), big("offset").alias("offset_"))


@query("SELECT floor(event_id / 1000.0)::BIGINT AS slice, round(avg(CASE WHEN value < 10 THEN 1.0 ELSE 0 END), 6) AS f_recall, round(avg(value), 6) AS precision_pre, round(avg(user_id), 6) AS corr_pre FROM events GROUP BY 1")
def fm_sequence_slices(spark, d):
    t = table(spark, d, "events").select(F.col("event_id").alias("index"), F.col("value").alias("sgd"), F.col("value").alias("rate_pre"), F.col("value").alias("rate_post"), F.col("user_id").alias("n_pre"), F.col("user_id").alias("n_post"))
    return metrics.sequence_slices(t, 1000, 10).select(big("slice").alias("slice"), *[r6(c).alias(c) for c in ("f_recall", "precision_pre", "corr_pre")])


@query("SELECT r_regionkey::BIGINT AS r_regionkey, CASE r_regionkey % 3 WHEN 0 THEN 5e-4 ELSE 1e-4 END::DOUBLE AS threshold FROM region")
def dataset_threshold(spark, d):
    name = F.element_at(F.array(F.lit("ScanNet"), F.lit("MegaDepth"), F.lit("GL3D")), (F.col("r_regionkey") % 3 + 1).cast("int"))
    return table(spark, d, "region").select(big("r_regionkey").alias("r_regionkey"), metrics.dataset_threshold(name).alias("threshold"))


@query("SELECT u.c_custkey AS user_id, round(coalesce(hits / n::DOUBLE, 0), 6) AS precision, round(coalesce(hits / nullif(n_true, 0)::DOUBLE, 0), 6) AS recall FROM (SELECT c_custkey, (c_custkey % 5) * 10 AS n_true FROM customer) u LEFT JOIN (SELECT user_id, count(*) AS n, count(*) FILTER (value < 10) AS hits FROM events GROUP BY user_id) e ON e.user_id = u.c_custkey")
def precision_recall(spark, d):
    truth = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), ((F.col("c_custkey") % 5) * 10).alias("n_true"))
    hits = table(spark, d, "events").select("user_id", (F.col("value") < 10).alias("correct"))
    return metrics.precision_recall(hits, truth, "user_id").select("user_id", r6("precision").alias("precision"), r6("recall").alias("recall"))


@query("SELECT round(avg(coalesce(i / nullif(m, 0), 0)), 6) AS precision, round(avg(coalesce(i / nullif(k, 0), 0)), 6) AS match_score FROM (SELECT (count(*) FILTER (value < 5))::DOUBLE AS i, (count(*) FILTER (value < 20))::DOUBLE AS m, count(*)::DOUBLE AS k FROM events GROUP BY user_id)")
def match_score(spark, d):
    t = table(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("value") < 5).alias("inliers"), F.count_if(F.col("value") < 20).alias("matches"), F.count("*").alias("keypoints"))
    return metrics.match_score(t).select(r6("precision").alias("precision"), r6("match_score").alias("match_score"))


# geometry: p and q are two points of each id

GEO = """WITH p AS (SELECT vec_id AS id, ((vec_id * 37) % 640)::DOUBLE AS x, ((vec_id * 91) % 480)::DOUBLE AS y, ((vec_id * 53) % 640)::DOUBLE AS u, ((vec_id * 29) % 480)::DOUBLE AS v FROM embeddings) """
H = (0.9, 0.1, 30.0, -0.05, 1.1, -20.0, 1e-4, -5e-5, 1.0)
K = (500.0, 0.0, 320.0, 0.0, 510.0, 240.0, 0.0, 0.0, 1.0)
E = (0.01, -0.3, 0.2, 0.35, 0.02, -0.9, -0.25, 0.95, 0.03)


def geo_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id AS id", "CAST((vec_id * 37) % 640 AS DOUBLE) AS x", "CAST((vec_id * 91) % 480 AS DOUBLE) AS y", "CAST((vec_id * 53) % 640 AS DOUBLE) AS u", "CAST((vec_id * 29) % 480 AS DOUBLE) AS v")


def pq() -> tuple[geo.Point, geo.Point]:
    return (F.col("x"), F.col("y")), (F.col("u"), F.col("v"))


PROJECTED = GEO + ", h AS (SELECT *, 0.9 * x + 0.1 * y + 30 AS a, -0.05 * x + 1.1 * y - 20 AS b, 1e-4 * x - 5e-5 * y + 1 AS w FROM p) "


@query(PROJECTED + "SELECT id, round(a / w, 6) AS hx, round(b / w, 6) AS hy FROM h")
def perspective_transform(spark, d):
    x, y = geo.perspective(geo.matrix(H), pq()[0])
    return geo_points(spark, d).select("id", r6(x).alias("hx"), r6(y).alias("hy"))


@query(PROJECTED + "SELECT id % 10 AS pair_id, round(avg(sqrt((a / w - u) ** 2 + (b / w - v) ** 2)), 6) AS error FROM h GROUP BY 1")
def reprojection_error(spark, d):
    t = geo_points(spark, d).withColumn("e", geo.reprojection_error(geo.matrix(H), *pq()))
    return t.groupBy(F.expr("id % 10").alias("pair_id")).agg(r6(F.avg("e")).alias("error"))


EPI = GEO + f""", n AS (SELECT id, x, y, u, v, (x - 320) / 500 AS nx, (y - 240) / 510 AS ny, (u - 320) / 500 AS nu, (v - 240) / 510 AS nv FROM p),
l AS (SELECT *, {E[0]} * nx + {E[1]} * ny + {E[2]} AS a, {E[3]} * nx + {E[4]} * ny + {E[5]} AS b, {E[6]} * nx + {E[7]} * ny + {E[8]} AS c, {E[0]} * nu + {E[3]} * nv + {E[6]} AS s, {E[1]} * nu + {E[4]} * nv + {E[7]} AS t FROM n) """


@query(EPI + "SELECT id, round((nu * a + nv * b + c) ** 2 * (1 / (a * a + b * b) + 1 / (s * s + t * t)), 6) AS d FROM l")
def symmetric_epipolar(spark, d):
    k = geo.matrix(K)
    return geo_points(spark, d).select("id", r6(geo.symmetric_epipolar(*pq(), geo.matrix(E), k, k)).alias("d"))


@query(EPI + "SELECT id % 10 AS pair_id, round(avg(CASE WHEN abs(nu * a + nv * b + c) * (1 / sqrt(a * a + b * b) + 1 / sqrt(s * s + t * t)) / 2 < 0.3 THEN 1.0 ELSE 0 END), 6) AS rate FROM l GROUP BY 1")
def epi_inlier_rate(spark, d):
    k, (p, q) = geo.matrix(K), pq()
    inlier = geo.epipolar_inlier(geo.normalize(k, p), geo.normalize(k, q), geo.matrix(E), 0.3)
    return geo_points(spark, d).select(F.expr("id % 10").alias("pair_id"), inlier.cast("double").alias("i")).groupBy("pair_id").agg(r6(F.avg("i")).alias("rate"))


@query(EPI + "SELECT round(avg(CASE WHEN abs(nu * a + nv * b + c) / (sqrt(a * a + b * b) + 1e-8) < 0.5 AND abs(nu * a + nv * b + c) / (sqrt(s * s + t * t) + 1e-8) < 0.5 THEN 1.0 ELSE 0 END), 6) AS rate FROM l")
def fundamental_inlier_rate(spark, d):
    k, (p, q) = geo.matrix(K), pq()
    size = (F.lit(3.0), F.lit(4.0))
    inlier = geo.fundamental_inlier(geo.normalize(k, p), geo.normalize(k, q), geo.matrix(E), size, size, 0.1)
    return geo_points(spark, d).agg(r6(F.avg(inlier.cast("double"))).alias("rate"))


@query("SELECT vec_id, round(least(a, 360 - a), 3) AS rotation, round(least(b, 180 - b), 4) AS translation FROM (SELECT vec_id, (vec_id * 7 % 360)::DOUBLE AS a, degrees(acos(cos(radians((vec_id * 11 % 180)::DOUBLE)))) AS b FROM embeddings)")
def pose_errors(spark, d):
    # acos loses half of the digits near 0 and 180 degrees, so degrees are rounded to three places
    a, b, o = F.radians(F.expr("CAST(vec_id * 7 % 360 AS DOUBLE)")), F.radians(F.expr("CAST(vec_id * 11 % 180 AS DOUBLE)")), F.lit(0.0)
    turn = F.array(F.cos(a), -F.sin(a), o, F.sin(a), F.cos(a), o, o, o, F.lit(1.0))
    t = table(spark, d, "embeddings")
    return t.select("vec_id", F.round(geo.rotation_error(turn, geo.matrix([1, 0, 0, 0, 1, 0, 0, 0, 1])), 3).alias("rotation"), F.round(geo.translation_error([F.cos(b) * 2, F.sin(b) * 2, o], [F.lit(3.0), o, o]), 4).alias("translation"))


@query(GEO + """, z AS (SELECT *, 2 + (id % 5) * 0.5 AS z FROM p), c AS (SELECT id, x, y, ((x - 320) / 500 * z + 0.1) AS cx, ((y - 240) / 510 * z - 0.2313) AS cy, z + 0.05 AS cz FROM z), w AS (SELECT id, (500 * cx + 320 * cz) / (cz + 1e-4) AS wx, (510 * cy + 240 * cz) / (cz + 1e-4) AS wy, cz FROM c)
SELECT id, round(wx, 6) AS wx, round(wy, 6) AS wy, wx > 0 AND wx < 639 AND wy > 0 AND wy < 479 AS covisible, abs((2.5 - cz) / 2.5) < 0.2 AS consistent FROM w""")
def warp_keypoints(spark, d):
    k, pose = geo.matrix(K), geo.matrix([1, 0, 0, 0.1, 0, 1, 0, -0.2313, 0, 0, 1, 0.05, 0, 0, 0, 1])
    x, y, z = geo.warp(pq()[0], F.expr("CAST(2 + (id % 5) * 0.5 AS DOUBLE)"), pose, k, k)
    t = geo_points(spark, d).select("id", x.alias("wx"), y.alias("wy"), z.alias("wz"))
    return t.select("id", r6("wx").alias("wx"), r6("wy").alias("wy"), geo.covisible((F.col("wx"), F.col("wy")), F.lit(640), F.lit(480)).alias("covisible"), geo.consistent(F.lit(2.5), F.col("wz")).alias("consistent"))


@query("SELECT vec_id, round(4 * w - x + 2 * y - 3 * z, 6) AS qw, round(4 * x + w - 2 * z - 3 * y, 6) AS qx, round(4 * y - z - 2 * w + 3 * x, 6) AS qy, round(4 * z + y + 2 * x + 3 * w, 6) AS qz FROM (SELECT vec_id, embedding[1]::DOUBLE AS w, embedding[2]::DOUBLE AS x, embedding[3]::DOUBLE AS y, embedding[4]::DOUBLE AS z FROM embeddings)")
def quaternion_product(spark, d):
    q = tr.quaternion_multiply(geo.matrix([4, 1, -2, 3]), F.slice("embedding", 1, 4).cast("array<double>"))
    return table(spark, d, "embeddings").select("vec_id", *[r6(q[i]).alias(n) for i, n in enumerate(("qw", "qx", "qy", "qz"))])


@query("SELECT vec_id, round(cos(b) * cos(c), 6) AS m00, round(sin(a) * sin(b) * cos(c) - cos(a) * sin(c), 6) AS m01, round(-sin(b), 6) AS m20, round(cos(a) * cos(b), 6) AS m22 FROM (SELECT vec_id, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, embedding[3]::DOUBLE AS c FROM embeddings)")
def euler_matrix(spark, d):
    m = tr.euler_matrix([F.col("embedding")[k].cast("double") for k in range(3)], "sxyz")
    return table(spark, d, "embeddings").select("vec_id", *[r6(m[k]).alias(n) for k, n in ((0, "m00"), (1, "m01"), (8, "m20"), (10, "m22"))])


@query("SELECT vec_id, round(sin((1 - f) * 1.2) / sin(1.2) + cos(1.2) * sin(f * 1.2) / sin(1.2), 6) AS qw, round(sin(1.2) * sin(f * 1.2) / sin(1.2), 6) AS qx FROM (SELECT vec_id, (vec_id % 97 + 1) / 99.0::DOUBLE AS f FROM embeddings)")
def quaternion_slerp(spark, d):
    q = tr.quaternion_slerp(geo.matrix([1, 0, 0, 0]), F.array(F.cos(F.lit(1.2)), F.sin(F.lit(1.2)), F.lit(0.0), F.lit(0.0)), F.expr("CAST((vec_id % 97 + 1) / 99.0D AS DOUBLE)"))
    return table(spark, d, "embeddings").select("vec_id", r6(q[0]).alias("qw"), r6(q[1]).alias("qx"))


# grouped estimation of planted models: the inliers are those that were left where the model puts them

OUT = "(vec_id // 10) % 10 < 3"


def _planted(spark: SparkSession, d: str) -> DataFrame:
    x, y = geo.perspective(geo.matrix(H), pq()[0])
    t = geo_points(spark, d).select(F.expr("id % 10").alias("pair_id"), "id", F.col("x").alias("x1"), F.col("y").alias("y1"), x.alias("x2"), y.alias("y2"))
    return t.withColumn("x2", F.when(F.expr("(id div 10) % 10 < 3"), F.col("x2") + 60 + F.expr("id % 50")).otherwise(F.col("x2")))


@query(f"SELECT vec_id % 10 AS pair_id, count(*) AS n, count(*) FILTER (NOT ({OUT})) AS inliers, round(avg(CASE WHEN {OUT} THEN 0.0 ELSE 1 END), 6) AS ratio, 0.0::DOUBLE AS error FROM embeddings GROUP BY 1")
def ransac_homography(spark, d):
    return robust.homography(_planted(spark, d), 5.0).select("pair_id", big("n").alias("n"), big("inliers").alias("inliers"), r6("ratio").alias("ratio"), F.abs(r6("error")).alias("error"))


@query(f"SELECT vec_id % 10 AS pair_id, vec_id AS id, NOT ({OUT}) AS inlier FROM embeddings")
def homography_inliers(spark, d):
    m = _planted(spark, d)
    return robust.with_inliers(m, robust.homography(m, 5.0), 5.0).select("pair_id", "id", "inlier")


@query(f"SELECT vec_id % 10 AS pair_id, vec_id AS id, round(((vec_id * 37) % 640)::DOUBLE, 6) AS x1, CASE WHEN {OUT} THEN 'outlier' ELSE 'inlier' END AS kind FROM embeddings")
def match_segments(spark, d):
    m = _planted(spark, d)
    return registry.match_segments(robust.with_inliers(m, robust.homography(m, 5.0), 5.0), 640, "id").select("pair_id", "id", r6("x1").alias("x1"), "kind")


def _two_views(spark: SparkSession, d: str) -> DataFrame:
    """Points at many depths, seen from two cameras; some are moved across their lines."""
    k, pose = geo.matrix(K), geo.matrix(POSE)
    x, y, _ = geo.warp(pq()[0], F.expr("CAST(2 + (id * 13 % 17) * 0.4 AS DOUBLE)"), pose, k, k)
    t = geo_points(spark, d).select(F.expr("id % 10").alias("pair_id"), "id", F.col("x").alias("x1"), F.col("y").alias("y1"), x.alias("x2"), y.alias("y2"))
    return t.withColumn("x2", F.when(F.expr("(id div 10) % 10 < 3"), F.col("x2") + 90 + F.expr("id % 50")).otherwise(F.col("x2")))


#: A shift mostly upwards, so that epipolar lines are steep.
POSE = (1.0, 0.0, 0.0, 0.05, 0.0, 1.0, 0.0, -0.9, 0.0, 0.0, 1.0, 0.1, 0.0, 0.0, 0.0, 1.0)


@query(f"SELECT vec_id % 10 AS pair_id, count(*) AS n, count(*) FILTER (NOT ({OUT})) AS inliers FROM embeddings GROUP BY 1")
def ransac_fundamental(spark, d):
    return robust.fundamental(_two_views(spark, d), threshold=0.5).select("pair_id", big("n").alias("n"), big("inliers").alias("inliers"))


@query("SELECT DISTINCT vec_id % 10 AS pair_id, true AS rotation_found, true AS direction_found FROM embeddings")
def essential_pose(spark, d):
    """Poses from samples of five, against the planted one, to half a degree."""
    m = _two_views(spark, d).withColumn("k0", geo.matrix(K)).withColumn("k1", geo.matrix(K))
    truth = m.select("pair_id").distinct().withColumn("rotation", geo.matrix([1, 0, 0, 0, 1, 0, 0, 0, 1])).withColumn("translation", geo.matrix([0.05, -0.9, 0.1]))
    e = robust.pose_errors(robust.relative_pose(m, 0.5), truth)
    return e.select("pair_id", (F.col("r_err") < 0.5).alias("rotation_found"), (F.col("t_err") < 0.5).alias("direction_found"))


@query("SELECT DISTINCT vec_id % 10 AS pair_id, vec_id % 10 = 3 AS lost FROM embeddings")
def failed_pose_is_infinite(spark, d):
    """A pair with four matches has no pose."""
    m = _two_views(spark, d).withColumn("k0", geo.matrix(K)).withColumn("k1", geo.matrix(K))
    truth = m.select("pair_id").distinct().withColumn("rotation", geo.matrix([1, 0, 0, 0, 1, 0, 0, 0, 1])).withColumn("translation", geo.matrix([0.05, -0.9, 0.1]))
    e = robust.pose_errors(robust.relative_pose(m.where("pair_id <> 3 OR id < 40"), 0.5), truth)
    return e.select("pair_id", ((F.col("r_err") == float("inf")) & (F.col("t_err") == float("inf"))).alias("lost"))


@query("SELECT DISTINCT vec_id % 10 AS pair_id, 0.9::DOUBLE AS m00, 0.1::DOUBLE AS m01, 30.0::DOUBLE AS m02, -0.05::DOUBLE AS m10, 1.1::DOUBLE AS m11, -20.0::DOUBLE AS m12 FROM embeddings")
def affine_registration(spark, d):
    t = geo_points(spark, d).select(F.expr("id % 10").alias("pair_id"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.expr("0.9 * x + 0.1 * y + 30").cast("double").alias("x2"), F.expr("-0.05 * x + 1.1 * y - 20").cast("double").alias("y2"))
    return robust.affine(t).select("pair_id", *[r6(F.col("m")[3 * r + c]).alias(f"m{r}{c}") for r in range(2) for c in range(3)])


@query("SELECT vec_id % 10 AS pair_id, count(*) AS n, vec_id % 10 < 6 AS same FROM embeddings GROUP BY ALL")
def verify_pairs(spark, d):
    """From keypoints of both images to a decision: as many tenths of a pair's points are out of place as its number says."""
    x, y = geo.perspective(geo.matrix(H), pq()[0])
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("descriptor"))
    t = geo_points(spark, d).join(e, "id").select(F.expr("id % 10").alias("pair_id"), F.col("id").alias("idx"), F.col("x"), F.col("y"), x.alias("u"), y.alias("v"), F.lit(1.0).alias("score"), "descriptor")
    moved = F.when(F.expr("(idx div 10) % 10 < pair_id"), F.col("u") + 60 + F.expr("idx * 31 % 397")).otherwise(F.col("u"))
    side = lambda x, y: t.select("pair_id", "idx", x.alias("x"), y.alias("y"), "score", "descriptor")
    found = registry.verify(side(F.col("x"), F.col("y")), side(moved, F.when(F.expr("(idx div 10) % 10 < pair_id"), F.col("v") - F.expr("idx * 17 % 211")).otherwise(F.col("v"))), registry.PRESETS["classical"].with_(matcher="nn", keypoints=1_000_000))
    return found.select("pair_id", big("n").alias("n"), "same")


# streams, in their batch form


@query("SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_key(spark, d):
    return frames.latest(table(spark, d, "events").select("user_id", "event_id", "value", F.col("event_id").alias("o")), "user_id", "o").select("user_id", "event_id", "value")


@query("SELECT user_id, round(sum(value * CASE WHEN k = 1 THEN 1 ELSE 0.3 END * 0.7 ** (n - k)), 6) AS ema FROM (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) GROUP BY user_id")
def ema_timer(spark, d):
    return frames.smoothed(table(spark, d, "events"), "user_id", "event_id", "value").select("user_id", r6("ema").alias("ema"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts)::TIMESTAMP AS start, count(*) AS n FROM events GROUP BY 1")
def windowed_rates(spark, d):
    return frames.windowed_rates(table(spark, d, "events"), width="1 day").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")
