"""Evaluations in one call: from the matches of many pairs and the truth to the figures that are told."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import metrics, robust
from ..shared import stored

#: Degrees up to which the areas are told.
EDGES = (0, 5, 10, 15, 20, 25, 30)


def inlier_counts(matches: DataFrame, truth: DataFrame, threshold: float, key: str = "pair_id") -> DataFrame:
    """(key, matches, inliers) of pairs with two matches or more: those near the epipolar lines of the true pose, in normalised coordinates."""
    point = lambda k, x, y: geo.normalize(F.col(k), (F.col(x), F.col(y)))
    t = matches.join(truth.select(key, "rotation", "translation"), key).withColumn("e", geo.essential(F.col("rotation"), [F.col("translation")[k] for k in range(3)]))
    near: Column = geo.epipolar_inlier(point("k0", "x1", "y1"), point("k1", "x2", "y2"), F.col("e"), threshold)
    return t.groupBy(key).agg(F.count("*").alias("matches"), F.count_if(near).alias("inliers")).where("matches > 1")


def pose_evaluation(matches: DataFrame, truth: DataFrame, threshold: float = 1.0, inlier_threshold: float = 5e-3, edges=EDGES, key: str = "pair_id") -> DataFrame:
    """(figure, upto, value): exact_auc and approximate_auc up to each edge, precision and match_score in per cent.

    matches: (key, x1, y1, x2, y2, k0, k1); truth: (key, rotation, translation,
    keypoints), a row for each pair.  A pair's error is the larger of its two
    angles.  Too few matches for a pose count as the identity and no move, and a
    pair with fewer than two matches has no inliers.  All pairs count; without
    any there are no rows.
    """
    poses = robust.relative_pose(matches, threshold, identity_fallback=True, key=key)
    missing = truth.select(key).join(poses.select(key), key, "left_anti").select(key, geo.matrix([1, 0, 0, 0, 1, 0, 0, 0, 1]).alias("rotation"), geo.matrix([0, 0, 0]).alias("translation"))
    e = robust.pose_errors(poses.select(key, "rotation", "translation").unionByName(missing), truth, key)
    # no move has no direction: it is as wrong as can be
    each = e.select(key, F.greatest("r_err", F.coalesce("t_err", F.lit(90.0))).alias("error"))
    each = each.join(inlier_counts(matches, truth, inlier_threshold, key), key, "left").join(truth.select(key, "keypoints"), key)
    each = stored(each.select("error", F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("inliers", F.lit(0)).alias("inliers"), "keypoints"), "evaluation")
    exact = metrics.pose_auc(each, [x for x in edges if x]).select(F.lit("exact_auc").alias("figure"), F.col("threshold").alias("upto"), F.col("auc").alias("value"))
    rough = metrics.approximate_auc(each, edges).select(F.lit("approximate_auc").alias("figure"), "upto", F.col("auc").alias("value"))
    score = metrics.match_score(each).where("precision IS NOT NULL")
    means = score.select(F.explode(F.array(*[F.struct(F.lit(n).alias("figure"), F.lit(None).cast("double").alias("upto"), (100 * F.col(n)).alias("value")) for n in ("precision", "match_score")])).alias("x")).select("x.*")
    return exact.unionByName(rough.where("value IS NOT NULL")).unionByName(means)
