"""Data-set metrics over tables of per-pair results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..shared import stored

#: The epipolar threshold of each data set.
EPIPOLAR_THRESHOLDS = {"scannet": 5e-4, "megadepth": 1e-4, "gl3d": 1e-4}


def pose_auc(errors: DataFrame, thresholds: Sequence[float], error: str = "error", group: Sequence[str] = ()) -> DataFrame:
    """(group…, threshold, auc): area below the recall curve up to each threshold, over the threshold.

    Between errors the curve is straight, from (0, 0); beyond the last error
    below the threshold it is flat.  Errors may be infinite; nulls count as
    infinite.  Summed by parts, the area of m errors e below t, of n in all, is
    (m t - sum e + max e / 2) / n, so nothing has to be ordered.
    """
    e = F.coalesce(F.col(error).cast("double"), F.lit(float("inf")))
    t = errors.select(*group, e.alias("e"))
    parts = [F.count("*").alias("n")]
    for k, x in enumerate(thresholds):
        below = F.when(F.col("e") < float(x), F.col("e"))
        parts += [F.count(below).alias(f"m{k}"), F.sum(below).alias(f"s{k}"), F.max(below).alias(f"x{k}")]
    out = t.groupBy(*group).agg(*parts).where("n > 0")
    area = lambda k, x: F.coalesce((F.col(f"m{k}") * float(x) - F.col(f"s{k}") + F.col(f"x{k}") / 2) / F.col("n") / float(x), F.lit(0.0))
    each = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("threshold"), area(k, x).alias("auc")) for k, x in enumerate(thresholds)])).alias("a")
    return out.select(*group, each).select(*group, "a.*")


def approximate_auc(errors: DataFrame, edges: Sequence[float], error: str = "error") -> DataFrame:
    """(upto, auc): the mean of the cumulative histogram over the bins up to each edge; the last bin is closed on the right."""
    e = F.col(error)
    bin_ = F.lit(None).cast("int")
    for k in range(len(edges) - 2, -1, -1):
        inside = (e >= edges[k]) & ((e <= edges[k + 1]) if k == len(edges) - 2 else (e < edges[k + 1]))
        bin_ = F.when(inside, F.lit(k)).otherwise(bin_)
    counts = errors.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"))
    every = errors.sparkSession.createDataFrame([(k, float(edges[k + 1])) for k in range(len(edges) - 1)], "bin int, upto double")
    every = every.join(counts.where("bin IS NOT NULL"), "bin", "left").crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total"))))
    order = Window.partitionBy("total").orderBy("bin")
    cumulative = every.withColumn("share", F.sum(F.coalesce("n", F.lit(0))).over(order) / F.col("total"))
    return cumulative.select("upto", F.avg("share").over(order).alias("auc"))


def macro_precision(pairs: DataFrame, errors: DataFrame, thresholds: Sequence[float], key: str = "pair_id", error: str = "error") -> DataFrame:
    """(threshold, precision): the mean over pairs of the share of errors below; pairs without errors count 0."""
    each = errors.groupBy(key).agg(*[F.avg((F.col(error) < t).cast("double")).alias(f"p{k}") for k, t in enumerate(thresholds)])
    joined = pairs.select(key).join(each, key, "left")
    means = joined.agg(*[F.avg(F.coalesce(f"p{k}", F.lit(0.0))).alias(f"p{k}") for k in range(len(thresholds))])
    return means.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"p{k}").alias("precision")) for k, t in enumerate(thresholds)])).alias("x")).select("x.*")


def keep_last(table: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The last row of each key, and ``first_seen``, where the key came first: the order of the result."""
    names = [c for c in table.columns if c not in keys]
    got = table.groupBy(*keys).agg(F.max_by(F.struct(*names), position).alias("x"), F.min(position).alias("first_seen"))
    return got.select(*keys, "x.*", "first_seen")


def epipolar_errors(matches: DataFrame, poses: DataFrame) -> DataFrame:
    """matches (pair_id, x1, y1, x2, y2, ...), of any layers and sides, with ``epi_err``; poses: (pair_id, rotation, translation, k0, k1).

    The essential matrix of each pair is worked out once, on the pairs.
    """
    e = geo.essential(F.col("rotation"), [F.col("translation")[k] for k in range(3)])
    cameras = poses.select("pair_id", e.alias("e_"), F.col("k0").alias("k0_"), F.col("k1").alias("k1_"))
    d = geo.symmetric_epipolar((F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")), F.col("e_"), F.col("k0_"), F.col("k1_"))
    return matches.join(cameras, "pair_id").withColumn("epi_err", d).drop("e_", "k0_", "k1_")


def rank_mean(values: DataFrame, names: Sequence[str], average: bool = True) -> DataFrame:
    """(name, value) over the rows of all ranks: the mean of each of the columns, or the sum."""
    agg = F.avg if average else F.sum
    one = values.agg(*[agg(F.col(n).cast("double")).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("value")) for n in names])).alias("x")).select("x.*")


def aggregate_metrics(results: DataFrame, threshold: float, thresholds: Sequence[float] = (5, 10, 20)) -> DataFrame:
    """(metric, value) of results (identifier, position, r_err, t_err, epi_errs array): last row of each identifier, AUC of the larger error, precision."""
    last = keep_last(results, ["identifier"], "position")
    last = last.withColumn("error", F.greatest("r_err", "t_err"))
    auc = pose_auc(last, thresholds).select(F.concat(F.lit("auc@"), F.col("threshold").cast("int").cast("string")).alias("metric"), F.col("auc").alias("value"))
    share = F.coalesce(F.try_divide(F.size(F.filter("epi_errs", lambda e: e < threshold)), F.nullif(F.size("epi_errs"), F.lit(0))), F.lit(0.0))
    return auc.unionByName(last.agg(F.avg(share).alias("value")).select(F.lit("precision").alias("metric"), "value"))


def precision_recall(matches: DataFrame, truth: DataFrame, key: str = "pair_id", correct: str = "correct") -> DataFrame:
    """(key, precision, recall) from matches with a flag, and true counts (key, n_true) of each pair."""
    got = matches.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col(correct).cast("int")).alias("hits"))
    t = truth.join(got, key, "left")
    return t.select(key, F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("precision"), F.coalesce(F.try_divide("hits", "n_true"), F.lit(0.0)).alias("recall"))


def dataset_threshold(name: Column) -> Column:
    """The epipolar threshold of a data set; an unknown one is an error."""
    out = F.raise_error(F.concat(F.lit("unknown data set "), name)).cast("double")
    for known, value in EPIPOLAR_THRESHOLDS.items():
        out = F.when(F.lower(name) == known, F.lit(value)).otherwise(out)
    return out


def decide(ratio: Column, error: Column, least_ratio: float, most_error: float | None, inclusive: bool = False) -> Column:
    """Same person: the inlier ratio is high enough and the error, if it is asked for, low enough; without a homography, no."""
    ok = ratio >= least_ratio if inclusive else ratio > least_ratio
    return F.coalesce(ok if most_error is None else ok & (error < most_error), F.lit(False))


#: Least ratio, most error, whether the ratio itself passes, by pipeline.
DECISIONS = {"classical": (0.45, None, True), "learned_detector": (0.3, None, False), "dense": (0.2, 5.0, False), "sparse_graph": (0.2, 5.0, False), "seeded_graph": (0.4, 5.0, False), "coarse_to_fine": (0.4, 5.0, False)}


def confusion(decisions: DataFrame, predicted: str = "predicted", truth: str = "truth", group: Sequence[str] = ()) -> DataFrame:
    """Counts and rates of decisions against the truth: our own addition, for identity data with labels."""
    p, t = F.col(predicted), F.col(truth)
    c = decisions.groupBy(*group).agg(F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn"))
    return c.withColumn("accuracy", F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).withColumn("far", F.try_divide("fp", F.col("fp") + F.col("tn"))).withColumn("frr", F.try_divide("fn", F.col("fn") + F.col("tp")))


def running_before(table: DataFrame, order: str, value: str, name: str) -> DataFrame:
    """table with ``name``: the sum of value over all rows of a smaller order; ties in any order.

    Rows are dealt by ranges of the order; only the ranges' sums, one for each
    task, are added up in one place.
    """
    ranged = table.repartitionByRange(F.col(order).asc_nulls_first()).withColumn("range_id", F.spark_partition_id())
    ranged = stored(ranged, "ranges")
    sums = ranged.groupBy("range_id").agg(F.sum(value).alias("range_sum"))
    before = Window.orderBy("range_id").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range_id", F.coalesce(F.sum("range_sum").over(before), F.lit(0)).alias("range_start"))
    inside = Window.partitionBy("range_id").orderBy(F.col(order).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(starts), "range_id")  # a row for each task of the exchange before
    return out.withColumn(name, F.col("range_start") + F.coalesce(F.sum(value).over(inside), F.lit(0))).select(*table.columns, name)


def expand_sequences(counts: DataFrame, name: str = "sequence", n: str = "n", order: str = "position") -> DataFrame:
    """(sequence, pair_index, offset) from (position, sequence, n): a row for each pair, numbered through all sequences; offset is the sequence's first."""
    t = running_before(counts.select(F.col(name).alias("sequence"), F.col(n).alias("n"), F.col(order).alias("position")), "position", "n", "offset").where("n > 0")
    return t.select("sequence", "offset", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k")).select(F.col("sequence").alias(name), (F.col("offset") + F.col("k")).alias("pair_index"), "offset")


def sequence_slices(results: DataFrame, width: int = 1000, threshold: float = 0.05) -> DataFrame:
    """Of each ``width`` consecutive pairs (index, sgd, rates and counts before and after): share of sgd below the threshold, and means."""
    return results.groupBy(F.floor(F.col("index") / width).alias("slice")).agg(F.avg((F.col("sgd") < threshold).cast("double")).alias("f_recall"), F.avg("rate_pre").alias("precision_pre"), F.avg("rate_post").alias("precision_post"), F.avg("n_pre").alias("corr_pre"), F.avg("n_post").alias("corr_post"))


def match_score(pairs: DataFrame) -> DataFrame:
    """(precision, match_score) of pairs (inliers, matches, keypoints): means of inliers over matches, and over keypoints."""
    return pairs.agg(F.avg(F.coalesce(F.try_divide("inliers", "matches"), F.lit(0.0))).alias("precision"), F.avg(F.coalesce(F.try_divide("inliers", "keypoints"), F.lit(0.0))).alias("match_score"))
