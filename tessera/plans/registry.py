"""Components by name, parameter sets, and the interfaces of learned parts."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, keypoints, knn, metrics, robust
from ..shared import stored
from ..sources import corpus, hdf5, images
from ..streaming import camera


class FeatureExtractor(Protocol):
    """Images to keypoint rows (image_id, kp_idx, x, y, score, descriptor); load weights once for each Python worker, in mapInArrow."""

    def __call__(self, images: DataFrame) -> DataFrame: ...


class PairMatcher(Protocol):
    """Two descriptor tables to matches (pair_id, i, j, …)."""

    def __call__(self, left: DataFrame, right: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Parameters:
    """Fixed values of a pipeline; ``with_`` gives a changed copy."""

    matcher: str = "nn"
    ratio: float = 0.75
    cross_check: bool = False
    keypoints: int = 1000
    root: bool = False
    homography: str = "classical"
    decision: str = "classical"
    options: dict[str, float] = field(default_factory=dict)

    def with_(self, **changes) -> Parameters:
        return replace(self, **changes)


#: Parameter sets by pipeline.
PRESETS = {
    "classical": Parameters("binary", 0.75, False, 1000),
    "learned_detector": Parameters("nn", 0.8, False, 4000, False, "learned_detector", "learned_detector"),
    "sparse_graph": Parameters("nn", 0.9, True, 1024, False, "sparse_graph", "sparse_graph", {"iterations": 20, "threshold": 0.2}),
    "seeded_graph": Parameters("nn", 0.9, True, 4000, True, "seeded_graph", "seeded_graph", {"iterations": 100, "threshold": 0.2}),
    "dense": Parameters("nn", 0.9, True, 4000, False, "dense", "dense"),
    "coarse_to_fine": Parameters("nn", 0.9, True, 4000, False, "coarse_to_fine", "coarse_to_fine", {"threshold": 0.2, "border": 2}),
}



def merged(base: Parameters, changes: Mapping[str, object]) -> Parameters:
    """base with the values of a configuration file; names in either case, unknown ones are an error."""
    known, out = {f.name for f in fields(Parameters)}, {}
    for name, value in changes.items():
        if name.lower() not in known:
            raise KeyError(name)
        out[name.lower()] = {**base.options, **{k.lower(): v for k, v in value.items()}} if name.lower() == "options" else value
    return base.with_(**out)


def read_parameters(base: Parameters, path: str) -> Parameters:
    """base with the values of a YAML file on the driver."""
    import yaml

    with open(path) as f:
        return merged(base, yaml.safe_load(f) or {})


_components: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str, component: Callable) -> None:
    _components[kind, name] = component


def component(kind: str, name: str) -> Callable:
    """A registered extractor, matcher, reader or evaluator; an unknown one is an error."""
    if (kind, name) not in _components:
        raise NotImplementedError(f"{kind} {name}")
    return _components[kind, name]


def _rooted(keypoint_table: DataFrame) -> DataFrame:
    return keypoint_table.withColumn("descriptor", keypoints.root_normalize(F.col("descriptor").cast("array<double>")))


for _name in ("nn", "nn_approximate", "binary", "binary_lsh"):
    register("matcher", _name, lambda a, b, p, n=_name: knn.match(a, b, n, p.ratio, p.cross_check))
register("evaluator", "auc", metrics.pose_auc)
register("evaluator", "sequences", metrics.sequence_slices)
register("reader", "correspondences", corpus.correspondences)
register("reader", "images", images.read_images)


def _source(name: str, source: type) -> Callable:
    """A reader by one of the library's own data sources: (spark, path, schema or none, options)."""

    def read(spark: SparkSession, path: str, schema: str | None = None, **options) -> DataFrame:
        spark.dataSource.register(source)
        r = spark.read.format(name).options(**options)
        return (r.schema(schema) if schema else r).load(path)

    return read


register("reader", "hdf5", _source("hdf5", hdf5.Hdf5Source))
register("reader", "frames", _source("frames", camera.FrameSource))
register("extractor", "stored", lambda keypoint_table, p: keypoints.top_k(keypoint_table, p.keypoints))
register("extractor", "stored_root", lambda keypoint_table, p: _rooted(keypoints.top_k(keypoint_table, p.keypoints)))
register("extractor", "sift", lambda images, p: features.blobs(images, p.keypoints))
register("extractor", "root_sift", lambda images, p: _rooted(features.blobs(images, p.keypoints)))
register("extractor", "orb", lambda images, p: features.corners(images, p.keypoints))


def matched(left: DataFrame, right: DataFrame, parameters: Parameters) -> DataFrame:
    """(pair_id, i, j, d, x1, y1, x2, y2) from keypoint tables (pair_id, idx, x, y, score, descriptor) of both images of each pair.

    The matches of the best keypoints; pairs with fewer than two keypoints on a
    side have none.
    """
    best = lambda t: keypoints.top_k(t.withColumn("kp_idx", F.col("idx")), parameters.keypoints, "pair_id").drop("rank", "kp_idx")
    many = lambda t: t.join(t.groupBy("pair_id").agg(F.count("*").alias("n")).where("n >= 2").select("pair_id"), "pair_id", "left_semi")
    a, b = many(best(left)), many(best(right))
    if parameters.root:
        a, b = _rooted(a), _rooted(b)
    # the matcher counts, cuts and reads them several times, each of which would sort all descriptors anew
    a, b = stored(a, "keypoints"), stored(b, "keypoints")
    found = component("matcher", parameters.matcher)(a.select("pair_id", "idx", "descriptor"), b.select("pair_id", "idx", "descriptor"), parameters)
    at = lambda t, i, x, y: t.select("pair_id", F.col("idx").alias(i), F.col("x").alias(x), F.col("y").alias(y))
    return found.join(at(a, "i", "x1", "y1"), ["pair_id", "i"]).join(at(b, "j", "x2", "y2"), ["pair_id", "j"])


def verify(left: DataFrame, right: DataFrame, parameters: Parameters) -> DataFrame:
    """(pair_id, n, inliers, ratio, error, h, same) from keypoint tables as ``matched`` takes them.

    The matches, a robust homography, and the decision; a pair without
    matches isn't the same.
    """
    threshold, most = robust.HOMOGRAPHY[parameters.homography]
    h = robust.homography(matched(left, right, parameters), threshold, most)
    every = left.select("pair_id").unionByName(right.select("pair_id")).distinct()
    out = every.join(h, "pair_id", "left")
    return out.select("pair_id", F.coalesce("n", F.lit(0)).alias("n"), "inliers", "ratio", "error", "h", metrics.decide(F.col("ratio"), F.col("error"), *metrics.DECISIONS[parameters.decision]).alias("same"))


def sides(pairs: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keypoint tables of both images of pairs (pair_id, file1, file2); an image of many pairs is extracted once and given to each."""
    own = lambda file: pairs.select("pair_id", F.col(file).alias("image_id")).join(features, "image_id").select("pair_id", F.col("kp_idx").cast("long").alias("idx"), "x", "y", "score", "descriptor")
    return own("file1"), own("file2")


def verify_images(pairs: DataFrame, images: DataFrame, extractor: str, parameters: Parameters) -> DataFrame:
    """As verify, for every pair (pair_id, file1, file2) of images, by a registered extractor; pairs of unread images aren't the same.

    Every pair has its row, and one without keypoints on both sides has no
    matches.  The features are worked out once and stored in the shared folder;
    ``feature_store`` keeps them from run to run.
    """
    features_ = stored(component("extractor", extractor)(images, parameters), "features")
    found = verify(*(stored(s, "side") for s in sides(pairs, features_)), parameters)
    return pairs.select("pair_id").join(found, "pair_id", "left").withColumns({"n": F.coalesce("n", F.lit(0)), "same": F.coalesce("same", F.lit(False))})


def write_results(results: DataFrame, path: str) -> None:
    """Results by modality and truth, one folder each; results have the columns modality and gt."""
    results.write.partitionBy("modality", "gt").mode("overwrite").parquet(path)


def match_segments(matches: DataFrame, width: int, *extra: str) -> DataFrame:
    """(pair_id, x1, y1, x2, y2, kind) to draw both images side by side: inlier, outlier, or match without a homography."""
    kind = F.when(F.col("inlier").isNull(), "match").when(F.col("inlier"), "inlier").otherwise("outlier")
    return matches.select("pair_id", *extra, "x1", "y1", (F.col("x2") + width).alias("x2"), "y2", kind.alias("kind"))
