"""A table of features that is kept up: what is stored for an image's bytes isn't worked out again.

Below a folder, each run of ``add`` is a folder of its own: ``features``, the
keypoints by the hash of an image's bytes, and then ``index``, the hashes of all
images of the run, those without keypoints too.  A run counts once its index is
whole, as the mark of Spark's writer says; a run that was killed is passed over
by readers and goes with ``tidy``, and its images are new again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import found, removed


class FeatureStore:
    """Features of one extractor: images (path, width, height, values, …) to keypoints (image_id, kp_idx, …)."""

    def __init__(self, spark: SparkSession, path: str, extract: Callable[[DataFrame], DataFrame], decode: Callable[[DataFrame], DataFrame]):
        self.spark, self.path, self.extract, self.decode = spark, path.rstrip("/"), extract, decode

    def runs(self, whole: bool = True) -> list[str]:
        """Folders of the runs: whole ones, or those that never ended."""
        ended = {p.removesuffix("/index/_SUCCESS") for p in found(self.spark, f"{self.path}/run-*/index/_SUCCESS")}
        return sorted(ended) if whole else [p for p in found(self.spark, f"{self.path}/run-*") if p not in ended]

    def index(self) -> DataFrame:
        """(hash, run): each stored image's first run."""
        parts = [f"{p}/index" for p in self.runs()]
        if not parts:
            return self.spark.createDataFrame([], "hash string, run string")
        return self.spark.read.schema("hash string, run string").parquet(*parts).groupBy("hash").agg(F.min("run").alias("run"))

    def add(self, files: DataFrame) -> int:
        """Works out and stores the features of files (path, content) whose bytes aren't stored yet; how many images those are.

        Equal files are one image; null contents are none.
        """
        hashed = files.where("content IS NOT NULL").select(F.sha2("content", 256).alias("path"), "content")
        new = hashed.join(self.index().select(F.col("hash").alias("path")), "path", "left_anti").dropDuplicates(["path"])
        run = f"run-{uuid.uuid4().hex[:16]}"
        at = f"{self.path}/{run}"
        self.extract(self.decode(new)).withColumnRenamed("image_id", "hash").withColumn("run", F.lit(run)).write.parquet(f"{at}/features")
        new.select(F.col("path").alias("hash"), F.lit(run).alias("run")).write.parquet(f"{at}/index")  # its mark commits the run
        return self.spark.read.parquet(f"{at}/index").count()

    def features(self, files: DataFrame) -> DataFrame:
        """(image_id, …) of files (path, content) from what is stored; images that aren't have no rows, equal files have equal ones."""
        parts = [f"{p}/features" for p in self.runs()]
        wanted = files.where("content IS NOT NULL").select(F.col("path").alias("image_id"), F.sha2("content", 256).alias("hash"))
        if not parts:
            return wanted.where("false")
        # an image that two runs stored at once counts by its first run
        stored = self.spark.read.parquet(*parts).join(self.index(), ["hash", "run"], "left_semi").drop("run")
        return wanted.join(stored, "hash").drop("hash")

    def kept_up(self, files: DataFrame) -> DataFrame:
        """features of all the files, once new ones are added."""
        self.add(files)
        return self.features(files)

    def tidy(self) -> int:
        """Removes what killed runs left, while no run is on; how many."""
        left = self.runs(whole=False)
        for p in left:
            removed(self.spark, p)
        return len(left)
