"""The kept-up feature table: nothing twice, and killed runs repeat only their own images."""

import numpy as np
import pytest

from tessera.operators import features as fe
from tessera.plans.feature_store import FeatureStore
from tessera.sources import images as im


def files(spark, names):
    out = []
    for n in names:
        yy, xx = np.mgrid[:48, :48]
        image = 50 + 150 * np.exp(-((xx - 20 - ord(n[0]) % 7) ** 2 + (yy - 24) ** 2) / 18)
        out.append((n, bytearray(b"P5 48 48 255\n" + np.rint(image).astype(np.uint8).tobytes())))
    return spark.createDataFrame([*out, ("nothing", None)], "path string, content binary")


def test_runs(spark, tmp_path):
    seen = []

    def extract(t):
        seen.append(sorted(r.path for r in t.select("path").collect()))
        return fe.blobs(t)

    store = FeatureStore(spark, f"file://{tmp_path}/store", extract, im.images)
    assert store.features(files(spark, "ab")).count() == 0
    assert store.add(files(spark, ["a", "b", "a2"])) == 2  # a2 is equal to a
    first = store.features(files(spark, ["a", "b", "a2"]))
    assert {r.image_id for r in first.collect()} == {"a", "b", "a2"}
    assert store.add(files(spark, ["a", "b"])) == 0 and seen[-1] == []
    assert store.add(files(spark, ["b", "c"])) == 1 and len(seen[-1]) == 1
    want = sorted(map(str, fe.blobs(im.images(files(spark, ["a", "b", "c", "a2"]))).collect()))
    got = store.features(files(spark, ["a", "b", "c", "a2"]))
    assert sorted(map(str, got.select(*fe.blobs(im.images(files(spark, ["a"]))).columns).collect())) == want


def test_killed_runs(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    store = FeatureStore(spark, path, fe.blobs, im.images)
    assert store.add(files(spark, ["a", "b"])) == 2

    def dies(t):
        return fe.blobs(t).selectExpr("*", "raise_error('killed') AS e").drop("e").where("assert_true(size < 0) IS NULL")

    with pytest.raises(Exception, match="true"):
        FeatureStore(spark, path, dies, im.images).add(files(spark, ["c", "d", "a"]))
    assert len(store.runs()) == 1 and len(store.runs(whole=False)) == 1
    assert {r.image_id for r in store.kept_up(files(spark, ["a", "b", "c", "d"])).collect()} == {"a", "b", "c", "d"}
    assert store.index().count() == 4 and store.tidy() == 1 and store.tidy() == 0 and len(store.runs()) == 2


def test_two_runs_at_once_store_an_image_twice_but_it_counts_once(spark, tmp_path):
    store = FeatureStore(spark, f"file://{tmp_path}/store", fe.blobs, im.images)
    index, store.index = store.index, lambda: spark.createDataFrame([], "hash string, run string")
    assert store.add(files(spark, ["a"])) == store.add(files(spark, ["a"])) == 1
    store.index = index
    assert store.features(files(spark, ["a"])).count() == fe.blobs(im.images(files(spark, ["a"]))).count()
