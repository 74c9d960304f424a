import struct
import zlib

import numpy as np
import pytest

from tessera.operators import robust
from tessera.plans import registry
from tessera.sources import images as im


def chunk(name, body):
    return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))


def png(image, bits=8, filters=None):
    """An encoder with any of the five line filters, by their definitions."""
    h, w, c = image.shape
    rows = (image.astype(">u2").view(np.uint8) if bits == 16 else image.astype(np.uint8)).reshape(h, -1).astype(int)
    step, out = c * bits // 8, b""
    for y in range(h):
        kind = (filters or [0])[y % len(filters or [0])]
        up = rows[y - 1] if y else np.zeros_like(rows[0])
        left, corner = (np.concatenate([np.zeros(step, int), r[:-step]]) for r in (rows[y], up))
        p = left + up - corner
        near = np.stack([abs(p - left), abs(p - up), abs(p - corner)]).argmin(axis=0)
        guess = [0 * up, left, up, (left + up) // 2, np.choose(near, [left, up, corner])][kind]
        out += bytes([kind]) + ((rows[y] - guess) % 256).astype(np.uint8).tobytes()
    kind = {1: 0, 3: 2, 2: 4, 4: 6}[c]
    return im.PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


RNG = np.random.default_rng(1)


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
@pytest.mark.parametrize("bits", [8, 16])
def test_png_of_each_filter(channels, bits):
    image = RNG.integers(0, 1 << bits, (10, 7, channels))
    got = im.decode(png(image, bits, [0, 1, 2, 3, 4]))
    assert np.array_equal(got, image[:, :, : 3 if channels >= 3 else 1])


def test_pnm():
    gray, colour = RNG.integers(0, 256, (3, 4, 1)), RNG.integers(0, 256, (3, 4, 3))
    assert np.array_equal(im.decode(b"P5\n# made here\n4 3\n255\n" + gray.astype(np.uint8).tobytes()), gray)
    assert np.array_equal(im.decode(b"P6 4 3 255\n" + colour.astype(np.uint8).tobytes()), colour)
    assert np.array_equal(im.decode(b"P2\n4 3\n255\n" + " ".join(map(str, gray.ravel())).encode()), gray)
    deep = RNG.integers(0, 65536, (3, 4, 1))
    assert np.array_equal(im.decode(b"P5 4 3 65535\n" + deep.astype(">u2").tobytes()), deep)


def test_resize_is_bilinear():
    ramp = np.tile(np.arange(8.0), (4, 1))
    assert np.allclose(im.resize(ramp, 4, 4), np.tile([0.5, 2.5, 4.5, 6.5], (4, 1)))
    assert np.allclose(im.resize(ramp, 16, 4)[0, :4], [0, 0.25, 0.75, 1.25])
    assert im.resize(np.ones((3, 5, 3)), 7, 9).shape == (9, 7, 3)


def test_images_of_a_folder(spark, tmp_path):
    image = RNG.integers(0, 256, (20, 30, 3))
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.png").write_bytes(png(image, filters=[4]))
    (tmp_path / "a" / "broken.png").write_bytes(b"no image")
    rows = {r.path.rsplit("/", 1)[1]: r for r in registry.component("reader", "images")(spark, f"file://{tmp_path}", size=(20,), multiple=4, pad=True, turns=1, unit=True).collect()}
    assert rows["broken.png"].width is None
    r = rows["x.png"]
    assert (r.width, r.height, r.channels, r.kept_w, r.kept_h) == (20, 20, 1, 20, 12)
    assert (r.scale_x, r.scale_y) == pytest.approx((20 / 12, 1.5))
    gray = im.pad_square(im.resize(np.rint(image @ np.array(im.GRAY)), 20, 12)) / 255
    assert np.allclose(np.reshape(r["values"], (20, 20)), np.rot90(gray, 1), atol=1e-6)
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/a/x.png")
    plain = im.images(files, gray=False, augment=lambda x: 255 - x).first()
    assert np.array_equal(np.reshape(plain["values"], (20, 30, 3)), 255 - image)


def test_depth_maps_and_frames(spark, tmp_path):
    depth = RNG.integers(0, 3, (4, 5, 1)) * 1500
    (tmp_path / "d.png").write_bytes(png(depth, 16))
    files = spark.read.format("binaryFile").load(f"file://{tmp_path}/d.png")
    got = {(r.y, r.x): r.depth for r in im.depth_maps(files).collect()}
    assert got == {(y, x): depth[y, x, 0] / 1000 for y in range(4) for x in range(5) if depth[y, x, 0]}
    (tmp_path / "f").mkdir()
    for k in range(7):
        (tmp_path / "f" / f"{k}.pgm").write_bytes(b"P5 2 2 255\n" + bytes([k] * 4))
    stream = spark.read.format("binaryFile").load(f"file://{tmp_path}/f")
    assert sorted((r.frame, r["values"][0]) for r in im.frames(stream, skip=2, most=3).collect()) == [(0, 0.0), (1, 2.0), (2, 4.0)]


def test_five_points_hold_the_true_matrix():
    rng = np.random.default_rng(4)
    hits = 0
    for _ in range(30):
        u, _, vh = np.linalg.svd(rng.normal(size=(3, 3)))
        r = u @ vh * np.sign(np.linalg.det(u @ vh))
        t, x = rng.normal(size=3), rng.uniform(-1, 1, (5, 3)) + [0, 0, 5]
        y = x @ r.T + t
        e = np.array([[0, -t[2], t[1]], [t[2], 0, -t[0]], [-t[1], t[0], 0]]) @ r
        e = e / np.linalg.norm(e)
        found = robust.five_points(x[:, :2] / x[:, 2:], y[:, :2] / y[:, 2:])
        hits += any(min(np.abs(f - e).max(), np.abs(f + e).max()) < 1e-5 for f in found)
    assert hits >= 29


def test_pose_of_five_matches(spark):
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    x = np.random.default_rng(5).uniform([-2, -2, 4], [2, 2, 9], (5, 3))
    p, q = x @ k.T, (x + [1.0, 0.2, 0.1]) @ k.T
    cam = k.ravel().tolist()
    rows = [(1, *map(float, a[:2] / a[2]), *map(float, b[:2] / b[2]), cam, cam) for a, b in zip(p, q, strict=True)]
    t = spark.createDataFrame(rows, "pair_id long, x1 double, y1 double, x2 double, y2 double, k0 array<double>, k1 array<double>")
    assert robust.relative_pose(t).first().rotation is not None
    assert robust.relative_pose(t.limit(4)).first().rotation is None


def test_parameters_of_a_file(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("RATIO: 0.7\nkeypoints: 500\noptions:\n  Iterations: 7\n")
    p = registry.read_parameters(registry.PRESETS["sparse_graph"], str(path))
    assert (p.ratio, p.keypoints, p.options["iterations"], p.options["threshold"]) == (0.7, 500, 7, 0.2)
    with pytest.raises(KeyError):
        registry.merged(p, {"unknown": 1})


def test_rows_of_approximate_neighbours_without_base(spark):
    from tessera.operators import knn

    t = spark.createDataFrame([(1, i, [float(i), 0.0]) for i in range(30)], "pair_id int, idx long, descriptor array<double>")
    assert knn.approximate(t, t.limit(0)).count() == 0
    assert knn.approximate(t, t, 1).where("i = j AND d = 0").count() >= 28


def test_images_of_a_small_table_are_many_tasks(spark):
    """Keys in one partition, as a small file has them, are dealt to several before images are drawn from them, and pairs before distances are sampled."""
    from pyspark.sql import functions as F

    from tessera.plans import image_queries

    keys = spark.range(64).coalesce(1).withColumnRenamed("id", "key")
    got = image_queries.drawn(keys, lambda k: {"one": b"x"}).select("path", F.spark_partition_id().alias("task")).collect()
    assert sorted(r.path for r in got) == sorted(f"{k}/one" for k in range(64)) and len({r.task for r in got}) > 1
    level = F.expr("array(0D, 0D, 0D, 0D, 0D, -1D, 0D, 1D, 0D)")
    pairs = keys.select(F.col("key").alias("pair_id"), level.alias("f1"), level.alias("f2"), F.expr("array(640D, 480D)").alias("size1"), F.expr("array(640D, 480D)").alias("size2"))
    far = robust.fundamental_distance(pairs, samples=5).select("sgd", F.spark_partition_id().alias("task")).collect()
    assert len(far) == 64 and len({r.task for r in far}) > 1
