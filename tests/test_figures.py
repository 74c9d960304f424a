"""Decoded pixels of planted segments, letters, and files that a job places."""

import numpy as np
import pytest

from tessera.sources import figures as fg
from tessera.sources import images as im

RNG = np.random.default_rng(2)


def test_png_round_trip():
    image = RNG.integers(0, 256, (7, 9, 3))
    assert np.array_equal(im.decode(fg.encode_png(image)), image)


def test_lines_hit_their_pixels():
    image = np.zeros((20, 30, 3))
    ends = np.array([[2, 3, 12, 3], [5, 0, 5, 19], [0, 0, 19, 19], [25, 5, 100, 5], [np.nan, 0, 1, 1], [7, 7, 7, 7]], float)
    fg.lines(image, ends, np.array([[10 * k + 10.0] * 3 for k in range(6)]))
    assert (image[3, 6:13, 0] == 10).all() and (image[6:20, 5, 0] == 20).all() and image[10, 10, 0] == 30 and image[5, 29, 0] == 40 and image[7, 7, 0] == 60
    on = set(zip(*np.nonzero(image[:, :, 0]), strict=True))
    want = {(3, x) for x in range(2, 13)} | {(y, 5) for y in range(20)} | {(k, k) for k in range(20)} | {(5, x) for x in range(25, 30)}
    assert on == want


def test_text_by_its_dots():
    image = np.zeros((12, 40, 3))
    fg.text(image, "1z?", 1, 1, (9, 9, 9), 1)
    rows = ["".join("#" if v else "." for v in r[1:12]) for r in image[1:6, :, 0]]
    assert rows == [".#..###.###", "##....#.#.#", ".#...#..#.#", ".#..#...#.#", "###.###.###"]
    fg.text(image, "long text beyond", 30, 8, (1, 1, 1))  # is cut


def setup(spark):
    flat = lambda n, w, h, v: (n, w, h, 1, [float(v)] * (w * h))
    images = spark.createDataFrame([flat("/d/a.png", 40, 30, 50), flat("/d/b.jpg", 50, 20, 90), ("/d/broken", None, None, None, None)], "path string, width int, height int, channels int, values array<float>")
    pairs = spark.createDataFrame([(1, "face", True, "/d/a.png", "/d/b.jpg", True), (2, "iris", False, "/d/a.png", "/d/broken", True), (3, "face", True, "/d/a.png", "/d/b.jpg", None), (4, None, None, None, "/x/../gone.png", False)], "pair_id long, modality string, gt boolean, file1 string, file2 string, same boolean")
    segments = spark.createDataFrame([(1, 5.0, 10.0, 20.0, 10.0, "inlier", None), (1, 5.0, 20.0, 20.0, 15.0, "outlier", None), (1, 30.0, 25.0, 30.0, 2.0, None, 0.25)], "pair_id long, x1 double, y1 double, x2 double, y2 double, kind string, confidence double")
    return pairs, images, segments


def test_figures(spark):
    rows = {r.pair_id: r for r in fg.figures(*setup(spark), least_width=90).collect()}
    assert {k: r.name for k, r in rows.items()} == {"1": "a_vs_b", "2": "a_vs_broken", "3": "a_vs_b", "4": "none_vs_gone"}
    picture = im.decode(bytes(rows["1"].content)).astype(int)
    assert picture.shape == (30 + 2 * fg.BAND, 90, 3)
    body = picture[fg.BAND : -fg.BAND]
    assert tuple(body[10, 30]) == fg.GREEN and tuple(body[28, 3]) == (50, 50, 50) and tuple(body[19, 85]) == (90, 90, 90) and tuple(body[25, 88]) == (0, 0, 0)
    x = round(5 + 0.5 * 55)
    assert any(tuple(body[y, x]) == fg.RED for y in (17, 18))
    mixed = tuple(np.rint(np.array(fg.CYAN) * 0.25 + np.array(fg.RED) * 0.75).astype(int))
    assert sum(tuple(p) == mixed for p in body.reshape(-1, 3).tolist()) > 15
    assert tuple(body[10, 5 + 3]) == fg.YELLOW
    assert (picture[: fg.BAND] == fg.LIGHT).mean() > 0.7 and (picture[: fg.BAND] == 0).any()
    green = lambda k: (im.decode(bytes(rows[k].content))[-fg.BAND :] == fg.GREEN).all(axis=2).any()
    red = lambda k: (im.decode(bytes(rows[k].content))[-fg.BAND :] == fg.RED).all(axis=2).any()
    assert green("1") and not red("1") and red("2") and not green("2") and not green("3") and not red("3")


def test_files_are_placed_by_the_commit(spark, tmp_path):
    spark.dataSource.register(fg.FigureSink)
    t = fg.figures(*setup(spark))
    root = tmp_path / "out"
    t.write.format("figures").mode("append").save(f"file://{root}")
    there = sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())
    assert len(there) == 4 and {"iris/different/a_vs_broken.png", "none/none/none_vs_gone.png", "face/same/a_vs_b.png"} < set(there)
    assert not list(root.glob("_temporary*"))
    assert all(r.width for r in im.read_images(spark, f"file://{root}").collect())
    bad = t.selectExpr("pair_id", "modality", "gt", "name", "IF(pair_id = 2, CAST(raise_error('no') AS binary), content) AS content")
    with pytest.raises(Exception, match="no"):
        bad.write.format("figures").mode("append").save(f"file://{tmp_path}/failed")
    assert not list((tmp_path / "failed").rglob("*.png"))
