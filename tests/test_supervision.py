import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.operators import supervision as sup
from tessera.plans import registry


def test_depth_between_four_cells(spark):
    depth = spark.createDataFrame([(1, y, x, float(y * 10 + x + 1)) for y in range(4) for x in range(5) if (y, x) != (2, 3)] + [(1, 2, 3, 0.0)], "image_id int, y int, x int, depth double")
    points = spark.createDataFrame([(1, 0, 1.5, 1.25), (1, 1, 2.0, 1.0), (1, 2, 0.0, 1.0), (1, 3, 2.5, 1.5), (1, 4, 3.5, 1.5)], "image_id int, kp_idx int, x double, y double")
    size = spark.createDataFrame([(1, 4, 5)], "image_id int, h int, w int")
    got = {r.kp_idx: r.z for r in sup.interpolate_depth(points, depth, size).collect()}
    assert got[0] == pytest.approx(1.25 * 10 + 1.5 + 1) and got[1] == pytest.approx(13.0)
    assert got[2] is None  # not strictly inside
    assert got[3] is not None  # the bottom right corner may lack depth
    assert got[4] is None  # the bottom left corner may not


def test_reprojection_and_correspondences(spark):
    k = geo.matrix([100, 0, 50, 0, 100, 50, 0, 0, 1])
    p = spark.createDataFrame([("a", 0, 50.0, 50.0, 2.0), ("a", 1, 70.0, 50.0, None)], "pair_id string, idx int, x double, y double, z double")
    got = {r.idx: (r.px, r.py, r.valid) for r in sup.reproject(p, k, k, geo.matrix(np.eye(3).ravel()), geo.matrix([0.1, 0, 0])).collect()}
    assert got[0] == pytest.approx((55.0, 50.0, True)) and got[1] == (sup.NOWHERE, sup.NOWHERE, False)
    side = "pair_id string, idx int, x double, y double, px double, py double"
    left = spark.createDataFrame([("a", 0, 0.0, 0.0, 10.0, 0.0), ("a", 1, 50.0, 0.0, 90.0, 0.0)], side)
    right = spark.createDataFrame([("a", 0, 10.5, 0.0, 0.0, 0.0), ("a", 1, 40.0, 0.0, 5.0, 0.0)], side)
    matches, alone_i, alone_j = sup.correspondences(left, right, 1.0, 20.0)
    assert [(r.i, r.j) for r in matches.collect()] == [(0, 0)]
    assert [r.i for r in alone_i.collect()] == [1] and [r.j for r in alone_j.collect()] == [1]


def test_grid_cells(spark):
    t = spark.createDataFrame([(2.5, 1.0), (3.5, 0.4), (-0.6, 0.0), (9.6, 0.0)], "x double, y double")
    assert [r[0] for r in t.select(sup.cell_of(F.col("x"), F.col("y"), F.lit(10), F.lit(4))).collect()] == [12, 4, 0, 0]
    there = spark.createDataFrame([("a", 1, 5), ("a", 2, 0), ("a", 3, 6)], "pair_id string, i long, j long")
    back = spark.createDataFrame([("a", 5, 1), ("a", 6, 9)], "pair_id string, j long, i long")
    assert [(r.i, r.j) for r in sup.grid_matches(there, back).collect()] == [(1, 5)]
    masked = sup.at_valid(spark.createDataFrame([(1, 0, 3.0, 4.0), (1, 1, 5.0, 6.0)], "image_id int, cell int, x double, y double"), spark.createDataFrame([(1, 0)], "image_id int, cell int"))
    assert sorted((r.x, r.y) for r in masked.collect()) == [(0.0, 0.0), (3.0, 4.0)]
    fine = sup.fine_offsets(spark.createDataFrame([(12.0, 5.0, 10.0, 4.0)], "wx double, wy double, x1 double, y1 double"), 2.0, 2).first()
    assert (fine.ox, fine.oy) == (0.5, 0.25)


def test_samples_are_filled_with_truth(spark):
    found = spark.createDataFrame([("a", i, i, 0.9) for i in range(3)], "pair_id string, i long, j long, conf double")
    truth = spark.createDataFrame([("a", 100 + i, i) for i in range(4)], "pair_id string, i long, j long")
    rows = sup.padded_samples(found, truth, 12, 2, 1).collect()
    assert len(rows) == 12 and sum(r.conf > 0 for r in rows) == 3 and {r.i for r in rows if not r.conf} == {100, 101, 102, 103}


def test_ranks_have_equal_sizes(spark):
    got = sup.rank_split(spark.range(10), 4, 1, "id").groupBy("rank").count().collect()
    assert sorted(r["count"] for r in got) == [3, 3, 3, 3]


def test_registry(spark):
    with pytest.raises(NotImplementedError):
        registry.component("matcher", "none")
    assert registry.PRESETS["classical"].with_(ratio=0.5).ratio == 0.5
    rng = np.random.default_rng(1)
    d, xy = rng.random((60, 16)), rng.uniform(0, 400, (60, 2))
    h = np.array([[0.9, 0.1, 30], [-0.05, 1.1, -20], [1e-4, -5e-5, 1]])
    q = np.column_stack([xy, np.ones(60)]) @ h.T
    schema = "pair_id string, idx long, x double, y double, score double, descriptor array<double>"
    left = [("same", i, *map(float, xy[i]), 1.0, d[i].tolist()) for i in range(60)] + [("one", 0, 1.0, 1.0, 1.0, d[0].tolist())]
    right = [("same", i, *map(float, q[i, :2] / q[i, 2]), 1.0, (d[i] + 0.001).tolist()) for i in range(60)] + [("one", 0, 1.0, 1.0, 1.0, d[0].tolist())]
    got = {r.pair_id: (r.n, r.same) for r in registry.verify(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), registry.PRESETS["seeded_graph"]).collect()}
    assert got == {"same": (60, True), "one": (0, False)}


def test_keypoints_of_a_pair_are_ranked_once_for_all_uses(spark):
    """What the matcher reads several times isn't sorted again each time: the only windows left are its own."""
    side = spark.range(40).selectExpr("id % 2 AS pair_id", "id AS idx", "id * 1.0D AS x", "id * 2.0D AS y", "1.0D AS score", "array(id * 1.0D, id * id * 1.0D, 1.0D) AS descriptor")
    found = registry.matched(side, side, registry.PRESETS["learned_detector"])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
    assert {(r.pair_id, r.i, r.j) for r in found.collect()} == {(k % 2, k, k) for k in range(40)}


def test_running_sums_over_ranges(spark):
    from tessera.operators import metrics

    rng = np.random.default_rng(4)
    rows = [(int(p), int(rng.integers(0, 5)), f"s{p}") for p in rng.permutation(500)]
    t = spark.createDataFrame(rows, "position int, n int, sequence string").repartition(7)
    want, at = {}, 0
    for p, n, s in sorted(rows):
        want |= {(s, at + k): at for k in range(n)}
        at += n
    assert {(r.sequence, r.pair_index): r.offset for r in metrics.expand_sequences(t).collect()} == want
    assert metrics.expand_sequences(t.limit(0)).count() == 0


def test_many_keypoints_of_two_places_meet_once(spark):
    """Two matches of the same two places: the best of 30 x 20 descriptors for both, copies by the smaller indices, and no plan pairs the rows."""
    import numpy as np

    from tessera.operators import supervision as sup

    rng = np.random.default_rng(17)
    rows = lambda n, x: [(1, k, float(x), 2.0, rng.integers(-1, 2, 3).astype(float).tolist()) for k in range(n)]
    a, b = rows(30, 1), rows(20, 5)
    schema = "pair_id long, idx long, x double, y double, descriptor array<double>"
    m = spark.createDataFrame([(1, 3, 4), (1, 7, 4)], "pair_id long, i long, j long")
    got = sup.best_of_same_place(m, spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    want = min((-float(np.dot(x[4], y[4])), x[1], y[1]) for x in a for y in b)[1:]
    assert [(r.i, r.j) for r in got.collect()] == [want, want]
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
