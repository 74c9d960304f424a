import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import geometry as geo
from tessera.operators import assign, keypoints, knn, metrics


@pytest.mark.parametrize(("d1", "d2", "lowe", "nndr", "quotient"), [(1.0, 2.0, True, True, True), (3.0, 4.0, False, True, True), (0.85, 1.0, False, False, True), (9.0, 10.0, False, False, False), (0.0, 0.0, False, True, False), (1.0, None, False, False, False)])
def test_ratio_tests_differ_as_stated(spark, d1, d2, lowe, nndr, quotient):
    t = spark.createDataFrame([(d1, d2)], "d1 double, d2 double")
    r = t.select(knn.lowe(F.col("d1"), F.col("d2")), knn.nndr(F.col("d1"), F.col("d2")), knn.quotient(F.col("d1"), F.col("d2"))).first()
    assert tuple(r) == (lowe, nndr, quotient)


def descriptors(spark, rows):
    return spark.createDataFrame(rows, "pair_id string, idx long, descriptor array<float>")


def test_nearest_in_blocks_of_any_size(spark):
    rng = np.random.default_rng(1)
    a = [(p, i, rng.random(8).tolist()) for p in "xy" for i in range(40)] + [("z", 0, [0.0] * 8), ("x", 99, None)]
    b = [(p, j, rng.random(8).tolist()) for p in "xy" for j in range(30)] + [("w", 0, [0.0] * 8)]
    want = {}
    for p, i, u in a:
        near = sorted((round(float(np.linalg.norm(np.float32(u) .astype(float) - np.float32(v).astype(float))), 9), j) for q, j, v in b if q == p) if u else []
        for r, (d, j) in enumerate(near[:2], 1):
            want[p, i, r] = (j, d)
    for rows in (4096, 7):
        got = {(r.pair_id, r.i, r["rank"]): (r.j, round(r.d, 9)) for r in knn.nearest(descriptors(spark, a), descriptors(spark, b), 2, rows).collect()}
        assert got == want


def test_fewer_base_rows_than_neighbours(spark):
    one = descriptors(spark, [("x", 5, [1.0, 0.0])])
    r = knn.top_two(knn.nearest(one, one, 2)).first()
    assert (r.i, r.j, r.d1, r.d2) == (5, 5, 0.0, None)


def test_ties_go_to_the_smaller_index(spark):
    a, b = descriptors(spark, [("x", 0, [0.0, 0.0])]), descriptors(spark, [("x", j, [1.0, 0.0]) for j in (7, 3, 5)])
    assert [r.j for r in knn.nearest(a, b, 2).orderBy("rank").collect()] == [3, 5]


@pytest.mark.parametrize("offset", [0.0, 1e6])
@pytest.mark.parametrize("k", [1, 2, 9, 50])
def test_copies_come_in_the_order_of_their_index(spark, offset, k):
    """Tables of copies, and distances that the expanded product can't tell apart."""
    rng = np.random.default_rng(8)
    some = rng.normal(size=(6, 5)) + offset
    a = [("x", i, (some[i % 6] + rng.integers(0, 2) * 1e-5).tolist()) for i in range(30)]
    b = [("x", j, some[j % 3].tolist()) for j in range(90)] + [("x", j, (some[0] + rng.normal(size=5) * 1e-4).tolist()) for j in range(90, 130)]
    kind = "pair_id string, idx long, descriptor array<double>"
    want = {}
    for _, i, u in a:
        near = sorted((round(float(np.sqrt(((np.array(u) - np.array(v)) ** 2).sum())), 12), j) for _, j, v in b)
        want |= {(i, r): j for r, (_, j) in enumerate(near[:k], 1)}
    for rows in (4096, 16):
        got = knn.nearest(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), k, rows).collect()
        assert {(r.i, r["rank"]): r.j for r in got} == want


def test_mutual_and_ratio_tests_on_copies(spark):
    same = [0.6, 0.8]
    a = descriptors(spark, [("x", i, same) for i in range(5)] + [("x", 9, [1.0, 0.0])])
    b = descriptors(spark, [("x", 300 + j, same) for j in range(30)] + [("x", 999, [1.0, 0.1])])
    got = {r.i: (r.j, r.d1, r.d2) for r in knn.top_two(knn.nearest(a, b, 2)).collect()}
    assert all(got[i] == (300, 0.0, 0.0) for i in range(5)) and got[9][0] == 999
    assert [(r.i, r.j) for r in knn.mutual_nn(a, b, None).orderBy("i").collect()] == [(0, 300), (9, 999)]
    assert [(r.i, r.j) for r in knn.match(a, b, "nn", 0.75).collect()] == [(9, 999)]


def test_descriptors_that_are_no_numbers(spark):
    a = descriptors(spark, [("x", 0, [float("nan"), 0.0]), ("x", 1, [0.0, 0.0])])
    b = descriptors(spark, [("x", 5, [float("nan"), 0.0]), ("x", 6, [3.0, 4.0]), ("x", 7, [float("inf"), 0.0])])
    got = {(r.i, r["rank"]): r.j for r in knn.nearest(a, b, 2).collect()}
    assert got[1, 1] == 6 and set(got) == {(0, 1), (0, 2), (1, 1), (1, 2)}


def test_unknown_method(spark):
    with pytest.raises(NotImplementedError):
        knn.match(None, None, "none")


def test_suppression_equals_the_grid_form(spark):
    rng = np.random.default_rng(3)
    h = w = 24
    grid = np.where(rng.random((h, w)) < 0.3, rng.random((h, w)) + 0.1, 0.0)

    def pooled(s, r=2):
        out = np.zeros_like(s)
        for y in range(h):
            for x in range(w):
                out[y, x] = s[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1].max()
        return out

    mask = grid == pooled(grid)
    for _ in range(2):
        covered = pooled(mask & (grid > 0)) > 0
        rest = np.where(covered, 0.0, grid)
        mask = mask | ((rest == pooled(rest)) & ~covered)
    want = {(x, y) for y in range(h) for x in range(w) if mask[y, x] and grid[y, x] > 0}
    rows = [(0, y * w + x, float(x), float(y), float(grid[y, x])) for y in range(h) for x in range(w) if grid[y, x] > 0]
    kept = keypoints.nms(spark.createDataFrame(rows, "image_id int, kp_idx int, x double, y double, score double"), 2)
    assert {(int(r.x), int(r.y)) for r in kept.collect()} == want


def test_sinkhorn_reaches_its_sums(spark):
    rng = np.random.default_rng(2)
    s = spark.createDataFrame([("a", i, j, float(rng.normal())) for i in range(3) for j in range(5)], "pair_id string, i long, j long, s double")
    t = assign.masses(assign.with_dustbins(s, 0.5), own_side=False)
    assert {(r.i, r.r) for r in t.where("j = 0").collect()} == {(0, 1.0), (1, 1.0), (2, 1.0), (-1, 5.0)}
    assert t.where("i = 0 AND j < 0").first().c == 3.0
    own = assign.masses(assign.with_dustbins(s, 0.5), own_side=True)
    assert own.where("i < 0").first().r == 4.0 and own.where("j < 0").first().c == 6.0
    p = assign.sinkhorn(t, 30).groupBy("j").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(3.0 if r.j < 0 else 1.0, abs=1e-4) for r in p)
    z = assign.log_optimal_transport(s, 0.5, 30).withColumn("p", F.exp("s")).groupBy("j").agg(F.sum("p").alias("p")).collect()
    assert all(r.p == pytest.approx(3.0 if r.j < 0 else 1.0, abs=1e-4) for r in z)


def test_readout_without_matches(spark):
    z = spark.createDataFrame([("a", 0, -1, 0.0), ("a", -1, 0, 0.0), ("a", 0, 0, -9.0)], "pair_id string, i long, j long, s double")
    r = assign.readout(z, spark.createDataFrame([("a", 0), ("a", 1)], "pair_id string, i long"), 0.2).orderBy("i").collect()
    assert [(x.match, x.score) for x in r] == [(-1, 0.0), (-1, 0.0)]


def test_exact_and_approximate_auc(spark):
    t = spark.createDataFrame([(x,) for x in (1.0, 3.0, 7.0, 12.0, math.inf)], "error double")
    got = [r.auc for r in metrics.pose_auc(t, [5, 10, 20]).orderBy("threshold").collect()]
    assert got == pytest.approx([0.30, 0.45, 0.63])
    approx = [r.auc for r in metrics.approximate_auc(t, range(0, 31, 5)).orderBy("upto").collect()]
    assert approx == pytest.approx([0.4, 0.5, 0.6, 0.65, 0.68, 0.70])
    assert [r.auc for r in metrics.pose_auc(t.where("error > 99"), [5]).collect()] == [0.0]
    edge = spark.createDataFrame([(0.0,), (5.0,), (30.0,)], "error double")
    assert [round(r.auc, 6) for r in metrics.approximate_auc(edge, range(0, 31, 5)).orderBy("upto").collect()] == pytest.approx([1 / 3, 0.5, 5 / 9, 7 / 12, 0.6, 2 / 3], abs=1e-5)


def test_last_row_of_each_key_in_first_seen_order(spark):
    t = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "identifier string, position int").withColumn("value", F.col("position"))
    assert [(r.identifier, r.value) for r in metrics.keep_last(t, ["identifier"], "position").orderBy("first_seen").collect()] == [("a", 2), ("b", 1)]


def test_decisions_at_their_borders(spark):
    t = spark.createDataFrame([(0.45, 4.0), (0.4, 4.0), (0.5, 5.0), (None, None)], "ratio double, error double")
    got = t.select(*[metrics.decide(F.col("ratio"), F.col("error"), *metrics.DECISIONS[n]) for n in ("classical", "seeded_graph")]).collect()
    assert [tuple(r) for r in got] == [(True, True), (False, False), (True, False), (False, False)]


def test_unknown_data_set(spark):
    with pytest.raises(Exception, match="unknown data set"):
        spark.range(1).select(metrics.dataset_threshold(F.lit("other"))).collect()


def test_half_even_sizes(spark):
    t = spark.createDataFrame([(5.0, 2.0)], "w double, h double")
    r = t.select(*keypoints.resize_long_side(F.col("w") * 0 + 2, F.lit(1.0), 5), *keypoints.process_resize(F.col("w"), F.col("h"), [-1])).first()
    assert tuple(r) == (5, 2, 5.0, 2.0)


def test_geometry_columns_invert(spark):
    k = geo.matrix([500, 3, 320, 0, 510, 240, 0, 0, 1])
    x, y = geo.unnormalize_full(k, geo.normalize_full(k, (F.lit(12.0), F.lit(7.0))))
    assert spark.range(1).select(x, y).first() == pytest.approx((12.0, 7.0))
    assert spark.range(1).select(geo.inverse3(geo.matrix([1, 2, 3, 2, 4, 6, 1, 1, 1])).alias("m")).first().m == [None] * 9
    turned = spark.range(1).select(geo.rotate_intrinsics(k, F.lit(640), F.lit(480), F.lit(0)).alias("a"), geo.rotate_intrinsics(k, F.lit(640), F.lit(480), F.lit(3)).alias("b")).first()
    assert turned.a == turned.b


def test_sign_bits_have_every_dimension(spark):
    rng = np.random.default_rng(5)
    for n in (1, 62, 63, 64, 65, 128, 130):
        x = rng.normal(size=(20, n))
        got = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>").select("i", knn.sign_bits(F.col("v")).alias("w")).collect()
        for r in got:
            bits = [int(w) >> k & 1 for w in r.w for k in range(64)]
            assert len(r.w) == -(-n // 64) and bits == [*(x[r.i] > 0).astype(int), *[0] * (64 * len(r.w) - n)]


@pytest.mark.parametrize("iterations", [0, 1, 5])
def test_large_pairs_agree_with_small_ones(spark, monkeypatch, iterations):
    """Pairs beyond the bound go by row and column, and no exchange keeps a pair together."""
    rng = np.random.default_rng(11)
    rows = [(p, i, j, float(rng.normal())) for p, m, n in (("a", 12, 9), ("b", 4, 5)) for i in range(m) for j in range(n)]
    s = spark.createDataFrame(rows, "pair_id string, i long, j long, s double")
    filled = assign.masses(assign.with_dustbins(s, 0.4), own_side=True)
    key = lambda t: {(r.pair_id, r.i, r.j): r for r in t.collect()}
    runs = {n: f for n, f in (("p", lambda: assign.dual_softmax(s)), ("p2", lambda: assign.sinkhorn(filled, iterations)), ("s", lambda: assign.log_optimal_transport(s, 0.4, iterations)))}
    want = {n: key(f()) for n, f in runs.items()}
    monkeypatch.setattr(assign, "MOST_CELLS", 40)
    for n, f in runs.items():
        made = f()
        got = key(made)
        assert set(got) == set(want[n])
        for k, r in got.items():
            assert r[n[0]] == pytest.approx(want[n][k][n[0]], rel=1e-9, abs=1e-12)
        plan = made._jdf.queryExecution().executedPlan().toString()
        if n == "p" or iterations in (1, 5):
            assert re.search(r"hashpartitioning\(pair_id#\d+, i#", plan) and re.search(r"hashpartitioning\(pair_id#\d+, j#", plan)


def test_hash_tables_in_blocks_of_any_size(spark):
    """Also with a key that holds most rows."""
    rng = np.random.default_rng(12)
    words = lambda n: [int(v) for v in np.where(rng.random(n) < 0.6, rng.integers(0, 8, n), rng.integers(-(2**62), 2**62, n))]
    kind = "pair_id string, idx long, descriptor array<bigint>"
    a, b = [("x", i, [v]) for i, v in enumerate(words(60))] + [("x", 99, None)], [("x", j, [v]) for j, v in enumerate(words(80))]
    key = lambda v, t: tuple(v >> ((t * 11 + c * 5) % 64) & 1 for c in range(12))
    want = {}
    for _, i, u in a[:-1]:
        near = sorted((int(u[0] ^ v[0]).bit_count() if u[0] ^ v[0] >= 0 else int((u[0] ^ v[0]) & (2**64 - 1)).bit_count(), j) for _, j, v in b if any(key(u[0], t) == key(v[0], t) for t in range(6)))
        want |= {(i, r): (j, d) for r, (d, j) in enumerate(near[:3], 1)}
    for rows in (4096, 7):
        got = knn.hamming_lsh(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 3, block_rows=rows).collect()
        assert {(r.i, r["rank"]): (r.j, r.d) for r in got} == want


@pytest.mark.parametrize("block", [3, 2_048])
def test_assignment_from_descriptors_equals_that_from_scores(spark, monkeypatch, block):
    """In blocks of any size, with pairs that lack a side; nothing is stored that has a row for a pair of keypoints."""
    from tessera.operators import assign_descriptors as blocks

    rng = np.random.default_rng(12)
    side = lambda sizes: [(p, k, rng.normal(size=4).tolist()) for p, n in sizes for k in range(n)]
    a, b = side([("a", 12), ("b", 4), ("c", 3)]), side([("a", 9), ("b", 5), ("d", 2)])
    rows = [(p, i, j, 2.0 * float(np.dot(x, y))) for p, i, x in a for q, j, y in b if p == q]
    s = spark.createDataFrame(rows, "pair_id string, i long, j long, s double")
    left, right = (spark.createDataFrame(t, "pair_id string, idx long, descriptor array<double>") for t in (a, b))
    key = lambda t, c: {(r.pair_id, r.i, r.j): r[c] for r in t.collect()}
    filled = assign.masses(assign.with_dustbins(s, 0.4), own_side=True)
    z = assign.log_optimal_transport(s, 0.4, 3)
    want = [key(assign.dual_softmax(s).where("p > 0.01"), "p"), key(assign.sinkhorn(filled, 3), "p"), key(z, "s"), key(assign.log_optimal_transport(s, 0.4, 0), "s"), key(z.withColumn("p", F.exp("s")).where("i >= 0 AND j >= 0 AND p > 0.05"), "p")]
    kept = {(r.pair_id, r.i, r.j) for r in assign.without_dustbin_winners(z.withColumnRenamed("s", "p")).collect()}
    monkeypatch.setattr(blocks, "BLOCK_ROWS", block)
    sizes = []
    store = blocks.stored
    monkeypatch.setattr(blocks, "stored", lambda t, n: (made := store(t, n), sizes.append((n, made.count())))[0])
    t = blocks.Transport(left, right, 2.0, 0.4, 3)
    got = [key(blocks.dual_softmax(left, right, 2.0, 0.01), "p"), key(blocks.sinkhorn(left, right, 2.0, 0.4, 3), "p"), key(t.cells(), "s"), key(blocks.Transport(left, right, 2.0, 0.4, 0).cells(), "s"), key(t.cells(0.05), "p")]
    for one, other in zip(got, want, strict=True):
        assert one == pytest.approx(other, rel=1e-9, abs=1e-12)
    assert {(r.pair_id, r.i, r.j) for r in t.without_dustbin_winners().collect()} == kept
    assert all(n <= 18 for name, n in sizes if name != "above")


def test_copies_are_compared_once():
    """Thousands of rows of nine values: the nearest by brute force, without all the ties held at once."""
    import tracemalloc

    rng = np.random.default_rng(13)
    a, b = (rng.integers(-1, 2, (3_000, 2)).astype(float) for _ in range(2))
    tracemalloc.start()
    try:
        near, d = knn._best(a, b, 3)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    far = np.sqrt(((a[:200, None] - b[None]) ** 2).sum(axis=2))
    want = np.argsort(far, axis=1, kind="stable")[:, :3]
    assert (near[:200] == want).all() and np.allclose(d[:200], np.take_along_axis(far, want, axis=1))
    assert most < 20e6


def test_neighbours_come_in_bounded_parts(monkeypatch):
    rng = np.random.default_rng(14)
    x, y = rng.integers(0, 40, (2, 300)).astype(float)
    monkeypatch.setattr(keypoints, "PAIRS", 500)
    parts = list(keypoints._neighbours(x, y, 5))
    got = sorted(p for a, b in parts for p in zip(a.tolist(), b.tolist(), strict=True))
    assert got == [(i, j) for i in range(300) for j in range(300) if i != j and abs(x[i] - x[j]) <= 5 and abs(y[i] - y[j]) <= 5]
    assert max(len(a) for a, _ in parts) <= 500


def test_seeds_in_blocks_of_any_size(spark, monkeypatch):
    """Against all matches with all, with matches of one place; no group of an exchange has all of a pair."""
    rng = np.random.default_rng(16)
    rows = [(p, i, i, *map(float, rng.integers(0, 60, 4)), float(rng.integers(1, 9)), bool(rng.random() < 0.8)) for p, n in ((1, 90), (2, 1)) for i in range(n)]
    t = spark.createDataFrame(rows, "pair_id long, i long, j long, x1 double, y1 double, x2 double, y2 double, score double, mutual boolean")
    want = []
    for p in (1, 2):
        own = [r for r in rows if r[0] == p]
        at, s = np.array([r[3:7] for r in own]), np.array([r[7] if r[8] else -1.0 for r in own])
        d = [np.hypot(*(at[:, None, c : c + 2] - at[None, :, c : c + 2]).transpose(2, 0, 1)) for c in (0, 2)]
        weak = ((s[:, None] < s[None]) & ~((d[0] >= 0.3 * d[0].mean()) & (d[1] >= 0.3 * d[1].mean()))).any(axis=1)
        s = np.where(weak | (s < 1.5), -1.0, s)
        best = np.lexsort((np.arange(len(s)), -s))[: min(int((s > 0).sum()) + 2, 10)]
        want += [(p, k + 1, int(i), int(i), s[i]) for k, i in enumerate(best)]
    groups, met = [], keypoints._cogrouped
    monkeypatch.setattr(keypoints, "PLACES", 20)
    monkeypatch.setattr(keypoints, "_cogrouped", lambda left, right, keys, *more: groups.append(left.groupBy(*keys).count().agg(F.max("count")).first()[0]) or met(left, right, keys, *more))
    assert sorted(tuple(r) for r in keypoints.seeds(t, 10, 1.5, 0.3).collect()) == sorted(want)
    assert len(groups) == 2 and max(groups) < 45


@pytest.mark.parametrize("query_rows,blocks,most", [(256, 24, 65_536), (7, 3, 65_536), (7, 3, 25)])
def test_rows_that_look_into_many_cells_move_once_for_each_block(spark, monkeypatch, query_rows, blocks, most):
    """With all cells that the rows need, the neighbours of nearest; no row moves once for each of its cells."""
    rng = np.random.default_rng(21)
    kind = "pair_id string, idx long, descriptor array<double>"
    side = lambda n: [("x", i, rng.integers(-3, 4, 5).astype(float).tolist()) for i in range(n)]
    a, b = spark.createDataFrame(side(50), kind), spark.createDataFrame([*side(60), ("y", 3, [0.0] * 5)], kind)
    want = {(r.i, r["rank"]): (r.j, r.d) for r in knn.nearest(a, b, 3).collect()}
    moved, met = [], knn._cogrouped
    monkeypatch.setattr(knn, "_cogrouped", lambda left, right, *more: moved.append((left.count(), right.where("pair_id = 'x'").count())) or met(left, right, *more))
    for name, value in (("QUERY_ROWS", query_rows), ("QUERY_BLOCKS", blocks), ("MOST_ROWS", most)):
        monkeypatch.setattr(knn, name, value)
    for cells in (1, 9):
        got = knn.approximate(a, b, 3, cells, recall=1.0).collect()
        assert {(r.i, r["rank"]): (r.j, r.d) for r in got} == want
    rows, columns = max(-(-50 // max(query_rows, most)), min(-(-50 // query_rows), blocks)), -(-60 // most)
    assert moved == [(50 * columns, 60 * rows)] * 2


def test_large_sides_have_larger_blocks(spark, monkeypatch):
    """A side of 40 rows in blocks of two moves as often as there may be blocks, not once for each two rows of the other side."""
    rng = np.random.default_rng(22)
    t = descriptors(spark, [("x", i, rng.normal(size=2).tolist()) for i in range(40)])
    want = knn.nearest(t, t, 2).orderBy("i", "rank").collect()
    moved, met = [], knn._cogrouped
    monkeypatch.setattr(knn, "_cogrouped", lambda left, *more: moved.append(left.count()) or met(left, *more))
    assert knn.nearest(t, t, 2, 2).orderBy("i", "rank").collect() == want
    monkeypatch.setattr(knn, "MOST_ROWS", 3)
    assert knn.nearest(t, t, 2, 2).orderBy("i", "rank").collect() == want
    assert moved == [40 * 12, 40 * 14]


def test_blocks_grow_before_they_become_more(spark):
    """A row of a large side moves four times, and numbers are rounded as SQL has it."""
    from tessera.operators import assign_descriptors as blocks

    sizes = spark.createDataFrame([(0, 30_000, 3_000), (1, 300_000, 10)], "pair_id int, m long, n long")
    t = spark.createDataFrame([(0, 5, [1.0], 0.0), (1, 6, [1.0], 0.0)], "pair_id int, idx long, descriptor array<double>, w double")
    moved = lambda own, other: {r.pair_id: r["count"] for r in blocks._blocks(t, sizes, own, other).groupBy("pair_id").count().collect()}
    assert moved("m", "n") == {0: 2, 1: 1} and moved("n", "m") == {0: 4, 1: 5}
    assert blocks._rounded(np.array([0.5, 1.5, -2.5, 0.49999999999999994, -1e-9]), 0).tolist() == [1, 2, -3, 0, 0]
