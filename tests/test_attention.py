"""Attention, cell scores, tiles and the grid join against dense forms."""

import numpy as np
import pytest

from tessera.operators import attention, keypoints
from tessera.operators import supervision as sup

RNG = np.random.default_rng(9)


def tables(spark, sets, heads, d, e):
    q, k = [], []
    for s, n, m in sets:
        q += [(s, i, RNG.normal(size=heads * d).tolist(), "x") for i in range(n)]
        k += [(s, j, RNG.normal(size=heads * d).tolist(), RNG.normal(size=heads * e).tolist(), 1) for j in range(m)]
    q += [("a", 900, None, "x")]
    k += [("a", 900, None, [0.0] * heads * e, 1), ("a", 901, [0.0] * heads * d, None, 1), ("other", 0, [1.0] * heads * d, [1.0] * heads * e, 1)]
    return spark.createDataFrame(q, "set_id string, i long, q array<double>, n string"), spark.createDataFrame(k, "set_id string, j long, k array<double>, v array<double>, copy int"), q, k


def dense(q, k, heads, weigh):
    out = {}
    for s, i, x, _ in q:
        mine = [(y, v) for t, _, y, v, _ in k if t == s and y is not None and v is not None]
        if x is None:
            continue
        out[s, i] = None
        if mine:
            y, v = (np.array([m[c] for m in mine]).reshape(len(mine), heads, -1) for c in (0, 1))
            w = weigh(np.reshape(x, (heads, -1)), y)
            out[s, i] = np.einsum("mh,mhe->he", w, v).ravel()
    return out


def phi(x):
    return np.where(x > 0, x + 1, np.exp(np.minimum(x, 0)))


@pytest.mark.parametrize("heads", [1, 3])
def test_attention_equals_the_dense_form(spark, heads):
    q, k, ql, kl = tables(spark, [("a", 40, 30), ("b", 3, 50), (None, 4, 4), ("empty", 5, 0)], heads, 4, 2)

    def lin(x, y):
        s = np.einsum("hd,mhd->mh", phi(x), phi(y))
        return s / (s.sum(0) + 1e-6)

    def soft(x, y):
        s = np.einsum("hd,mhd->mh", x, y) / 2
        e = np.exp(s - s.max(0))
        return e / e.sum(0)

    for make, weigh in ((lambda: attention.linear(q.repartition(3), k.repartition(4), heads), lin), (lambda: attention.softmax(q, k, heads, 7), soft), (lambda: attention.softmax(q, k, heads), soft)):
        rows = {(r.set_id, r.i): r.out for r in make().collect()}
        want = dense(ql, [(*r[:2], *r[2:]) for r in kl], heads, weigh)
        for key, v in want.items():
            if key[0] is None:
                continue  # a null set meets nothing
            assert (rows[key] is None) if v is None else np.allclose(rows[key], v, atol=1e-9), key
    assert attention.linear(q.limit(0), k).count() == 0 and attention.softmax(q, k.limit(0)).where("out IS NOT NULL").count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 2, 3])
@pytest.mark.parametrize("tile", [7.0, 40.0, 1000.0])
def test_tiles_keep_what_the_whole_keeps(spark, rounds, tile):
    n = 500
    rows = [(k % 2, k, float(x), float(y), float(s)) for k, (x, y, s) in enumerate(zip(RNG.integers(-30, 60, n), RNG.integers(0, 60, n), RNG.integers(1, 40, n), strict=True))]
    t = spark.createDataFrame(rows, "image_id int, kp_idx int, x double, y double, score double")
    ids = lambda f: sorted((r.image_id, r.kp_idx) for r in f.collect())
    assert ids(keypoints.nms_tiled(t, 3, rounds, tile)) == ids(keypoints.nms(t, 3, rounds))


def test_cell_scores(spark):
    rows = [(1, 2, 3, [0.0] * 5), (1, 0, 0, [1000.0, 0.0, 0.0, 0.0, 1000.0]), (1, 0, 1, [1.0] * 4), (1, 0, 2, None), (1, 0, 3, [None, 1.0, 1.0, 1.0, 1.0])]
    t = spark.createDataFrame(rows, "image_id int, cy int, cx int, scores array<double>")
    got = {(r.y, r.x): r.p for r in keypoints.cell_scores(t, 2).collect()}
    assert got == {(4, 6): 0.2, (4, 7): 0.2, (5, 6): 0.2, (5, 7): 0.2, (0, 0): 0.5, (0, 1): 0.0, (1, 0): 0.0, (1, 1): 0.0}


@pytest.mark.parametrize("near,far", [(3.0, 5.0), (4.0, 1.5), (1.0, 0.0)])
def test_correspondences_equal_all_pairs(spark, near, far):
    def side(n, m):
        out = []
        for i in range(n):
            x, y = RNG.integers(0, 25, 2)
            px, py = (x + RNG.integers(-2, 3), y + RNG.integers(-2, 3)) if i % 5 else (1e5, 1e5)
            out.append((i % m, i, float(x), float(y), float(px), float(py)))
        return [*out, (77 if m == 2 else 88, 1, 0.0, 0.0, 0.0, 0.0)]

    a, b = side(80, 2), side(70, 2)
    b[-1] = (88, 1, 0.0, 0.0, 0.0, 0.0)
    d = {(p, i, j): max(np.hypot(ax - u, ay - v), np.hypot(bx - x, by - y)) for p, i, x, y, ax, ay in a for q, j, u, v, bx, by in b if p == q}
    best_i = {(p, i): min((v, j) for (q, k, j), v in d.items() if (q, k) == (p, i)) for p, i, _ in d}
    best_j = {(p, j): min((v, i) for (q, i, k), v in d.items() if (q, k) == (p, j)) for p, _, j in d}
    kind = "pair_id int, idx long, x double, y double, px double, py double"
    m, u, v = sup.correspondences(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), near, far)
    assert sorted((r.pair_id, r.i, r.j, r.d) for r in m.collect()) == sorted((p, i, j, w) for (p, i), (w, j) in best_i.items() if best_j[p, j][1] == i and w < near)
    assert sorted((r.pair_id, r.i) for r in u.collect()) == sorted(k for k, (w, _) in best_i.items() if w > far)
    assert sorted((r.pair_id, r.j) for r in v.collect()) == sorted(k for k, (w, _) in best_j.items() if w > far)


def test_small_blocks_move_rows_once_for_each_tile(spark, monkeypatch):
    """Blocks of two rows in tiles of 40: the same attention, and a row is there once; tiles of seven merge to the same."""
    from tessera.operators import attention

    rng = np.random.default_rng(15)
    q = spark.createDataFrame([(1, i, rng.normal(size=4).tolist()) for i in range(30)], "set_id long, i long, q array<double>")
    k = spark.createDataFrame([(1, j, (30 * rng.normal(size=4)).tolist(), rng.normal(size=2).tolist()) for j in range(25)], "set_id long, j long, k array<double>, v array<double>")
    moved, met = [], attention._cogrouped
    monkeypatch.setattr(attention, "_cogrouped", lambda left, *more: moved.append(left.count()) or met(left, *more))
    out = []
    for tile, block in ((40, 2), (7, 3), (40, 64)):
        monkeypatch.setattr(attention, "TILE_ROWS", tile)
        out.append(np.array([r.out for r in attention.softmax(q, k, 2, block).orderBy("i").collect()]))
    assert moved == [30, 4 * 30, 30]
    assert np.allclose(out[0], out[2]) and np.allclose(out[1], out[2])


def test_keypoints_of_one_place_meet_once(spark, monkeypatch):
    """Hundreds of keypoints on a few places: the partners by all pairs, while only places are paired."""
    side = lambda n, start: [(i % 2, start + i, float(i * 7 % 3), float(i * 5 % 2), float(i * 7 % 3) + (i % 4 == 0), float(i * 5 % 2)) for i in range(n)]
    a, b = side(240, 0), side(180, 1000)
    d = {(p, i, j): max(np.hypot(ax - u, ay - v), np.hypot(bx - x, by - y)) for p, i, x, y, ax, ay in a for q, j, u, v, bx, by in b if p == q}
    best_i, best_j = {}, {}
    for (p, i, j), w in d.items():
        best_i[p, i], best_j[p, j] = min(best_i.get((p, i), (9.0, 0)), (w, j)), min(best_j.get((p, j), (9.0, 0)), (w, i))
    sizes, near = [], sup._near_places
    monkeypatch.setattr(sup, "_near_places", lambda *x: (made := near(*x), sizes.append(made.count()))[0])
    kind = "pair_id int, idx long, x double, y double, px double, py double"
    m, u, v = sup.correspondences(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), 3.0, 0.5)
    assert sorted((r.pair_id, r.i, r.j, r.d) for r in m.collect()) == sorted((p, i, j, w) for (p, i), (w, j) in best_i.items() if best_j[p, j][1] == i)
    assert sorted((r.pair_id, r.i) for r in u.collect()) == sorted(k for k, (w, _) in best_i.items() if w > 0.5)
    assert sorted((r.pair_id, r.j) for r in v.collect()) == sorted(k for k, (w, _) in best_j.items() if w > 0.5)
    places = lambda t: len({(x[0], *x[2:]) for x in t})
    assert sizes[0] <= places(a) * places(b) < len(d) / 50
