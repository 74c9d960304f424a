import numpy as np
import pytest

from tessera.functions import transforms as tr
from tessera.operators import robust

H = np.array([[0.9, 0.1, 30], [-0.05, 1.1, -20], [1e-4, -5e-5, 1]])


def planted():
    rows = []
    for i in range(200):
        x, y = (37 * i) % 640, (91 * i) % 480
        u, v, w = H @ (x, y, 1)
        u, v = u / w, v / w
        if i % 10 < 3:
            u, v = u + 60 + (13 * i) % 50, v - 70 - (29 * i) % 40
        rows.append((1, float(x), float(y), float(u), float(v)))
    return rows


SCHEMA = "pair_id long, x1 double, y1 double, x2 double, y2 double"


def test_planted_homography(spark):
    rows = planted() + [(2, 0.0, 0.0, 1.0, 1.0)] * 3 + [(3, float(i), float(i), float(i), float(i)) for i in range(8)] + [(4, None, 0.0, 0.0, 0.0)]
    got = {r.pair_id: r for r in robust.homography(spark.createDataFrame(rows, SCHEMA), 3.0).collect()}
    assert (got[1].n, got[1].inliers) == (200, 140) and got[1].ratio == pytest.approx(0.7) and got[1].error < 1e-6
    assert np.allclose(np.reshape(got[1].h, (3, 3)), H, atol=1e-6)
    assert got[2].h is None and got[3].h is None and 4 not in got
    again = robust.homography(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), 3.0).where("pair_id = 1").first()
    assert again.h == got[1].h


def two_views(n=80, seed=2):
    rng = np.random.default_rng(seed)
    k = np.array([[500, 0, 320], [0, 500, 240], [0, 0, 1.0]])
    r, t = tr.rotation_np([0.05, -0.1, 0.03]), np.array([1.0, 0.2, 0.1])
    x = rng.uniform([-2, -2, 4], [2, 2, 9], (n, 3))
    p, q = x @ k.T, (x @ r.T + t) @ k.T
    return k, r, t / np.linalg.norm(t), p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]


def test_planted_pose_and_fundamental(spark):
    k, r, t, p, q = two_views()
    q[:15] += 60
    cam = k.ravel().tolist()
    rows = [(1, *map(float, a), *map(float, b), cam, cam) for a, b in zip(p, q, strict=True)] + [(2, 0.0, 0.0, 0.0, 0.0, cam, cam)]
    table = spark.createDataFrame(rows, SCHEMA + ", k0 array<double>, k1 array<double>")
    got = {x.pair_id: x for x in robust.relative_pose(table, 1.0).collect()}
    rotation, direction = robust.pose_difference(r, t, np.reshape(got[1].rotation, (3, 3)), np.array(got[1].translation))
    assert rotation < 0.1 and direction < 0.5 and got[1].inliers >= 63
    assert got[2].rotation is None
    f = {x.pair_id: x for x in robust.fundamental(table.select("pair_id", "x1", "y1", "x2", "y2")).collect()}
    assert f[1].inliers >= 63 and f[2].f == [1.0] * 9


def test_geometric_distance_tells_matrices_apart(spark):
    _, _, _, p, q = two_views()
    f = robust.fit_fundamental(p, q)
    size = (640.0, 480.0)
    same = robust.geometric_distance(f, f, size, size, 100)
    assert same < 1e-4
    far = robust.geometric_distance(f, f + 0.2 * np.random.default_rng(1).normal(size=(3, 3)) * np.abs(f), size, size, 100)
    assert far > 10 * same
    rows = spark.createDataFrame([(1, f.ravel().tolist(), f.ravel().tolist(), list(size), list(size))], "pair_id int, f1 array<double>, f2 array<double>, size1 array<double>, size2 array<double>")
    assert robust.fundamental_distance(rows, samples=50).first().sgd < 1e-4


def test_random_homography_moves_corners():
    h = robust.random_homography(np.random.default_rng(4))
    assert np.abs(robust.homography_errors(h, np.array([[0, 0], [1, 1.0]]), np.array([[0, 0], [1, 1.0]]))).max() < 0.5


def test_few_agreeing_of_many_ask_for_most_samples():
    """A best share whose eighth power is below rounding: the number of samples has no integer, and the most are tried."""
    rng = np.random.default_rng(4)
    p, q = rng.uniform(0, 640, (4000, 2)), rng.uniform(0, 640, (4000, 2))
    one = np.array([[0, 0, 1.0], [0, 0, 0], [-1, 0, 0]])
    errors = lambda f, p, q: np.where(np.arange(len(p)) < 20, 0.0, 9.0)
    model, mask = robust.ransac(p, q, lambda p, q: one, errors, 8, 1.0, 1 - 1e-5, 7, rng)
    assert model is one and mask.sum() == 20


def test_fits_hold_no_square_of_the_points():
    """Models of 20,000 points take far less than the 3 GB and more that a square matrix of the points would."""
    import tracemalloc

    rng = np.random.default_rng(5)
    p = rng.uniform(0, 640, (20_000, 2))
    q = np.column_stack([p, np.ones(len(p))]) @ H.T
    q = q[:, :2] / q[:, 2:]
    tracemalloc.start()
    try:
        h = robust.fit_homography(p, q)
        f = robust.fit_fundamental(p, q + rng.normal(0, 1, q.shape))
        a = tr.affine_from_points(p.T, (p @ H[:2, :2].T + H[:2, 2]).T)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.allclose(h, H, atol=1e-7) and f is not None and np.allclose(a[:2], H[:2])
    assert most < 200e6
