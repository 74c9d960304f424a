"""The evaluation in one call against its parts."""

import numpy as np
import pytest

from tessera.plans import evaluate

K = [500.0, 0.0, 320.0, 0.0, 500.0, 240.0, 0.0, 0.0, 1.0]


def test_pairs_of_known_poses(spark):
    rng = np.random.default_rng(3)
    k, rows, truth = np.reshape(K, (3, 3)), [], []
    for pair, n in ((1, 60), (2, 60), (3, 3), (4, 0)):
        a = 0.1 * pair
        r, t = np.array([[np.cos(a), 0, np.sin(a)], [0, 1, 0], [-np.sin(a), 0, np.cos(a)]]), np.array([1.0, 0.2, 0.1])
        x = rng.uniform([-2, -2, 4], [2, 2, 9], (n, 3))
        p, q = x @ k.T, (x @ r.T + t) @ k.T
        p, q = p[:, :2] / p[:, 2:], q[:, :2] / q[:, 2:]
        if pair == 2:
            q[:15] += rng.uniform(40, 90, (15, 2)) * [0.2, 1]
        rows += [(pair, *map(float, u), *map(float, v), K, K) for u, v in zip(p, q, strict=True)]
        truth.append((pair, r.ravel().tolist(), t.tolist(), 120))
    matches = spark.createDataFrame(rows, "pair_id int, x1 double, y1 double, x2 double, y2 double, k0 array<double>, k1 array<double>")
    t = spark.createDataFrame(truth, "pair_id int, rotation array<double>, translation array<double>, keypoints int")
    got = {(r.figure, r.upto): r.value for r in evaluate.pose_evaluation(matches, t).collect()}
    assert len(got) == 14
    # two pairs are found almost exactly, two have no pose
    assert got["exact_auc", 30.0] == pytest.approx(0.5, abs=0.01) and got["exact_auc", 5.0] == pytest.approx(0.5, abs=0.06)
    assert got["approximate_auc", 5.0] == 0.5 and got["approximate_auc", 30.0] == 0.5
    near = {r.pair_id: (r.matches, r.inliers) for r in evaluate.inlier_counts(matches, t, 5e-3).collect()}
    assert near == {1: (60, 60), 2: (60, 45), 3: (3, 3)}
    assert got["precision", None] == pytest.approx(100 * (1 + 0.75 + 1 + 0) / 4) and got["match_score", None] == pytest.approx(100 * (60 + 45 + 3) / 480)
    assert evaluate.pose_evaluation(matches.limit(0), t.limit(0)).count() == 0
