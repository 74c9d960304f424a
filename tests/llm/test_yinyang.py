"""Yinyang clustering against plain k-means in integers."""

import hashlib

import numpy as np
import pytest

from tessera.llm import yinyang

from .helpers import rows_of


def plain(rows, k=40, rounds=5, dim=64, scale=256, seed=2):
    """(vec_id, cluster, distance) in the order of rows, and the centroids, by every distance."""
    kept = [(i, tuple(int(np.floor(float(np.float32(x)) * scale)) for x in v)) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [list(v) for _, v in sorted(kept, key=key)[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, near(v)[1], near(v)[0]) for i, v in kept], centroids


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "z") for i, v in rows], "vec_id long, embedding array<float>, cluster int, `CLUSTER_2` int, vec string")


def clumps(n, dim, centres, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(centres, dim))
    return [(i, (middles[rng.integers(centres)] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("rows,k,dim,groups", [(clumps(400, 8, 12, 1), 20, 8, 4), (clumps(300, 4, 3, 2, 0.6), 30, 4, 7), (clumps(200, 3, 5, 3), 6, 3, None), (clumps(120, 2, 4, 4, 0.004), 25, 2, 5)])
def test_equal_to_plain(spark, rows, k, dim, groups):
    want, centroids = plain(rows, k, 5, dim)
    got, found = yinyang.cluster(table(spark, rows).repartition(5), k=k, dim=dim, groups=groups)
    assert found.tolist() == centroids
    assert rows_of(got, "vec_id", "cluster", "distance") == sorted(want, key=repr)


def test_ties_copies_and_bad_rows(spark):
    same = [0.5] * 64
    grid = [(i, [float(i % 3), float(i % 2)] + [0.0] * 62) for i in range(120)]  # many equal distances
    rows = grid + [(1000 + i, same) for i in range(50)] + [(1, same), (1, same), (None, same), (None, None), (2000, []), (2001, same[:-1]), (2002, same + [1.0]), (2003, [None] * 64), (2004, [float("nan")] * 64), (2005, [float("inf")] + same[1:]), (2006, [-float("inf")] + same[1:]), (2007, [-0.001] * 64)]
    want, centroids = plain(rows)
    got, found = yinyang.cluster(table(spark, rows))
    assert found.tolist() == centroids
    assert rows_of(got, "vec_id", "cluster", "distance") == sorted(want, key=repr)


def test_digest(spark):
    rows = clumps(150, 64, 6, 5)
    want, centroids = plain(rows)
    got = {r.vec_id: r for r in yinyang.digest(table(spark, rows)).collect()}
    assert len(got) == len(want)
    for i, c, d in want:
        r = got[i]
        assert (r.cluster, r.distance, r.inertia) == (c, d, sum(x[2] for x in want))
        assert r.cluster_inertia == sum(x[2] for x in want if x[1] == c)
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()


def test_few_and_none(spark):
    got, found = yinyang.cluster(table(spark, [(1, [0.25] * 64), (2, [0.5] * 64)]))
    assert len(found) == 2 and [r[2] for r in rows_of(got, "vec_id", "cluster", "distance")] == [0, 0]
    assert yinyang.digest(table(spark, [])).count() == 0
    with pytest.raises(ValueError):
        yinyang.cluster(table(spark, []), k=0)


def test_components_that_need_more_than_a_double():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-(1 << 27), 1 << 27, (50, 64)), rng.integers(-(1 << 27), 1 << 27, (7, 64))
    assert yinyang.squared(x, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q, strict=True)) for q in c] for p in x]


def test_bounds_hold_and_save_distances():
    """After each round every bound is right, and far fewer distances than rows x centroids are worked out."""
    rng = np.random.default_rng(3)
    middles = rng.integers(-300, 300, (40, 16))
    x = (middles[rng.integers(0, 40, 3000)] + rng.integers(-40, 40, (3000, 16))).astype(np.int64)
    centroids = x[:40].copy()
    group = yinyang.groups_of(centroids, 4)
    cluster, upper, lower, _ = yinyang.first_step(x, centroids, group, 4)
    scans = []
    for _ in range(12):
        new = np.array([x[cluster == c].sum(0) // max(1, (cluster == c).sum()) if (cluster == c).any() else centroids[c] for c in range(40)])
        moved = np.sqrt(((new - centroids) ** 2).sum(1))
        centroids = new
        cluster, upper, lower, scanned = yinyang.next_step(x, cluster, upper, lower, centroids, group, moved)
        d = yinyang.squared(x, centroids)
        assert (cluster == d.argmin(1)).all()
        root = np.sqrt(d)
        assert (upper >= root[np.arange(len(x)), cluster]).all()
        root[np.arange(len(x)), cluster] = np.inf
        for g in range(4):
            assert (lower[:, g] <= root[:, group == g].min(1)).all()
        scans.append(scanned.mean())
    assert scans[-1] < 8
