"""Robust estimation of each image pair, as grouped Arrow functions.

A pair's correspondences are gathered in one task: they are bounded by the
keypoints of two images.  Rows are put in order and the random numbers are
seeded by the pair, so results don't depend on how rows arrive.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions.transforms import affine_from_points, superimposition_matrix
from ..shared import dealt


def _norm(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points around their mean at mean distance sqrt 2, and the matrix that puts them there."""
    c = p.mean(axis=0)
    s = np.sqrt(2) / max(np.sqrt(((p - c) ** 2).sum(axis=1)).mean(), 1e-12)
    return (p - c) * s, np.array([[s, 0, -s * c[0]], [0, s, -s * c[1]], [0, 0, 1]])


def _hom(p: np.ndarray) -> np.ndarray:
    return np.column_stack([p, np.ones(len(p))])


def right_singular(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and all right singular vectors; of many rows only their triangular factor is decomposed, so no square of the rows is held."""
    return np.linalg.svd(np.linalg.qr(m, mode="r") if len(m) > m.shape[1] else m)[1:]


def fit_homography(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Normalised direct linear transform of four points or more."""
    (a, ta), (b, tb) = _norm(p), _norm(q)
    z, o = np.zeros((len(a), 3)), _hom(a)
    m = np.vstack([np.hstack([o, z, -b[:, :1] * o]), np.hstack([z, o, -b[:, 1:] * o])])
    s, vh = right_singular(m)
    if s[7] < 1e-9 * s[0]:
        return None
    h = np.linalg.inv(tb) @ vh[-1].reshape(3, 3) @ ta
    return h / h[2, 2] if abs(h[2, 2]) > 1e-12 else None


def homography_errors(h: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    r = _hom(p) @ h.T
    with np.errstate(all="ignore"):
        d = np.sqrt(((r[:, :2] / r[:, 2:] - q) ** 2).sum(axis=1))
    return np.where(np.isfinite(d), d, np.inf)


def fit_fundamental(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Normalised eight-point algorithm, rank two."""
    (a, ta), (b, tb) = _norm(p), _norm(q)
    m = (_hom(b)[:, :, None] * _hom(a)[:, None, :]).reshape(len(a), 9)
    u, s, vh = np.linalg.svd(right_singular(m)[1][-1].reshape(3, 3))
    f = tb.T @ (u @ np.diag([s[0], s[1], 0]) @ vh) @ ta
    n = np.linalg.norm(f)
    return f / n if n > 1e-12 else None


def sampson_errors(f: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances, to first order, from points that meet the epipolar constraint."""
    a, b = _hom(p) @ f.T, _hom(q) @ f
    with np.errstate(all="ignore"):
        d = np.abs((_hom(q) * a).sum(axis=1)) / np.sqrt(a[:, 0] ** 2 + a[:, 1] ** 2 + b[:, 0] ** 2 + b[:, 1] ** 2)
    return np.where(np.isfinite(d), d, np.inf)


def ransac(p: np.ndarray, q: np.ndarray, fit: Callable, errors: Callable, sample: int, threshold: float, confidence: float, most: int, rng: np.random.Generator, minimal: Callable | None = None) -> tuple[np.ndarray | None, np.ndarray]:
    """Model and inliers of the best sample, refitted to its inliers while that keeps more.

    ``minimal``: all models of a sample, where ``fit`` needs more points.
    """
    n, best, mask, need, tried = len(p), None, np.zeros(len(p), bool), most, 0
    while tried < min(need, most):
        tried += 1
        at = rng.choice(n, sample, replace=False)
        for model in minimal(p[at], q[at]) if minimal else [fit(p[at], q[at])]:
            if model is None:
                continue
            own = errors(model, p, q) < threshold
            if own.sum() > mask.sum():
                best, mask = model, own
                share = min(1 - 1e-9, mask.mean() ** sample)
                tries = np.log(max(1e-12, 1 - confidence)) / np.log1p(-share) if share > 0 else most
                need = math.ceil(min(tries, most))  # a share below rounding asks for more than any integer
    for _ in range(5):
        if best is None or mask.sum() < (8 if minimal else sample):
            break
        model = fit(p[mask], q[mask])
        own = errors(model, p, q) < threshold if model is not None else mask & False
        if own.sum() < mask.sum() or (own == mask).all():
            best = model if own.sum() >= mask.sum() else best
            break
        best, mask = model, own
    return best, mask


def decompose_essential(e: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotation, unit translation, and which points lie before both cameras, of the choice with most of them."""
    u, _, vh = np.linalg.svd(e)
    u, vh = u * np.sign(np.linalg.det(u)), vh * np.sign(np.linalg.det(vh))
    w, best = np.array([[0, -1, 0], [1, 0, 0], [0, 0, 1.0]]), None
    for r in (u @ w @ vh, u @ w.T @ vh):
        for t in (u[:, 2], -u[:, 2]):
            x, y = _hom(p), _hom(q)
            rx = x @ r.T
            # depths d0, d1 with d1 y = d0 r x + t, by least squares of each point
            a = np.stack([rx, -y], axis=2)
            g = np.linalg.pinv(a) @ -t
            front = (g[:, 0] > 0) & (g[:, 1] > 0) & (g[:, 0] < 50 * 1e6)
            if best is None or front.sum() > best[2].sum():
                best = (r, t, front)
    return best


def _grouped(matches: DataFrame, key: str, schema: str, estimate: Callable[[np.ndarray, np.ndarray, dict, np.random.Generator], dict], extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each pair: estimate(points, points, first row, random numbers)."""
    kind = matches.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("x1", "y1", "x2", "y2")])
        at = np.column_stack([table[c].to_numpy().astype(float) for c in ("x1", "y1", "x2", "y2")])
        first = table.slice(0, 1).to_pylist()[0]
        got = estimate(at[:, :2], at[:, 2:], first, np.random.default_rng(zlib.crc32(repr(first[key]).encode())))
        types = {"array<double>": pa.list_(pa.float64()), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
        return pa.table([pa.array([first[key]], table.schema.field(key).type), *[pa.array([got.get(n)], types[x.split()[1]]) for n, x in zip(names, schema.split(", "), strict=True)]], names=[key, *names])

    usable = matches.dropna(subset=["x1", "y1", "x2", "y2"]).select(key, "x1", "y1", "x2", "y2", *extra)
    return usable.groupBy(key).applyInArrow(run, f"{key} {kind}, {schema}")


#: Inlier threshold and most samples, by pipeline.
HOMOGRAPHY = {"classical": (5.0, 2000), "learned_detector": (7.0, 50000), "dense": (5.0, 2000), "sparse_graph": (5.0, 2000), "seeded_graph": (3.0, 2000), "coarse_to_fine": (5.0, 2000)}


def homography(matches: DataFrame, threshold: float = 5.0, most: int = 2000, confidence: float = 0.995, key: str = "pair_id") -> DataFrame:
    """(key, h array, n, inliers, ratio, error) from (key, x1, y1, x2, y2): fewer than four matches give no h and nulls.

    error: the mean reprojection error of the inliers.
    """

    def estimate(p, q, _, rng):
        h, mask = ransac(p, q, fit_homography, homography_errors, 4, threshold, confidence, most, rng) if len(p) >= 4 else (None, None)
        if h is None:
            return {"n": len(p)}
        return {"h": h.ravel().tolist(), "n": len(p), "inliers": int(mask.sum()), "ratio": float(mask.mean()), "error": float(homography_errors(h, p, q)[mask].mean()) if mask.any() else None}

    return _grouped(matches, key, "h array<double>, n int, inliers int, ratio double, error double", estimate)


def fundamental(matches: DataFrame, threshold: float = 1.0, most: int = 2000, confidence: float = 1 - 1e-5, key: str = "pair_id") -> DataFrame:
    """(key, f array, n, inliers): fewer than eight matches, or none that agree, give a matrix of ones and no inliers."""

    def estimate(p, q, _, rng):
        f, mask = ransac(p, q, fit_fundamental, sampson_errors, 8, threshold, confidence, most, rng) if len(p) >= 8 else (None, None)
        return {"f": (np.ones(9) if f is None else f.ravel()).tolist(), "n": len(p), "inliers": 0 if f is None else int(mask.sum())}

    return _grouped(matches, key, "f array<double>, n int, inliers int", estimate)


def fit_essential(p: np.ndarray, q: np.ndarray) -> np.ndarray | None:
    """Of eight points or more: the eight-point fit, with equal singular values."""
    f = fit_fundamental(p, q)
    if f is None:
        return None
    u, _, vh = np.linalg.svd(f)
    return u @ np.diag([1.0, 1.0, 0.0]) @ vh


#: Powers of (x, y, z) up to degree three, those of degree three first.
_POWERS = sorted(((a, b, c) for a in range(4) for b in range(4 - a) for c in range(4 - a - b)), key=lambda m: (-sum(m), [-v for v in m]))
_PLACE = {m: k for k, m in enumerate(_POWERS)}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials, held as cubes of coefficients by powers."""
    out = np.zeros((4, 4, 4))
    for i, j, k in np.argwhere(a):
        for u, v, w in np.argwhere(b):
            out[i + u, j + v, k + w] += a[i, j, k] * b[u, v, w]
    return out


def five_points(p: np.ndarray, q: np.ndarray) -> list[np.ndarray]:
    """All essential matrices of five correspondences in camera coordinates, up to ten.

    The matrices that meet the five constraints are x A + y B + z C + D; the
    cubic equations of an essential matrix, its determinant and its trace
    condition, are reduced to a multiplication by x in the ring of what is left,
    whose eigenvectors hold the solutions.
    """
    m = (_hom(q)[:, :, None] * _hom(p)[:, None, :]).reshape(len(p), 9)
    basis = np.linalg.svd(m)[2][-4:].reshape(4, 3, 3)
    e = np.zeros((3, 3, 4, 4, 4))
    for k, at in enumerate(((1, 0, 0), (0, 1, 0), (0, 0, 1), (0, 0, 0))):
        e[:, :, *at] = basis[k]
    times = lambda a, b: sum(_product(x, y) for x, y in zip(a, b, strict=True))
    square = [[times(e[r], e[c]) for c in range(3)] for r in range(3)]
    trace = square[0][0] + square[1][1] + square[2][2]
    rows = [2 * times(square[r], e[:, c]) - _product(trace, e[r, c]) for r in range(3) for c in range(3)]
    minor = lambda a, b: _product(e[1, a], e[2, b]) - _product(e[1, b], e[2, a])
    rows.append(times(e[0], [minor(1, 2), minor(2, 0), minor(0, 1)]))
    system = np.array([[r[at] for at in _POWERS] for r in rows])
    try:
        reduced = np.linalg.solve(system[:, :10], system[:, 10:])
    except np.linalg.LinAlgError:
        return []
    action = np.zeros((10, 10))
    for k, (a, b, c) in enumerate(_POWERS[10:]):
        to = _PLACE[a + 1, b, c]
        if to < 10:
            action[k] = -reduced[to]
        else:
            action[k, to - 10] = 1
    values, vectors = np.linalg.eig(action)
    out = []
    for k in np.flatnonzero((np.abs(values.imag) < 1e-9 * (1 + np.abs(values.real))) & (np.abs(vectors[-1]) > 1e-12)):
        own = (vectors[:, k] / vectors[-1, k]).real
        x, y, z = (own[_PLACE[at] - 10] for at in ((1, 0, 0), (0, 1, 0), (0, 0, 1)))
        one = x * basis[0] + y * basis[1] + z * basis[2] + basis[3]
        out.append(one / np.linalg.norm(one))
    return out


def relative_pose(matches: DataFrame, threshold: float = 1.0, most: int = 1000, confidence: float = 0.99999, identity_fallback: bool = False, key: str = "pair_id") -> DataFrame:
    """(key, rotation, translation array, inliers) from (key, x1, y1, x2, y2, k0, k1 arrays).

    Points are normalised by the cameras, the threshold by the mean focal
    length; samples of five points give the essential matrices that are tried.
    Fewer than five matches give nulls, or the identity if asked for.
    """

    def estimate(p, q, first, rng):
        k0, k1 = (np.array(first[k], float).reshape(3, 3) for k in ("k0", "k1"))
        norm = lambda x, k: (x - k[[0, 1], [2, 2]]) / k[[0, 1], [0, 1]]
        a, b = norm(p, k0), norm(q, k1)
        e, mask = (None, None)
        if len(p) >= 5:
            e, mask = ransac(a, b, fit_essential, sampson_errors, 5, threshold / np.mean([k0[0, 0], k1[1, 1], k0[0, 0], k1[1, 1]]), confidence, most, rng, five_points)
        if e is None or mask.sum() < 5:
            return {"rotation": np.eye(3).ravel().tolist(), "translation": [0.0, 0.0, 0.0], "inliers": 0} if identity_fallback else {}
        r, t, front = decompose_essential(e, a[mask], b[mask])
        return {"rotation": r.ravel().tolist(), "translation": t.tolist(), "inliers": int(front.sum())}

    return _grouped(matches, key, "rotation array<double>, translation array<double>, inliers int", estimate, ("k0", "k1"))


def pose_errors(poses: DataFrame, truth: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, r_err, t_err) in degrees of estimated poses (key, rotation, translation) against truth (key, rotation, translation).

    A pair without an estimate has infinite errors.
    """
    t = truth.select(key, F.col("rotation").alias("r1"), F.col("translation").alias("t1")).join(poses.select(key, F.col("rotation").alias("r2"), F.col("translation").alias("t2")), key, "left")
    parts = lambda c: [F.col(c)[k] for k in range(3)]
    lost = F.lit(float("inf"))
    return t.select(key, F.when(F.col("r2").isNull(), lost).otherwise(geo.rotation_error(F.col("r2"), F.col("r1"))).alias("r_err"), F.when(F.col("t2").isNull(), lost).otherwise(geo.translation_error(parts("t2"), parts("t1"))).alias("t_err"))


def with_inliers(matches: DataFrame, models: DataFrame, threshold: float, key: str = "pair_id") -> DataFrame:
    """matches with ``inlier``, by the reprojection error of the pair's homography (key, h); null where it has none."""
    own = matches.join(models.select(key, F.col("h").alias("model")), key, "left")
    d = geo.reprojection_error(F.col("model"), (F.col("x1"), F.col("y1")), (F.col("x2"), F.col("y2")))
    return own.withColumn("inlier", F.when(F.col("model").isNotNull(), F.coalesce(d < threshold, F.lit(False)))).drop("model")


def affine(matches: DataFrame, shear: bool = True, scale: bool = True, usesvd: bool = True, key: str = "pair_id") -> DataFrame:
    """(key, m array): least squares registration of each pair's points; null with fewer than three."""

    def estimate(p, q, _, rng):
        return {"m": affine_from_points(p.T, q.T, shear, scale, usesvd).ravel().tolist()} if len(p) >= 3 else {}

    return _grouped(matches, key, "m array<double>", estimate)


def _on_lines(lines: np.ndarray, size: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A point of each line inside an image, at a share of the way through it, and which lines cross the image.

    A line runs from its point nearest to the origin along its direction; each
    coordinate is inside for a range of the way, and the image for what the
    ranges have in common.
    """
    normal = lines[:, :2]
    square = np.maximum((normal**2).sum(axis=1), 1e-300)
    foot, ahead = -normal * (lines[:, 2] / square)[:, None], np.column_stack([-lines[:, 1], lines[:, 0]]) / np.sqrt(square)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        ends = np.sort(np.stack([-foot / ahead, (size - 1 - foot) / ahead]), axis=0)
    level = np.abs(ahead) < 1e-12  # along a side: inside all the way, or nowhere
    inside = (foot >= 0) & (foot <= size - 1)
    ends[0] = np.where(level, np.where(inside, -np.inf, np.inf), ends[0])
    ends[1] = np.where(level, np.where(inside, np.inf, -np.inf), ends[1])
    start, end = ends[0].max(axis=1), ends[1].min(axis=1)
    crosses = np.isfinite(start) & np.isfinite(end) & (start < end)
    way = np.where(crosses, start + share * (end - start), 0.0)
    return foot + ahead * way[:, None], crosses


def _gap(lines: np.ndarray, points: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Distances from lines, in image diagonals."""
    return np.abs((lines * _hom(points)).sum(axis=1)) / (np.hypot(lines[:, 0], lines[:, 1]) + 1e-8) / np.linalg.norm(size)


def geometric_distance(f1: np.ndarray, f2: np.ndarray, size1: np.ndarray, size2: np.ndarray, samples: int = 1000, seed: int = 1234) -> float:
    """Mean normalised distance between the epipolar geometries of two matrices; 1 if no point can be drawn.

    A point of the first image and one on its line by one matrix are a pair,
    whose distances to each other's lines by the other matrix are averaged,
    both ways.  All tries are drawn at once, and the first ``samples`` count
    whose lines cross the second image by both matrices.
    """
    rng, one, two = np.random.default_rng(seed), np.asarray(size1, float), np.asarray(size2, float)
    total, valid = np.zeros(10 * samples), np.ones(10 * samples, bool)
    for f, g in ((f1, f2), (f2, f1)):
        x = (one - 1) * rng.random((10 * samples, 2))
        y, crosses = _on_lines(_hom(x) @ f.T, two, rng.random(10 * samples))
        valid &= crosses
        total += (_gap(_hom(x) @ g.T, y, two) + _gap(_hom(y) @ g, x, one)) / 2
    return float(total[valid][:samples].mean() / 2) if valid.any() else 1.0


def fundamental_distance(pairs: DataFrame, key: str = "pair_id", samples: int = 1000) -> DataFrame:
    """(key, sgd) of rows (key, f1, f2 arrays of 9, size1, size2 arrays of width and height)."""
    kind = pairs.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([geometric_distance(np.reshape(r["f1"], (3, 3)), np.reshape(r["f2"], (3, 3)), r["size1"], r["size2"], samples) for r in rows], pa.float64())], names=[key, "sgd"])

    return dealt(pairs.select(key, "f1", "f2", "size1", "size2"), key).mapInArrow(run, f"{key} {kind}, sgd double")


def _turn(r: np.ndarray) -> float:
    """Angle of a rotation: its sine is half the length of the skew part's vector, its cosine half the trace less one."""
    across = np.array([r[2, 1] - r[1, 2], r[0, 2] - r[2, 0], r[1, 0] - r[0, 1]])
    return math.atan2(float(np.linalg.norm(across)), float(np.trace(r)) - 1)


def pose_difference(r_true: np.ndarray, t_true: np.ndarray, r: np.ndarray, t: np.ndarray) -> tuple[float, float]:
    """Degrees of the rotation between two rotations, and between the lines of two directions; a direction of length 0 is along any."""
    a, b = np.ravel(t_true).astype(float), np.ravel(t).astype(float)
    return math.degrees(_turn(np.asarray(r_true, float).T @ np.asarray(r, float))), math.degrees(math.atan2(float(np.linalg.norm(np.cross(a, b))), abs(float(a @ b))))


def random_homography(rng: np.random.Generator, perturb: float = 0.25) -> np.ndarray:
    """From the corners of the unit square to corners moved by up to ``perturb``."""
    corners = np.array([[0, 0], [0, 1], [1, 0], [1, 1]], float)
    return fit_homography(corners, corners + rng.uniform(-perturb, perturb, (4, 2)))


def _each(table: DataFrame, key: str, columns: tuple[str, ...], schema: str, f: Callable[[dict], tuple]) -> DataFrame:
    """(key, ...) with f of each row, in Arrow batches."""
    kind = table.schema[key].dataType.simpleString()
    names, types = zip(*[x.split() for x in schema.split(", ")], strict=True)
    arrow = {"double": pa.float64(), "array<double>": pa.list_(pa.float64())}

    def run(batches):
        for b in batches:
            found = [f(r) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([x[k] for x in found], arrow[t]) for k, t in enumerate(types)]], names=[key, *names])

    return table.select(key, *columns).mapInArrow(run, f"{key} {kind}, {schema}")


def pose_differences(poses: DataFrame, key: str = "pair_id") -> DataFrame:
    """(key, r_err, t_err) in degrees of rows (key, r_true, t_true, r, t): between rotations, and between directions up to sign."""
    square = lambda v: np.reshape(v, (3, 3))
    return _each(poses, key, ("r_true", "t_true", "r", "t"), "r_err double, t_err double", lambda x: pose_difference(square(x["r_true"]), np.array(x["t_true"]), square(x["r"]), np.array(x["t"])))


def random_homographies(pairs: DataFrame, perturb: float = 0.25, seed: int = 0, key: str = "pair_id") -> DataFrame:
    """(key, h array): a random homography of the unit square for each key, the same in every run."""
    return _each(pairs, key, (), "h array<double>", lambda x: (random_homography(np.random.default_rng([seed, zlib.crc32(repr(x[key]).encode())]), perturb).ravel().tolist(),))


def superimpositions(matches: DataFrame, scale: bool = False, usesvd: bool = True, key: str = "pair_id") -> DataFrame:
    """(key, m array): the rigid transform, or the similarity, of each pair's points in space (x1, y1, z1, x2, y2, z2), 4 x 4; null with fewer than three."""
    kind = matches.schema[key].dataType.simpleString()
    names = ("x1", "y1", "z1", "x2", "y2", "z2")

    def run(table: pa.Table) -> pa.Table:
        at = np.column_stack([table.sort_by([(c, "ascending") for c in names])[c].to_numpy().astype(float) for c in names])
        m = superimposition_matrix(at[:, :3].T, at[:, 3:].T, scale, usesvd).ravel().tolist() if len(at) >= 3 else None
        return pa.table([table[key].slice(0, 1).combine_chunks(), pa.array([m], pa.list_(pa.float64()))], names=[key, "m"])

    return matches.dropna(subset=list(names)).select(key, *names).groupBy(key).applyInArrow(run, f"{key} {kind}, m array<double>")
