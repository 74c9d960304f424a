"""Projective and epipolar geometry as column expressions.

Matrices are arrays of doubles, row by row: 9 for 3 x 3, 12 or 16 for poses.
Points are pairs of columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = tuple[Column, Column]


def matrix(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def at(m: Column, r: int, c: int, width: int = 3) -> Column:
    return m[r * width + c]


def times(m: Column, v: Sequence[Column], width: int = 3, transposed: bool = False) -> list[Column]:
    """The product of a 3 x 3 (or the left of a 3 x 4) matrix and a vector."""
    return [sum((at(m, c, r, width) if transposed else at(m, r, c, width)) * v[c] for c in range(3)) for r in range(3)]


def matmul(a: Column, b: Column, n: int = 3) -> Column:
    """Both factors are worked out once, so chains of products stay small."""
    cell = lambda x, r, c: sum(x["a"][r * n + k] * x["b"][k * n + c] for k in range(n))
    return F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda x: F.array(*[cell(x, r, c) for r in range(n) for c in range(n)]))[0]


def transpose(m: Column, n: int = 3) -> Column:
    return F.array(*[at(m, c, r, n) for r in range(n) for c in range(n)])


def inverse3(m: Column) -> Column:
    """By the adjugate; null for a singular matrix."""
    a, b, c, d, e, f, g, h, i = (m[k] for k in range(9))
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    adj = [e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    return F.array(*[F.try_divide(v, det) for v in adj])


def homogeneous(p: Point) -> list[Column]:
    return [p[0], p[1], F.lit(1.0)]


def skew(v: Sequence[Column]) -> Column:
    x, y, z = v
    o = F.lit(0.0)
    return F.array(o, -z, y, z, o, -x, -y, x, o)


def perspective(h: Column, p: Point) -> Point:
    """Null where the point goes to infinity."""
    x, y, w = times(h, homogeneous(p))
    return F.try_divide(x, w), F.try_divide(y, w)


def turn(h: Column, p: Point) -> Column:
    """The turn, in radians, of a homography at a point: that of the rotation closest to its derivative there.

    A homography of noisy matches has a slight perspective, and its numbers
    alone are its derivative where all coordinates are zero, far from most matches.
    """
    x, y, w = times(h, homogeneous(p))
    part = lambda v, r, c: at(h, r, c) * w - v * at(h, 2, c)
    return F.atan2(part(y, 1, 0) - part(x, 0, 1), part(x, 0, 0) + part(y, 1, 1))


def unfolded(h: Column, width: float, height: float) -> Column:
    """Whether a homography takes all of an image of this size to one side of the horizon and mirrors nothing, as any view of a plane does."""
    ahead = [times(h, homogeneous((F.lit(float(x)), F.lit(float(y)))))[2] for x in (0, width - 1) for y in (0, height - 1)]
    a, b, c = ([at(h, r, k) for k in range(3)] for r in range(3))
    det = sum(a[k] * (b[(k + 1) % 3] * c[(k + 2) % 3] - b[(k + 2) % 3] * c[(k + 1) % 3]) for k in range(3))
    side = F.signum(ahead[0])
    return (F.least(*[side * w for w in ahead]) > 0) & (side * det > 0)


def reprojection_error(h: Column, p: Point, q: Point) -> Column:
    x, y = perspective(h, p)
    return F.hypot(x - q[0], y - q[1])


def normalize(k: Column, p: Point) -> Point:
    """(p - centre) / focal length, for a camera without skew."""
    return (p[0] - at(k, 0, 2)) / at(k, 0, 0), (p[1] - at(k, 1, 2)) / at(k, 1, 1)


def normalize_full(k: Column, p: Point) -> Point:
    x, y, _ = times(inverse3(k), homogeneous(p))
    return x, y


def unnormalize_full(k: Column, p: Point) -> Point:
    x, y, _ = times(k, homogeneous(p))
    return x, y


def scale_intrinsics(k: Column, sx: Column, sy: Column) -> Column:
    return F.array(*[k[i] / sx for i in range(3)], *[k[i] / sy for i in range(3, 6)], *[k[i] for i in range(6, 9)])


def rotate_intrinsics(k: Column, w: Column, h: Column, rot: Column) -> Column:
    """Camera of the image turned by rot quarter turns; no turn counts as three."""
    fx, fy, cx, cy = at(k, 0, 0), at(k, 1, 1), at(k, 0, 2), at(k, 1, 2)
    o, one = F.lit(0.0), F.lit(1.0)
    turn = F.pmod(rot, F.lit(4))
    build = lambda a, b, c, d: F.array(a, o, b, o, c, d, o, o, one)
    return F.when(turn == 1, build(fy, cy, fx, w - 1 - cx)).when(turn == 2, build(fx, w - 1 - cx, fy, h - 1 - cy)).otherwise(build(fy, h - 1 - cy, fx, cx))


def rotate_pose(pose: Column, rot: Column) -> Column:
    """A 4 x 4 pose after the image was turned by rot quarter turns: the camera turns the other way about its axis."""
    turns = [(1, 0, 0, 1), (0, 1, -1, 0), (-1, 0, 0, -1), (0, -1, 1, 0)]
    z = lambda a, b, c, d: matrix([a, b, 0, 0, c, d, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])
    out = matmul(z(*turns[0]), pose, 4)
    for k in (1, 2, 3):
        out = F.when(F.pmod(rot, F.lit(4)) == k, matmul(z(*turns[k]), pose, 4)).otherwise(out)
    return out


def essential(rotation: Column, t: Sequence[Column]) -> Column:
    return matmul(skew(t), rotation)


def symmetric_epipolar(p: Point, q: Point, e: Column, k0: Column, k1: Column) -> Column:
    """Squared distance to both epipolar lines, in normalised coordinates."""
    x, y = homogeneous(normalize(k0, p)), homogeneous(normalize(k1, q))
    ex, ey = times(e, x), times(e, y, transposed=True)
    d = sum(a * b for a, b in zip(y, ex, strict=True))
    return d * d * (F.try_divide(F.lit(1.0), ex[0] * ex[0] + ex[1] * ex[1]) + F.try_divide(F.lit(1.0), ey[0] * ey[0] + ey[1] * ey[1]))


def epipolar_inlier(x: Point, y: Point, e: Column, threshold: float) -> Column:
    """The distance, with the mean of both lines' norms, is below the threshold."""
    a, b = times(e, homogeneous(x)), times(e, homogeneous(y), transposed=True)
    norm = (F.try_divide(F.lit(1.0), F.hypot(a[0], a[1])) + F.try_divide(F.lit(1.0), F.hypot(b[0], b[1]))) / 2
    return F.abs(sum(u * v for u, v in zip(a, homogeneous(y), strict=True))) * norm < threshold


def line_distance(line: Sequence[Column], p: Point) -> Column:
    return F.abs(sum(u * v for u, v in zip(line, homogeneous(p), strict=True)) / (F.hypot(line[0], line[1]) + 1e-8))


def fundamental_inlier(x: Point, y: Point, f: Column, size1: Point, size2: Point, share: float = 0.003) -> Column:
    """Both points are nearer to the other's line than a share of the image's diagonal."""
    ahead = line_distance(times(f, homogeneous(x)), y) < F.hypot(*size2) * share
    return ahead & (line_distance(times(f, homogeneous(y), transposed=True), x) < F.hypot(*size1) * share)


def _angle(c: Column) -> Column:
    """Null for null, which the bounds alone would pass over."""
    return F.when(c.isNotNull(), F.degrees(F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), c)))))


def rotation_error(r: Column, truth: Column) -> Column:
    """Degrees between two 3 x 3 rotations, by the trace."""
    return _angle((sum(truth[i] * r[i] for i in range(9)) - 1) / 2)


def translation_error(t: Sequence[Column], truth: Sequence[Column], ignore_below: float = 0.0) -> Column:
    """Degrees between two directions, up to sign; 0 where the true one is shorter than ignore_below, null where one is no direction."""
    norm = lambda v: F.sqrt(sum(c * c for c in v))
    e = _angle(F.try_divide(sum(a * b for a, b in zip(t, truth, strict=True)), norm(t) * norm(truth)))
    return F.when(norm(truth) < ignore_below, F.lit(0.0)).otherwise(F.when(e.isNotNull(), F.least(e, 180 - e)))


def warp(p: Point, depth: Column, pose: Column, k0: Column, k1: Column, width: int = 4) -> tuple[Column, Column, Column]:
    """(x, y, z): a point of depth ``depth`` seen from the second camera; z has 10^-4 added before the division."""
    cam = times(inverse3(k0), [c * depth for c in homogeneous(p)])
    cam = [v + at(pose, r, 3, width) for r, v in enumerate(times(pose, cam, width))]
    x, y, z = times(k1, cam)
    return x / (z + 1e-4), y / (z + 1e-4), cam[2]


def covisible(p: Point, w: Column, h: Column) -> Column:
    return (p[0] > 0) & (p[0] < w - 1) & (p[1] > 0) & (p[1] < h - 1)


def consistent(seen: Column, computed: Column, share: float = 0.2) -> Column:
    return F.abs(F.try_divide(seen - computed, seen)) < share
