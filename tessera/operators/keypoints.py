"""Keypoint tables (image_id, kp_idx, x, y, score): filters, scaling, suppression, top-k, sampling."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..shared import stored
from .knn import _cogrouped


# sizes


def resize_keep_aspect(w: Column, h: Column, target_w: int, target_h: int) -> tuple[Column, Column]:
    """Width and height scaled by the smaller ratio, truncated."""
    scale = F.least(target_w / w, target_h / h)
    return (w * scale).cast("int"), (h * scale).cast("int")


def resize_long_side(w: Column, h: Column, long_side: int) -> tuple[Column, Column]:
    """The longer side becomes long_side; halves round to even."""
    scale = long_side / F.greatest(w, h)
    return F.bround(w * scale, 0).cast("int"), F.bround(h * scale, 0).cast("int")


def resize_long_truncated(w: Column, h: Column, long_side: int) -> tuple[Column, Column]:
    """The longer side becomes long_side; both are truncated."""
    longest = F.greatest(w, h)
    return (w * long_side / longest).cast("int"), (h * long_side / longest).cast("int")


def extractor_resize(w: Column, h: Column, resize: list[int]) -> tuple[Column, Column, Column, Column]:
    """New width and height, truncated, and the scales of x and y: [n] for the long side, [h, w] for both."""
    if len(resize) == 1:
        sx = sy = resize[0] / F.greatest(w, h)
    else:
        sy, sx = resize[0] / h, resize[1] / w
    return (w * sx).cast("int"), (h * sy).cast("int"), sx, sy


def rescale_to_multiple(w: Column, h: Column, df: int = 32) -> tuple[Column, Column, Column, Column]:
    """Sizes down to a multiple, and the factors that take coordinates there back."""
    w_new, h_new = floor_to_multiple(w, df), floor_to_multiple(h, df)
    return w_new, h_new, w / w_new, h / h_new


def floor_to_multiple(v: Column, df: int) -> Column:
    return (F.floor(v / df) * df).cast("int")


def process_resize(w: Column, h: Column, resize: list[int]) -> tuple[Column, Column]:
    """[n]: long side n; [-1]: as it is; [w, h]: exactly."""
    if len(resize) == 2:
        return F.lit(resize[0]), F.lit(resize[1])
    if len(resize) != 1:
        raise ValueError(resize)
    if resize[0] == -1:
        return w, h
    scale = resize[0] / F.greatest(w, h)
    return F.bround(w * scale, 0).cast("int"), F.bround(h * scale, 0).cast("int")


# coordinates


def normalize_max_dim(v: Column, size: Column, w: Column, h: Column) -> Column:
    """Centre, in units of 0.7 times the longer side."""
    return (v - size / 2) / (F.greatest(w, h) * 0.7)


def normalize_size(v: Column, size: Column, w: Column, h: Column, scale: float = 1.0) -> Column:
    return (v - size / 2 + 0.5) / (F.greatest(w, h) * scale)


def normalize_intrinsics(v: Column, c: Column, f: Column) -> Column:
    return (v - c) / f


def cell_to_pixel(cell: Column, width: int, scale: int) -> tuple[Column, Column]:
    return F.pmod(cell, F.lit(width)) * scale, F.floor(cell / width) * scale


def root_normalize(d: Column) -> Column:
    """Divided by the sum of absolute values, then the root."""
    total = F.aggregate(d, F.lit(0.0), lambda acc, v: acc + F.abs(v))
    return F.transform(d, lambda v: F.sqrt(F.abs(v / (total + 1e-8))))


def l2_normalize(d: Column) -> Column:
    total = F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, v: acc + v * v))
    return F.transform(d, lambda v: v / F.greatest(total, F.lit(1e-12)))


def position_encoding(x: Column, y: Column, d_model: int, scale_x: float = 1.0, scale_y: float = 1.0) -> Column:
    """sin x, cos x, sin y, cos y for each of d_model / 4 frequencies; positions count from 1."""
    out = []
    for k in range(d_model // 4):
        f = math.exp(2 * k * (-math.log(10000.0) / (d_model // 2)))
        out += [F.sin((x + 1) * scale_x * f), F.cos((x + 1) * scale_x * f), F.sin((y + 1) * scale_y * f), F.cos((y + 1) * scale_y * f)]
    return F.array(*out)


def dynamic_alpha(n: Column, milestones=(0, 300, 1000, 2000), alphas=(1.0, 0.8, 0.4, 0.2)) -> Column:
    """Piecewise linear in n; constant beyond the last milestone."""
    out = F.lit(float(alphas[-1]))
    for k in range(len(milestones) - 2, -1, -1):
        a, b, u, v = milestones[k], milestones[k + 1], alphas[k], alphas[k + 1]
        out = F.when(n < b, F.lit(u) + (n - a) / (b - a) * (v - u)).otherwise(out)
    return out


def error_color(err: Column, threshold: float, alpha: float = 1.0) -> Column:
    """Red, green, blue, alpha: green for no error, red from twice the threshold on."""
    x = 1 - F.least(F.greatest(err / (threshold * 2), F.lit(0.0)), F.lit(1.0))
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    return F.array(unit(2 - x * 2), unit(x * 2), F.lit(0.0), F.lit(float(alpha)))


# filters


def above(table: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    return table.where(F.col(score) > threshold)


def mask_to_keypoints(mask: DataFrame, threshold: float = 0.5, size: float = 3.0) -> DataFrame:
    """(image_id, kp_idx, x, y, score, size): each pixel (image_id, y, x, p) above the threshold, numbered row by row."""
    order = Window.partitionBy("image_id").orderBy("y", "x")
    return mask.where(F.col("p") > threshold).select("image_id", (F.row_number().over(order) - 1).alias("kp_idx"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.col("p").alias("score"), F.lit(size).alias("size"))


def first_n(table: DataFrame, n: int) -> DataFrame:
    """The first n keypoints of each image by their numbers, without sorting."""
    return table.where(F.col("kp_idx") < n)


def remove_borders(table: DataFrame, border: int, w: Column, h: Column) -> DataFrame:
    return table.where((F.col("x") >= border) & (F.col("x") < w - border) & (F.col("y") >= border) & (F.col("y") < h - border))


def top_k(table: DataFrame, k: int, group: str = "image_id") -> DataFrame:
    """The k best of each image by (score descending, kp_idx)."""
    order = Window.partitionBy(group).orderBy(F.col("score").desc(), "kp_idx")
    return table.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def strided(table: DataFrame, skip: int, most: int, position: str = "position") -> DataFrame:
    """Every skip-th row from the first, and of those the first ``most``, by a position that counts from 0 without gaps."""
    return table.where((F.pmod(F.col(position), F.lit(skip)) == 0) & (F.col(position) < skip * most))


def pad_grid(table: DataFrame, images: DataFrame, value: str = "value") -> DataFrame:
    """(image_id, y, x, value, valid): square grids of side ``pad`` of images (image_id, pad), zero where table has no cell."""
    side = lambda: F.explode(F.sequence(F.lit(0), F.col("pad") - 1))
    grid = images.select("image_id", "pad", side().alias("y")).select("image_id", "y", "pad", side().alias("x")).drop("pad")
    have = table.select("image_id", "y", "x", F.col(value).alias("value"), F.lit(True).alias("valid"))
    return grid.join(have, ["image_id", "y", "x"], "left").select("image_id", "y", "x", F.coalesce("value", F.lit(0.0)).alias("value"), F.coalesce("valid", F.lit(False)).alias("valid"))


# suppression


def nms(table: DataFrame, radius: float, rounds: int = 2, group: str = "image_id") -> DataFrame:
    """Keypoints that survive: the maxima of their windows; then, ``rounds`` times, the maxima of what no survivor covers.

    A covered keypoint counts as score 0 in a round, as empty places do.  Ties
    survive together.  Keypoints have scores above 0.  Only keypoints within
    the radius meet; the keypoints of an image and their neighbours, of which
    there are few, go through the rounds in one task, place by place.
    """
    names = ("kp_idx", "x", "y", "score")

    def run(table: pa.Table) -> pa.Table:
        x, y, score = (table[c].to_numpy().astype(float) for c in names[1:])
        # keypoints of one place have the same window; a place stands for the largest of its own, itself included, which no comparison here minds
        places, own = np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)
        own = own.ravel()

        def most(values: np.ndarray) -> np.ndarray:
            best = np.zeros(len(places))
            np.maximum.at(best, own, values)
            out = np.zeros(len(places))
            for a, b in _neighbours(places[:, 0], places[:, 1], radius):
                np.maximum.at(out, a, best[b])
            return np.maximum(out, best)[own]

        kept = score >= most(score)
        for _ in range(rounds):
            covered = kept | (most(kept.astype(float)) > 0)
            now = np.where(covered, 0.0, score)
            kept = kept | (~covered & (now >= most(now)))
        return table.select([group, "kp_idx"]).filter(pa.array(kept))

    kind = lambda c: table.schema[c].dataType.simpleString()
    alive = table.select(group, *names).groupBy(group).applyInArrow(run, f"{group} {kind(group)}, kp_idx {kind('kp_idx')}")
    return table.join(alive, [group, "kp_idx"], "left_semi")


def cell_scores(cells: DataFrame, side: int = 8) -> DataFrame:
    """(image_id, y, x, p) from scores (image_id, cy, cx, scores) of cells of side x side pixels, row by row, with a last one for "none".

    The softmax over all of them, of which the last is dropped; rows without
    all their scores give no pixels.
    """
    n = side * side
    t = cells.where((F.size("scores") == n + 1) & F.forall("scores", lambda v: v.isNotNull()))
    e = F.transform("scores", lambda v: F.exp(v.cast("double") - F.array_max("scores")))
    t = t.select("image_id", "cy", "cx", e.alias("e")).withColumn("total", F.aggregate("e", F.lit(0.0), lambda a, v: a + v))
    t = t.select("image_id", "cy", "cx", "total", F.posexplode(F.slice("e", 1, n)).alias("k", "v"))
    return t.select("image_id", (F.col("cy") * side + F.floor(F.col("k") / side)).alias("y"), (F.col("cx") * side + F.pmod("k", F.lit(side))).alias("x"), (F.col("v") / F.col("total")).alias("p"))


def nms_tiled(table: DataFrame, radius: float, rounds: int = 2, tile: float = 512.0) -> DataFrame:
    """As nms, image by image in tiles, so that a large image is several tasks.

    Whether a keypoint stays is told by those within the radius, and with each
    round by those within two radii more: so far a tile looks beyond its sides,
    and keeps what lies inside.
    """
    halo = radius * (1 + 2 * rounds)
    if tile <= 0:
        raise ValueError("tiles have a size")
    near = lambda c: F.sequence(F.floor((F.col(c) - halo) / tile), F.floor((F.col(c) + halo) / tile))
    t = table.select("image_id", "kp_idx", "x", "y", "score").select("*", F.explode(near("x")).alias("tx")).select("*", F.explode(near("y")).alias("ty"))
    kept = nms(t.withColumn("tile", F.concat_ws(" ", F.col("image_id").cast("string"), "tx", "ty")), radius, rounds, "tile")
    own = kept.where((F.floor(F.col("x") / tile) == F.col("tx")) & (F.floor(F.col("y") / tile) == F.col("ty")))
    return table.join(own.select("image_id", "kp_idx"), ["image_id", "kp_idx"], "left_semi")


#: Pairs of neighbours held at once.
PAIRS = 1 << 21


def _neighbours(x: np.ndarray, y: np.ndarray, radius: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ordered pairs of different points within the radius in x and in y: of cells as wide, next to each other; about PAIRS at a time."""
    cx, cy = (np.floor(v / (radius + 1)).astype(np.int64) for v in (x, y))
    cx, cy = cx - cx.min() + 1, cy - cy.min() + 1
    width = int(cy.max()) + 2
    code = cx * width + cy
    order = np.argsort(code, kind="stable")
    held = code[order]
    for dx in (-1, 0, 1):
        for dy in (-1, 0, 1):
            want = code + dx * width + dy
            low, high = np.searchsorted(held, want), np.searchsorted(held, want, side="right")
            many = high - low
            ends = np.cumsum(many)
            start = 0
            while start < len(x):
                stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
                n = many[start:stop]
                a = np.repeat(np.arange(start, start + len(n)), n)
                b = order[np.arange(len(a)) + np.repeat(low[start:stop] - np.cumsum(n) + n, n)]
                on = (a != b) & (np.abs(x[a] - x[b]) <= radius) & (np.abs(y[a] - y[b]) <= radius)
                yield a[on], b[on]
                start = stop


#: Places of one block, and distances held at once.
PLACES, DISTANCES = 4_096, 1 << 20


def _around(places: DataFrame, run: Callable[[np.ndarray, pa.Table, pa.Table], pa.Array], kind: str) -> DataFrame:
    """(pair_id, side, x, y, value) of places (pair_id, side, x, y, n, top, r): run(distances, own, others) of each block of places with each other.

    The places of a pair and side are cut into blocks, and two blocks are a
    task's, so distances grow with the square of the places, but no task does.
    """
    keys, cell = ["pair_id", "side"], F.pmod(F.xxhash64("x", "y"), F.col("blocks")).cast("int")
    sizes = places.groupBy(*keys).agg(F.ceil(F.count("*") / PLACES).cast("int").alias("blocks"))
    t = places.join(sizes, keys)
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    columns = ["x", "y", "n", "top", "r"]
    left = t.select(*keys, cell.alias("a"), each.alias("b"), *columns)
    right = t.select(*keys, cell.alias("b"), each.alias("a"), *columns).select(*keys, "a", "b", *columns)

    def met(key, own: pa.Table, others: pa.Table) -> pa.Table:
        values, n = [], own.num_rows if own.num_columns and others.num_columns and others.num_rows else 0
        if n:
            u, v = others["x"].to_numpy(), others["y"].to_numpy()
            step = max(1, DISTANCES // len(u))
            for lo in range(0, n, step):
                some = own.slice(lo, step)
                values.append(run(np.hypot(some["x"].to_numpy()[:, None] - u, some["y"].to_numpy()[:, None] - v), some, others))
        head = [pa.array([k.as_py()] * n, t) for k, t in zip(key[:2], types, strict=True)]
        return pa.table([*head, *(own[c] if n else pa.array([], pa.float64()) for c in ("x", "y")), pa.array(np.concatenate(values) if n else [], pa.float64())], names=[*keys, "x", "y", "value"])

    types = [to_arrow_type(places.schema[k].dataType) for k in keys]
    return _cogrouped(left, right, [*keys, "a", "b"], met, f"pair_id {kind}, side int, x double, y double, value double")


def seeds(matches: DataFrame, k: int, bar: float, radius_share: float) -> DataFrame:
    """Seeds of each pair from (pair_id, i, j, x1, y1, x2, y2, score, mutual).

    Non-mutual matches score -1; a match with a stronger one nearer than
    radius_share times the mean distance in either image scores -1, and so does
    one below the bar.  The best min(survivors + 2, k) stay, so up to two
    suppressed ones may.  In each image the places of a pair's matches are
    compared, each once, by its number of matches and its highest score.
    """
    kind = matches.schema["pair_id"].dataType.simpleString()
    number = lambda c: F.col(c).cast("double").alias(c)
    mutual = F.when(F.coalesce("mutual", F.lit(False)), F.col("score").cast("double")).otherwise(-1.0)
    own = stored(matches.select("pair_id", "i", "j", *map(number, ("x1", "y1", "x2", "y2")), mutual.alias("s")), "matches")
    at = lambda side: own.select("pair_id", F.lit(side).alias("side"), F.col(f"x{side}").alias("x"), F.col(f"y{side}").alias("y"), "s")
    places = stored(at(1).unionByName(at(2)).groupBy("pair_id", "side", "x", "y").agg(F.count("*").cast("double").alias("n"), F.max("s").alias("top")), "places")
    total = _around(places.withColumn("r", F.lit(0.0)), lambda far, a, b: far @ b["n"].to_numpy() * a["n"].to_numpy(), kind).groupBy("pair_id", "side").agg(F.sum("value").alias("total"))
    count = places.groupBy("pair_id", "side").agg(F.sum("n").alias("all"))
    radii = stored(total.join(count, ["pair_id", "side"]).select("pair_id", "side", (radius_share * (F.col("total") / (F.col("all") * F.col("all")))).alias("r")), "radii")
    near = _around(places.join(radii, ["pair_id", "side"]), lambda far, a, b: np.where(far >= a["r"].to_numpy()[:, None], -np.inf, b["top"].to_numpy()).max(axis=1), kind)
    best = near.groupBy("pair_id", "side", "x", "y").agg(F.max("value").alias("best"))
    side = lambda n: best.where(F.col("side") == n).select("pair_id", F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("best").alias(f"best{n}"))
    t = own.join(side(1), ["pair_id", "x1", "y1"]).join(side(2), ["pair_id", "x2", "y2"])
    weak = (F.col("s") < F.greatest("best1", "best2")) | (F.col("s") < bar)
    t = stored(t.select("pair_id", "i", "j", F.when(weak, -1.0).otherwise(F.col("s")).alias("score")), "scored")
    alive = t.groupBy("pair_id").agg(F.count_if(F.col("score") > 0).alias("alive"))
    order = Window.partitionBy("pair_id").orderBy(F.col("score").desc(), "i")
    ranked = t.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.join(alive, "pair_id").where(F.col("rank") <= F.col("alive") + 2).select("pair_id", "rank", "i", "j", "score")


def sample_descriptors(points: DataFrame, grid: DataFrame, stride: int = 8) -> DataFrame:
    """(image_id, kp_idx, descriptor): the grid's descriptors (image_id, gx, gy, descriptor) between the four cells around each point, of length 1.

    A point p lies at (p - stride / 2 + 0.5) / stride in the grid; cells outside count as zero.
    """
    place = lambda c: (F.col(c) - stride / 2 + 0.5) / stride
    p = points.select("image_id", "kp_idx", place("x").alias("u"), place("y").alias("v"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])).alias("c")
    p = p.select("*", corner).withColumn("gx", F.floor("u") + F.col("c.i")).withColumn("gy", F.floor("v") + F.col("c.j"))
    weight = (1 - F.abs(F.col("u") - F.col("gx"))) * (1 - F.abs(F.col("v") - F.col("gy")))
    met = p.join(grid, ["image_id", "gx", "gy"]).select("image_id", "kp_idx", F.posexplode(F.transform("descriptor", lambda e: e * weight)).alias("k", "e"))
    summed = met.groupBy("image_id", "kp_idx", "k").agg(F.sum("e").alias("e")).groupBy("image_id", "kp_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "e"))), lambda s: s["e"]).alias("descriptor"))
    return summed.withColumn("descriptor", l2_normalize(F.col("descriptor")))
