"""Centroid clustering: exact k-means on integer vectors, with Yinyang bounds.

Centroids are grouped once.  A vector keeps an upper bound of the distance to
its own centroid and one lower bound a group, of the distance to every other
centroid in it.  When centroids have moved, bounds move by as much: a vector
whose least lower bound is beyond its upper one stays without a distance worked
out (the global filter); otherwise only groups whose bound isn't beyond are
opened, and in them only centroids that the bound before, less their own move,
doesn't rule out.  Distances of the rest are exact.

Vectors and bounds are a table, rewritten each round; what the driver gets of a
round are k sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, batch, pick

#: Components have at most this size after scaling; squared distances of up to 128 of them fit into 63 bits.
MOST_COMPONENT = 1 << 27
#: Components that all centroids have together; they go to the driver and to every task.
MOST_CENTROID_COMPONENTS = 1 << 22
#: Vectors looked at together.
BLOCK = 4096

STATE = pa.schema([("vec_id", pa.int64()), ("vec", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.list_(pa.float64())), ("scanned", pa.int32())])
STATE_SQL = "vec_id long, vec array<int>, cluster int, upper double, lower array<double>, scanned int"


def vectors(df: DataFrame, dim: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, vec array<int>): floor(scale * x) of the rows with exactly dim components, none null or not finite.

    Vectors with a component beyond MOST_COMPONENT after that go too: their
    squared distances need more than a long.
    """
    kept = pick(df, vec_id=id_col, vec=vector_col).select(F.col("vec_id").cast("long"), F.col("vec").cast("array<double>"))
    within = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < MOST_COMPONENT)
    kept = kept.where((F.size("vec") == dim) & F.forall("vec", within))
    return kept.select("vec_id", F.transform("vec", lambda x: F.floor(x * scale).cast("int")).alias("vec"))


def first_centroids(table: DataFrame, k: int, seed: int) -> np.ndarray:
    """The vectors of the k least sha256 of "seed:id", in that order; ties by the components, a null id last."""
    key: Column = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = table.select(key.alias("key"), "vec").orderBy(F.asc_nulls_last("key"), "vec").limit(k).collect()
    return np.array([r.vec for r in rows], np.int64)


def groups_of(centroids: np.ndarray, t: int, rounds: int = 5) -> np.ndarray:
    """The group of each centroid, by a few rounds of k-means among them; only the number of distances depends on it."""
    points = centroids.astype(np.float64)
    means = points[np.linspace(0, len(points) - 1, t).astype(int)]
    for _ in range(rounds):
        near = ((points[:, None] - means[None]) ** 2).sum(2).argmin(1)
        means = np.array([points[near == g].mean(0) if (near == g).any() else means[g] for g in range(t)])
    return near


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of x and rows of c, both int64."""
    most = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if int(most) ** 2 * 4 * x.shape[1] < 1 << 53:  # every step is an integer that a double has
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    return np.stack([((x - row) ** 2).sum(1) for row in c], 1) if len(c) else np.zeros((len(x), 0), np.int64)


def squared_pairs(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of each row of x to the same row of c."""
    d = x - c
    return (d * d).sum(1)


#: Rounding of roots and sums of bounds, as a share, is far less; bounds are widened by it.
SLACK = 1e-12


def up(x: np.ndarray) -> np.ndarray:
    return x * (1 + SLACK) + 1e-300


def down(x: np.ndarray) -> np.ndarray:
    return x * (1 - SLACK)


def first_step(x: np.ndarray, centroids: np.ndarray, group: np.ndarray, t: int) -> tuple[np.ndarray, ...]:
    """Every distance: cluster, upper, lower, how many were worked out."""
    d = squared(x, centroids)
    cluster = d.argmin(1)
    own = d[np.arange(len(x)), cluster]
    far = down(np.sqrt(d.astype(np.float64)))
    far[np.arange(len(x)), cluster] = np.inf
    lower = np.stack([far[:, group == g].min(1, initial=np.inf) for g in range(t)], 1)
    return cluster, up(np.sqrt(own.astype(np.float64))), lower, np.full(len(x), len(centroids))


def next_step(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, group: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, ...]:
    """The same after centroids moved so far, by the filters."""
    t = lower.shape[1]
    most = np.array([moved[group == g].max(initial=0.0) for g in range(t)])
    before, lower = lower, down(np.maximum(lower - most, 0))
    cluster, upper, scanned = cluster.copy(), up(upper + moved[cluster]), np.zeros(len(x), np.int64)
    # the global filter, with the upper bound as it is, then tightened
    open_ = np.flatnonzero(lower.min(1) <= upper)
    scanned[open_] += 1
    best = np.zeros(len(x), np.int64)
    best[open_] = squared_pairs(x[open_], centroids[cluster[open_]])
    upper[open_] = up(np.sqrt(best[open_].astype(np.float64)))
    open_ = open_[lower[open_].min(1) <= upper[open_]]
    was, was_best = cluster.copy(), best.copy()
    closest, second = np.full(lower.shape, -1), lower.copy()
    for g in range(t):
        # the group filter: an upper bound that another group lowered counts
        rows = open_[lower[open_, g] <= upper[open_]]
        if not len(rows):
            continue
        near, next_, least = np.full(len(rows), np.inf), np.full(len(rows), np.inf), np.full(len(rows), -1)
        for c in np.flatnonzero(group == g):
            # the local filter: what the bound before tells of this centroid alone
            bound = down(np.maximum(before[rows, g] - moved[c], 0))
            look = (bound <= upper[rows]) & (was[rows] != c)
            at = rows[look]
            d = squared_pairs(x[at], centroids[c])
            scanned[at] += 1
            far = np.where(was[rows] == c, np.inf, bound)
            far[look] = down(np.sqrt(d.astype(np.float64)))
            next_ = np.minimum(next_, np.maximum(near, far))
            least, near = np.where(far < near, c, least), np.minimum(near, far)
            better = (d < best[at]) | ((d == best[at]) & (c < cluster[at]))
            won = at[better]
            best[won], cluster[won] = d[better], c
            upper[won] = up(np.sqrt(best[won].astype(np.float64)))
        lower[rows, g], closest[rows, g], second[rows, g] = near, least, next_
    # a bound leaves out the own centroid, so that of its group may be the second least, and the one left behind counts in its group
    changed = open_[cluster[open_] != was[open_]]
    g = group[cluster[changed]]
    lower[changed, g] = np.where(closest[changed, g] == cluster[changed], second[changed, g], lower[changed, g])
    g = group[was[changed]]
    lower[changed, g] = np.minimum(lower[changed, g], down(np.sqrt(was_best[changed].astype(np.float64))))
    return cluster, upper, lower, scanned


def _matrix(column: pa.Array, width: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * width, pa.int32()), pa.array(values.reshape(-1), kind))


def assign_step(centroids: np.ndarray, group: np.ndarray, t: int, moved: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One round of assignments as a function of Arrow batches; without moves, of (vec_id, vec), else of the state."""
    dim = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                b = whole.slice(at, BLOCK)
                x = _matrix(b.column(1), dim, np.int64)
                if moved is None:
                    cluster, upper, lower, scanned = first_step(x, centroids, group, t)
                else:
                    cluster, upper, lower, scanned = next_step(x, b.column(2).to_numpy().astype(np.int64), b.column(3).to_numpy(), _matrix(b.column(4), t, np.float64), centroids, group, moved)
                yield batch(STATE, b.column(0), b.column(1), cluster.astype(np.int32), upper, _lists(lower, pa.float64()), scanned.astype(np.int32))

    return run


def _distances(centroids: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("scanned", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = centroids[b.column(2).to_numpy()]
            yield batch(schema, b.column(0), b.column(2), squared_pairs(_matrix(b.column(1), centroids.shape[1], np.int64), own), b.column(3))

    return run


def _sums(k: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's sums: one row for each centroid that it has vectors of."""
    schema = pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for b in batches:
            cluster = b.column(0).to_numpy()
            n += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            there, starts = np.unique(cluster[order], return_index=True)
            if len(there):
                total[there] += np.add.reduceat(_matrix(b.column(1), dim, np.int64)[order], starts, axis=0)
        there = np.flatnonzero(n)
        yield batch(schema, there.astype(np.int32), n[there], _lists(total[there], pa.int64()))

    return run


def updated(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """floor(sum / count) of each centroid's vectors; one without any stays."""
    k, dim = centroids.shape
    parts = state.select("cluster", "vec").mapInArrow(_sums(k, dim), "cluster int, n long, total array<long>")
    rows = parts.select("cluster", F.col("n").cast("decimal(38,0)").alias("n"), F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    out = centroids.copy()
    for r in rows:
        out[r.cluster, r.i] = int(r.x) // int(r.n)
    return out


def cluster(df: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: int = 2, groups: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id long, cluster int, distance long, scanned int) of the kept vectors, and the centroids.

    Vectors of another length than dim, with nulls or without a finite value
    everywhere, and null ones, are left out.  Ids needn't be unique or there:
    rows count one by one, equal ones all alike.  Ties of distances go to the
    centroid of the smaller number.  With fewer vectors than k there are as
    many centroids; an empty table gives no rows and no centroids.  ``scanned``
    is how many distances the last round worked out.  Only ids and vectors of
    df are read.  The result reads a table in the shared folder.
    """
    if k < 1 or dim < 1 or dim > 128 or k * dim > MOST_CENTROID_COMPONENTS:
        raise ValueError("k and dim are positive; up to 128 dimensions, and 2^22 components of centroids")
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "yinyang")
    table = scratch.save(vectors(df, dim, scale, id_col, vector_col), "vectors")
    centroids = first_centroids(table, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, scanned int"), centroids.reshape(0, dim)
    t = min(groups or max(1, len(centroids) // 10), len(centroids))
    group = groups_of(centroids, t)
    state, name, moved = table, "vectors", None
    for r in range(rounds + 1):
        step = assign_step(centroids, group, t, moved)
        before, name = name, f"round{r}"
        state = scratch.save(state.mapInArrow(step, STATE_SQL), name)
        scratch.drop(before)  # the new table is whole: nothing reads the old one
        if r == rounds:
            break
        new = updated(state, centroids)
        moved = up(np.sqrt(squared_pairs(new, centroids).astype(np.float64)))
        if not moved.max() > 1e-200:  # they stay where they are, and so does every vector
            break
        centroids = new
    return state.select("vec_id", "vec", "cluster", "scanned").mapInArrow(_distances(centroids), "vec_id long, cluster int, distance long, scanned int"), centroids


def digest(df: DataFrame, **options) -> DataFrame:
    """cluster's rows with cluster_inertia and inertia (distances summed over the cluster and over all) and centroid_sha256.

    The last is of the centroid's components, as decimal integers joined by
    commas.  Inertias are null where they pass a long.
    """
    rows, centroids = cluster(df, **options)
    spark = df.sparkSession
    sums = {r.cluster: int(r.d) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    fits = lambda x: x if x < 1 << 63 else None
    all_ = fits(sum(sums.values()))
    about = [(c, fits(sums.get(c, 0)), all_, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids.tolist())]
    told = spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
