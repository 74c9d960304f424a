"""Attention between the keypoints of a set, as aggregates and joins; projections have been applied already.

Queries are rows (set_id, i, q), keys rows (set_id, j, k, v), arrays of all
heads one after another.  The linear form sums products of keys and values once
for each set, a matrix of bounded size, and gives it to each query: the work
grows with the keypoints, not with their pairs.  The softmax form compares
blocks of queries with blocks of keys; what a block leaves of a query is its
largest score, the sum of the exponentials, and the weighted values, and these
merge.  Rows with a null vector play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .knn import _cogrouped, _matrix

#: Copies of a set's matrix, between which its queries are dealt, so that a set of very many queries isn't one task's.
COPIES = 16
#: Least rows of a tile.
TILE_ROWS = 4_096
#: Queries and keys that are compared at a time there.
BLOCK_ROWS = 4_096


def elu_plus_one(v: Column) -> Column:
    """x + 1 above zero, e^x below: positive everywhere."""
    return F.transform(v, lambda x: F.when(x > 0, x.cast("double") + 1).otherwise(F.exp(x)))


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _heads(x: np.ndarray, heads: int) -> np.ndarray:
    if x.shape[1] % heads:
        raise ValueError("vectors divide into heads")
    return x.reshape(len(x), heads, -1)


def key_sums(keys: DataFrame, heads: int = 1) -> DataFrame:
    """(set_id, kv, z, n): for each set the sums of (elu(k) + 1) v^T and of elu(k) + 1 over its keys, head by head, and how many keys.

    Each task adds up its own keys first; what moves is a matrix for each set
    of a task.
    """
    kind = keys.schema["set_id"]
    sums = pa.schema([("set_id", _arrow(keys)), ("cells", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            k, v = (_heads(_vectors(b.column(c), len(b.column(c)[0].as_py())), heads) for c in (1, 2))
            for one in dict.fromkeys(ids):
                on = np.array([x == one for x in ids]) if one is not None else np.array([x is None for x in ids])
                kv = np.einsum("nhd,nhe->hde", k[on], v[on]).ravel()
                part = np.concatenate([[on.sum()], k[on].sum(axis=0).ravel(), kv])
                total[one] = part if one not in total else total[one] + part
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), sums.field(0).type), pa.array([x.tolist() for x in total.values()], sums.field(1).type)], schema=sums)

    parts = keys.where("k IS NOT NULL AND v IS NOT NULL").select("set_id", elu_plus_one(F.col("k")).alias("k"), "v").mapInArrow(run, f"set_id {kind.dataType.simpleString()}, cells array<double>")
    whole = parts.select("set_id", F.posexplode("cells").alias("at", "x")).groupBy("set_id", "at").agg(F.sum("x").alias("x"))
    cells = whole.groupBy("set_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("cells"))
    return cells.select("set_id", F.col("cells")[0].cast("long").alias("n"), F.slice("cells", 2, F.size("cells")).alias("sums"))


def _arrow(t: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(t.schema["set_id"].dataType)


def linear(queries: DataFrame, keys: DataFrame, heads: int = 1, eps: float = 1e-6) -> DataFrame:
    """(set_id, i, out): for each query phi(q) KV / (phi(q) z + eps), phi being elu + 1; null where the set has no keys.

    A set's matrix goes to its queries in COPIES, so a set with a third of all
    queries is several tasks.
    """
    sums = key_sums(keys, heads).select("set_id", "n", "sums", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    q = queries.where("q IS NOT NULL").select("set_id", "i", elu_plus_one(F.col("q")).alias("q")).withColumn("copy", F.pmod(F.xxhash64("i"), F.lit(COPIES)).cast("int"))
    met = q.join(sums, ["set_id", "copy"], "left")
    out_schema = pa.schema([("set_id", _arrow(queries)), ("i", pa.int64()), ("out", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list[float] | None] = [None] * b.num_rows
            # rows of one set stand together after the join, and share their matrix
            held, now = None, None
            for r, (one, q, n, cells) in enumerate(zip(b.column(0).to_pylist(), b.column(2), b.column(3), b.column(4), strict=True)):
                if not cells.is_valid:
                    continue
                x = _heads(q.values.to_numpy(zero_copy_only=False)[None, :], heads)[0]
                if held is None or now != (one, x.shape):
                    flat = cells.values.to_numpy(zero_copy_only=False)
                    z = flat[: x.size].reshape(x.shape)
                    held, now = (z, flat[x.size :].reshape(*x.shape, -1)), (one, x.shape)
                z, kv = held
                out[r] = (np.einsum("hd,hde->he", x, kv) / ((x * z).sum(axis=1, keepdims=True) + eps)).ravel().tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.list_(pa.float64()))], schema=out_schema)

    kind = queries.schema["set_id"].dataType.simpleString()
    return met.select("set_id", F.col("i").cast("long").alias("i"), "q", "n", "sums").mapInArrow(run, f"set_id {kind}, i long, out array<double>")


def softmax(queries: DataFrame, keys: DataFrame, heads: int = 1, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(set_id, i, out): for each query the values weighed by softmax(q k / sqrt(d)), head by head; null where the set has no keys.

    A set's queries and keys are cut into tiles, and each tile of queries meets
    each tile of keys in a task of its own, which compares ``block_rows`` of
    either at a time.  Rows move once for every tile of the other side, so tiles
    are no smaller than TILE_ROWS, however small the blocks are.
    """
    q = queries.where("q IS NOT NULL").select("set_id", F.col("i").cast("long").alias("i"), "q")
    k = keys.where("k IS NOT NULL AND v IS NOT NULL").select("set_id", F.col("j").cast("long").alias("j"), "k", "v")
    count = lambda t, n: t.groupBy("set_id").agg(F.ceil(F.count("*") / max(block_rows, TILE_ROWS)).cast("int").alias(n))
    sizes = count(q, "rows").join(count(k, "columns"), "set_id")

    def cut(t: DataFrame, own: str, other: str, by: str) -> DataFrame:
        names = t.columns
        t = t.join(sizes, "set_id").select(*names, F.pmod(F.xxhash64(by), F.col(own)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))
        return t.select("set_id", "rows", "columns", *names[1:])

    set_type = _arrow(queries)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        n = left.num_rows if left.num_columns and right.num_columns and right.num_rows else 0
        most, total, values = np.zeros((0, heads)), np.zeros((0, heads)), np.zeros((0, 0))
        if n:
            x, y, v = (_heads(_matrix(t[c]), heads) for t, c in ((left, "q"), (right, "k"), (right, "v")))
            most, total, values = np.full((n, heads), -np.inf), np.zeros((n, heads)), np.zeros((n, heads, v.shape[2]))
            x = x / np.sqrt(x.shape[2])
            for lo in range(0, n, block_rows):
                at = slice(lo, lo + block_rows)
                for to in range(0, len(y), block_rows):
                    k, w = y[to : to + block_rows], v[to : to + block_rows]
                    score = np.matmul(x[at].transpose(1, 0, 2), k.transpose(1, 2, 0))  # head, query, key
                    top = np.maximum(most[at], score.max(axis=2).T)
                    e, less = np.exp(score - top.T[:, :, None]), np.exp(most[at] - top)
                    total[at] = total[at] * less + e.sum(axis=2).T
                    values[at] = values[at] * less[:, :, None] + np.matmul(e, w.transpose(1, 0, 2)).transpose(1, 0, 2)
                    most[at] = top
            values = values.reshape(n, -1)
        lists = lambda m: pa.array(list(m), pa.list_(pa.float64()))
        return pa.table([pa.array([key[0].as_py()] * n, set_type), left["i"] if n else pa.array([], pa.int64()), lists(most), lists(total), lists(values)], names=["set_id", "i", "most", "total", "part"])

    kind = queries.schema["set_id"].dataType.simpleString()
    parts = _cogrouped(cut(q, "rows", "columns", "i"), cut(k, "columns", "rows", "j"), ["set_id", "rows", "columns"], run, f"set_id {kind}, i long, most array<double>, total array<double>, part array<double>")
    # a query has one row for each block of keys: they are merged by their largest scores
    met = parts.groupBy("set_id", "i").agg(F.collect_list(F.struct("most", "total", "part")).alias("p"))
    top = F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: F.array_max(F.transform("p", lambda x: x["most"][h])))
    met = met.withColumn("top", top).withColumn("width", (F.size(F.col("p")[0]["part"]) / heads).cast("int"))
    weight = lambda x, h: F.exp(x["most"][h] - F.col("top")[h])
    added = lambda f: F.aggregate("p", F.lit(0.0), lambda acc, x: acc + f(x))
    sums = F.transform(F.sequence(F.lit(0), F.lit(heads - 1)), lambda h: added(lambda x: weight(x, h) * x["total"][h]))
    met = met.withColumn("sums", sums)
    head = lambda c: F.floor(c / F.col("width")).cast("int")
    out = F.transform(F.sequence(F.lit(0), F.col("width") * heads - 1), lambda c: added(lambda x: weight(x, head(c)) * x["part"][c]) / F.col("sums")[head(c)])
    done = met.select("set_id", "i", out.alias("out"))
    return q.select("set_id", "i").join(done, ["set_id", "i"], "left")
