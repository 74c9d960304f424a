"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

A uniform permutation of n rows, cut into shards, sends numbers of rows from
partition p to shards 0, 1, ... that are multivariate hypergeometric given what
earlier partitions sent.  So the driver draws these numbers alone (partitions x
shards integers), each partition permutes its own rows and sends the first so
many to each shard, and each shard permutes what it got.  No shard is larger
than another by more than one row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, documents

#: Rows that are ordered together when a shard is permuted; a shard has as many such blocks as it needs.
BLOCK_ROWS = 100_000


def matrix(counts: list[int], shards: int, seed: int) -> np.ndarray:
    """Rows that each partition sends to each shard; columns sum to the shards' sizes."""
    total, rng = sum(counts), np.random.default_rng(seed)
    left = np.array([total // shards + (s < total % shards) for s in range(shards)], np.int64)
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        # one shard after another: the count in it, among all the places still free
        free, todo = int(left.sum()), n
        for s in range(shards):
            free -= int(left[s])
            out[p, s] = got = _draw(rng, int(left[s]), free, todo)
            todo -= got
        left -= out[p]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric: how many of n are good that are drawn from so many without replacement.

    NumPy draws for up to 10^9 a side.  Beyond, everything is drawn with
    probability n / (good + bad) first, two binomials; then as many as are too
    many or missing, about the root of n, are picked one by one.
    """
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    p = n / (good + bad)
    x, y = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
    if x + y >= n:  # of those drawn, some go back
        return x - _picked(rng, x, y, x + y - n)
    return x + _picked(rng, good - x, bad - y, n - x - y)


def _picked(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """The same for few n, by places drawn one after another, none twice."""
    if n == 0:
        return 0
    seen, found = set(), 0
    while len(seen) < n:
        for place in rng.integers(0, good + bad, n - len(seen)).tolist():
            if place not in seen:
                seen.add(place)
                found += place < good
    return found


def assign(df: DataFrame, shards: int = 24, seed: int = 17, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with ``shard`` int (from 0) and ``slot`` long (from 0 in each shard, without gaps).

    Every placement of the rows has the same probability over seeds.  Equal
    rows, nulls and hot values play no part: rows are told apart by their place
    in the input.  With fewer rows than shards, the last shards are empty; an
    empty table gives no rows.  Columns of df that are named shard or slot are
    replaced.  The result reads tables in the shared folder.
    """
    spark, scratch = df.sparkSession, Scratch(df.sparkSession, "shards")
    names = [c for c in df.columns if c.lower() not in ("shard", "slot")]
    carried = [f"c{i}" for i in range(len(names))]
    flat = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    flat = flat.select(*[flat[f"_{df.columns.index(c)}"].alias(n) for c, n in zip(names, carried, strict=True)])
    # the local permutation: each partition is sorted where it is, and its rows numbered in the new order
    rows = flat.withColumn("row", F.monotonically_increasing_id())
    rows = rows.sortWithinPartitions(F.xxhash64(F.lit(seed), "row"), "row").withColumn("place", F.monotonically_increasing_id())
    rows = scratch.save(rows.select(*carried, "row", F.shiftright("place", 33).alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("rank")), "rows")
    # one row for each input partition
    counts = {r.part: r.n for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect()}
    parts = sorted(counts)
    sent = matrix([counts[p] for p in parts], shards, seed)
    table = spark.createDataFrame([(p, n.cumsum().tolist()) for p, n in zip(parts, sent, strict=True)], "part long, until array<long>")
    dealt = rows.join(table, "part")
    dealt = dealt.withColumn("shard", F.size(F.filter("until", lambda u: u <= F.col("rank"))))
    blocks = max(1, -(-sum(counts.values()) // (shards * block_rows)))
    dealt = dealt.withColumn("key", F.xxhash64(F.lit(seed + 1), "row")).withColumn("block", F.pmod(F.shiftright("key", 20), F.lit(blocks)))
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "block").agg(F.count("*").alias("n")).withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # the exchange, and the second permutation in each block of a shard
    again = Window.partitionBy("shard", "block").orderBy("key", "row")
    out = dealt.select("shard", "block", "key", "row", *carried).withColumn("rank", F.row_number().over(again)).join(starts, ["shard", "block"])
    return out.select(*[F.col(n).alias(c) for n, c in zip(carried, names, strict=True)], "shard", (F.col("start") + F.col("rank") - 1).cast("long").alias("slot"))


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
    """(doc_id, size, text_crc32) of each row of docs: what a shard's manifest keeps.

    A null or empty text has no bytes, and the size and the checksum of none.
    Repeated rows each have their row; an empty table gives none.
    """
    text = F.coalesce("text", F.lit(""))
    return documents(docs, id_col, text_col).select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def write(docs: DataFrame, path: str, shards: int = 24, seed: int = 17) -> None:
    """Whole rows of docs, written as one folder for each shard.

    They are stored once in their local order and exchanged once: each task
    writes the blocks of shards that it got, in order of ``slot``.  Nulls and
    repeated rows are written like others; an empty table gives an empty folder.
    """
    assign(docs, shards, seed).write.partitionBy("shard").mode("overwrite").parquet(path)
