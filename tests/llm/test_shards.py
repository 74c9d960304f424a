import zlib

import numpy as np
import pytest

from tessera.llm import shards
from tessera.llm.common import Scratch

from .helpers import MESSY, empty, messy, table


def test_matrix_has_exact_sums():
    for counts, n in (([5, 0, 7, 100], 24), ([3], 24), ([], 4), ([10] * 50, 7)):
        m = shards.matrix(counts, n, 1)
        total = sum(counts)
        assert m.sum(axis=1).tolist() == counts and m.sum(axis=0).tolist() == [total // n + (s < total % n) for s in range(n)]


def test_matrix_is_hypergeometric():
    """The share of draws against probabilities of the two-by-two case."""
    got = np.bincount([shards.matrix([4, 4], 2, seed)[0, 0] for seed in range(4000)], minlength=5) / 4000
    assert np.abs(got - np.array([1, 16, 36, 16, 1]) / 70).max() < 0.03


def test_draws_of_many_rows_are_hypergeometric():
    """The way of more than 10^9 rows a side, against the probabilities of a small case and the moments of a large one."""
    rng, n = np.random.default_rng(3), 20_000

    def draw(good, bad, k):
        p = k / (good + bad)
        x, y = int(rng.binomial(good, p)), int(rng.binomial(bad, p))
        return x - shards._picked(rng, x, y, x + y - k) if x + y >= k else x + shards._picked(rng, good - x, bad - y, k - x - y)

    got = np.bincount([draw(4, 4, 4) for _ in range(n)], minlength=5) / n
    assert np.abs(got - np.array([1, 16, 36, 16, 1]) / 70).max() < 0.02
    good, bad, k = 3_000_000_000, 2_000_000_000, 1_000_000
    draws = np.array([shards._draw(rng, good, bad, k) for _ in range(300)])
    sd = np.sqrt(k * 0.6 * 0.4)
    assert abs(draws.mean() - 0.6 * k) < 4 * sd / np.sqrt(300) and 0.8 < draws.std() / sd < 1.2


def test_placement_equals_brute_force(spark):
    """From the row numbers of the input: the local order, the matrix, and the order in each shard."""
    docs, seed, n = table(spark, [(i, f"text {i}") for i in range(500)]).repartition(5), 17, 24
    docs = Scratch(spark, "test").save(docs, "docs")
    from pyspark.sql import functions as F

    rows = docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "row", F.shiftright("row", 33).alias("part"), F.xxhash64(F.lit(seed), "row").alias("local"), F.xxhash64(F.lit(seed + 1), "row").alias("key")).collect()
    parts = sorted({r.part for r in rows})
    sent = shards.matrix([sum(r.part == p for r in rows) for p in parts], n, seed)
    shard = {}
    for p, counts in zip(parts, sent, strict=True):
        own = iter(sorted((r for r in rows if r.part == p), key=lambda r: (r.local, r.row)))
        for s, c in enumerate(counts):
            shard |= {next(own).doc_id: s for _ in range(c)}
    want = []
    for s in range(n):
        own = sorted((r for r in rows if shard[r.doc_id] == s), key=lambda r: (r.key, r.row))
        want += [(r.doc_id, s, k) for k, r in enumerate(own)]
    assert sorted((r.doc_id, r.shard, r.slot) for r in shards.assign(docs, n, seed).collect()) == sorted(want)


def test_rows_are_dealt_evenly_and_without_gaps(spark, monkeypatch):
    docs = table(spark, [(i, f"text {i}") for i in range(1000)]).repartition(6)
    for block in (100_000, 7):
        rows = shards.assign(docs, 24, block_rows=block).collect()
        assert sorted(r.doc_id for r in rows) == list(range(1000))
        by = {}
        for r in rows:
            by.setdefault(r.shard, []).append(r.slot)
        assert sorted(map(len, by.values())) == [41] * 8 + [42] * 16
        assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert shards.assign(docs, 24).columns == [*(c for c in docs.columns if c not in ("shard", "slot")), "shard", "slot"]


def test_every_place_is_as_likely(spark):
    docs = spark.range(8).selectExpr("id AS doc_id").repartition(2)
    first = [shards.assign(docs, 2, seed=s).where("shard = 0 AND slot = 0").first().doc_id for s in range(16)]
    assert len(set(first)) >= 4


def test_digest_of_messy_tables(spark):
    got = sorted((repr(r.doc_id), r["size"], r.text_crc32) for r in shards.digest(messy(spark)).collect())
    assert got == sorted((repr(i), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, *_ in MESSY)
    assert shards.assign(messy(spark), 24).count() == len(MESSY) and shards.assign(empty(spark), 24).count() == 0


def test_written_shards_are_in_order(spark, tmp_path):
    docs = table(spark, [(i, f"text {i}") for i in range(300)])
    shards.write(docs, f"file://{tmp_path}/s", 5)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert back.count() == 300 and {r.n for r in back.groupBy("shard").count().withColumnRenamed("count", "n").collect()} == {60}
    want = {(r.doc_id, r.shard, r.slot) for r in shards.assign(docs, 5).collect()}
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == want


@pytest.mark.parametrize("n", [0, 1, 10])
def test_fewer_rows_than_shards(spark, n):
    rows = shards.assign(spark.range(n), 24).collect()
    assert sorted(r.shard for r in rows) == list(range(n)) and all(r.slot == 0 for r in rows)
