import math

import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.common import Scratch, text_key

from .helpers import MESSY, empty, messy, rows_of, table


def filled(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, left = {}, set(names), share * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > cap * sizes[s]}
        if not over:
            out |= {s: w[s] * level for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"b": 1, "a": 1000, "é": 50, None: 20}, {"a": 0, "b": 7}, {"x": 5}, {"a": 0}, {f"s{i:02}": (i * 37) % 90 for i in range(30)}])
def test_targets_equal_resharing(spark, sizes):
    t = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(t, Scratch(spark, "test")).collect()}
    want = filled(sizes)
    assert got.keys() == want.keys()
    for s, v in got.items():
        assert v == pytest.approx(want[s], abs=1e-6) and v <= 2 * sizes[s] + 1e-9


def documents(n=900):
    return [(i, " ".join(["w"] * (1 + (i * i * 7919) % 157 + (3000 if i % 301 == 0 else 0))), f"s{i % 7}" if i % 10 else None) for i in range(n)]


def test_sources_come_near_their_targets(spark):
    docs = table(spark, documents())
    rows = mixing.taken(docs).collect()
    assert len(rows) == 900 and all(0 <= r.taken <= 2 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in rows)
    source, got, target, size = {i: s for i, _, s in documents()}, {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        got[s], size[s], target[s] = got.get(s, 0) + r.taken, size.get(s, 0) + r["size"], r.target
    want = filled(size)
    for s in got:
        assert target[s] == pytest.approx(want[s]) and abs(got[s] - target[s]) <= max(10, 0.003 * target[s])
    assert rows_of(mixing.taken(docs), "doc_id", "taken") == rows_of(mixing.taken(docs.repartition(7)), "doc_id", "taken")


def test_newton_solves_the_dual(spark):
    scratch = Scratch(spark, "test")
    histogram = spark.createDataFrame([(s, z, 1 + z % 3) for s in (1, 2, 3) for z in range(1, 200, 7)], "sid int, size long, n long")
    size = {s: sum(z * (1 + z % 3) for z in range(1, 200, 7)) for s in (1, 2, 3)}
    docs = sum(1 + z % 3 for z in range(1, 200, 7))
    goals = spark.createDataFrame([(1, size[1], docs, 0.3 * size[1], False), (2, size[2], docs, 1.9 * size[2], False), (3, size[3], docs, 2.0 * size[3], True)], "sid int, source_size long, docs long, target double, full boolean")
    for r in mixing.tilt(histogram, goals, scratch).collect():
        got = sum((1 + z % 3) * z * min(2.0, math.exp(min(1.0, r.lam * z / r.mean))) for z in range(1, 200, 7))
        assert got == pytest.approx({1: 0.3, 2: 1.9}[r.sid] * size[r.sid], rel=1e-6)


def test_messy_tables(spark):
    rows = mixing.taken(messy(spark)).collect()
    assert len(rows) == len(MESSY)
    assert sorted(map(repr, (r.doc_id for r in rows))) == sorted(map(repr, (m[0] for m in MESSY)))
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    assert mixing.taken(empty(spark)).count() == 0


def test_mix_repeats_whole_rows(spark):
    docs = table(spark, documents(200))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    size = {i: len(t.split()) for i, t, _ in documents(200)}
    taken = {r.doc_id: r.taken for r in mixing.taken(docs).collect() if r.taken}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + size[r.doc_id]
    assert got == taken
    assert mixing.mix(messy(spark)).columns == docs.columns and mixing.mix(empty(spark)).count() == 0


def balanced(docs, blocks):
    """Copies of each distinct (id, source) by halving and by carrying errors in order; docs: (id, size, n, source, key)."""
    size = {}
    for _, z, n, s, _ in docs:
        size[s] = size.get(s, 0) + z * n
    out, want = {}, filled(size)
    for s in size:
        own = [d for d in docs if d[3] == s]
        mean, low, high = size[s] / sum(d[2] for d in own), -1e4, 1e4
        rate = lambda z, lam, mean=mean: min(2.0, math.exp(min(1.0, lam * z / mean))) if mean else 0.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(z * n * rate(z, mid) for _, z, n, _, _ in own) < want[s] else (low, mid)
        full = want[s] >= 2 * size[s]
        for block in {blocks[d[0], d[4]] for d in own}:
            error = 0.0
            for i, z, n, _, key in sorted((d for d in own if blocks[d[0], d[4]] == block), key=lambda d: (d[1], d[0], d[4]), reverse=True):
                w = 2.0 if full else 0.0 if want[s] <= 0 else rate(z, low)
                error += n * z * w
                c = math.floor(error / z + 0.5) if z else math.floor(n * w + 0.5)
                c = max(0, min(c, 2 * n))
                error -= c * z
                out[i, s] = c
    return out


def test_taken_equals_brute_force(spark):
    docs = documents()
    t = table(spark, docs + docs[:40])
    rows = t.groupBy("doc_id", "text", "source").count().withColumn("key", text_key(F.col("text"))).collect()
    every = {}
    for r in rows:
        every[r.source] = every.get(r.source, 0) + 1
    blocks = {}
    for s, n in every.items():
        b = max(1, -(-n // mixing.BLOCK_DOCS))
        own = t.where(F.col("source").eqNullSafe(s)).select("doc_id", text_key(F.col("text")).alias("key")).distinct()
        blocks |= {(r.doc_id, r.key): r.b for r in own.withColumn("b", F.pmod(F.xxhash64("doc_id", "key"), F.lit(b))).collect()}
    want = balanced([(r.doc_id, len(r.text.split()), r["count"], r.source, r.key) for r in rows], blocks)
    size = {i: len(x.split()) for i, x, _ in docs}
    got = {}
    for r in mixing.taken(t).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.taken
    assert got == {i: c * size[i] for (i, _), c in want.items()}


def test_hot_rows_are_dealt_out(spark, monkeypatch):
    """A third of all rows are one row, and rows that differ in other columns alone are taken in a fixed order."""
    monkeypatch.setattr(mixing, "WIDE", 7)
    rows = [*documents(60), *[(1000, "the same row again", "s1")] * 31]
    got = [r.taken for r in mixing.taken(table(spark, rows)).where("doc_id = 1000").collect()]
    assert len(got) == 31 and max(got) - min(got) in (0, 4)
    t = table(spark, rows).drop("lang").withColumn("lang", F.concat(F.lit("l"), F.monotonically_increasing_id().cast("string")))
    t = spark.createDataFrame(t.collect(), t.schema)
    first = rows_of(mixing.mix(t), "doc_id", "lang")
    assert first == rows_of(mixing.mix(t.repartition(5)), "doc_id", "lang")
    assert sum(4 for r in first if r[0] == 1000) == sum(got)


def test_no_convergence_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MOST_STEPS", 1)
    with pytest.raises(ArithmeticError):
        mixing.taken(table(spark, documents(50))).count()
