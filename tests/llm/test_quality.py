import math
import zlib
from unittest.mock import patch

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality
from tessera.llm import quality as q

from .helpers import MESSY, empty, messy, rows_of

SF = "/root/testdata/sf0.01"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = quality.score(docs, marks).join(marks, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(held) > 50 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_held_out_labels_and_other_columns_change_nothing(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = marks.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = docs.withColumn("source", F.lit("z")).withColumn("lang", F.lit(None).cast("string"))
    assert rows_of(quality.score(docs, marks), "doc_id", "score") == rows_of(quality.score(other, turned), "doc_id", "score")


def test_messy_tables_and_labels(spark):
    marks = labels(spark, [(1, 1, 0), (1, 1, 0), (2, None, 0), (3, 0, None), (None, 1, 1), (7, 1, 0), (8, 5, 0), (77, 0, 0)])
    assert len(quality.score(messy(spark), marks).collect()) == len(MESSY)
    none = labels(spark, [])
    assert {r.score for r in quality.score(messy(spark), none).collect()} == {0.5}
    assert quality.accepted(messy(spark), none).count() == len(MESSY)
    assert quality.score(empty(spark), marks).count() == 0 and quality.accepted(empty(spark), marks).count() == 0


def test_accepted_keeps_columns(spark):
    docs, marks = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    want = sorted(r.doc_id for r in quality.score(docs, marks).where("predicted = 1").collect())
    out = quality.accepted(docs, marks)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == want


def test_a_pair_of_features_is_learned():
    rng = np.random.default_rng(1)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.5) ^ (x[:, 9] > 0.5)).astype(float)
    model = quality.Model(x, y)
    assert (2, 9) in model.pairs and ((model.score(x) > 0.5) == y).mean() > 0.97


def brute_tree(g, h):
    """Leaves by trying each cut of each leaf."""
    worth = lambda a, z: sum(g[a:z]) ** 2 / (sum(h[a:z]) + q.RIDGE)
    leaves = [(0, len(g))]
    while len(leaves) < q.LEAVES:
        cuts = [(worth(a, m) + worth(m, z) - worth(a, z), -k, -m) for k, (a, z) in enumerate(leaves) for m in range(a + 1, z)]
        best = max(cuts, default=(0, 0, 0))
        if best[0] <= 1e-9:
            break
        a, z = leaves.pop(-best[1])
        leaves += [(a, -best[2]), (-best[2], z)]
    out = np.zeros(len(g))
    for a, z in leaves:
        out[a:z] = sum(g[a:z]) / (sum(h[a:z]) + q.RIDGE)
    return out


def test_trees_equal_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(40):
        g, h = rng.normal(size=12), rng.uniform(0.1, 2, 12)
        assert np.allclose(q._tree(g, h), brute_tree(g, h))
        a, b = rng.normal(size=(5, 5)), rng.uniform(0.1, 2, (5, 5))
        best = max(sum(a[s, t].sum() ** 2 / (b[s, t].sum() + q.RIDGE) for s in (slice(0, i), slice(i, 5)) for t in (slice(0, j), slice(j, 5))) for i in range(1, 5) for j in range(1, 5))
        assert q._quadrants(a, b)[0] == pytest.approx(best)


def test_scores_equal_brute_force():
    """Every bin looked up one by one, and the boosting done again with slow trees."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(q.FEATURES)))
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=300) > 0).astype(float)
    with patch.object(q, "ROUNDS", 3), patch.object(q, "PAIR_ROUNDS", 2):
        model = q.Model(x, y)
        total, tables = np.full(300, model.base), [np.zeros(q.BINS) for _ in q.FEATURES]
        bins = [np.array([sum(e <= v for e in edges) for v in x[:, f]]) for f, edges in enumerate(model.edges)]
        for _ in range(3):
            for f, b in enumerate(bins):
                p = 1 / (1 + np.exp(-total))
                step = q.RATE * brute_tree([float((y - p)[b == k].sum()) for k in range(q.BINS)], [float((p * (1 - p))[b == k].sum()) for k in range(q.BINS)])
                tables[f] += step
                total = total + step[b]
    assert all(np.allclose(a, b) for a, b in zip(tables, model.tables, strict=True))
    for row, got in zip(x[:50], model.score(x[:50]), strict=True):
        s = model.base + sum(t[sum(e <= v for e in edges)] for v, edges, t in zip(row, model.edges, model.tables, strict=True))
        for (a, b), t in zip(model.pairs, model.pair_tables, strict=True):
            s += t[sum(e <= row[a] for e in model.coarse[a]) * q.PAIR_BINS + sum(e <= row[b] for e in model.coarse[b])]
        assert got == pytest.approx(1 / (1 + math.exp(-s)))
