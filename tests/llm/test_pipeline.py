import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import decontam, quality, token_files

from .helpers import MESSY, empty, table

SF = "/root/testdata/sf0.01"


def test_stages_work_on_what_the_one_before_kept(spark):
    docs, scratch = spark.read.parquet(f"{SF}/documents.parquet"), corpus_pipeline.Scratch(spark, "test")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(scratch.save(stage(spark, kept[-1], SF), name))
    assert all(k.columns == docs.columns for k in kept[:-1])
    ids = [[r.doc_id for r in k.select("doc_id").collect()] for k in kept]
    # quality: what the classifier predicts, no more and no less
    wanted = {r.doc_id for r in quality.score(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    assert sorted(ids[1]) == sorted(wanted)
    # near duplicates: against brute force over all pairs of texts
    texts = {r.doc_id: r.text.lower().split() for r in kept[1].collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in texts.items()}
    order, gone = sorted(sets), set(texts) - set(ids[2])
    least = {}
    for x, a in enumerate(order):
        least[a] = a
        for b in order[:x]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                one, other = sorted((least[a], least[b]))
                if one != other:
                    least = {k: one if v == other else v for k, v in least.items()}
    assert len(ids[2]) == len(set(ids[2])) and gone == {i for i, r in least.items() if r != i} and len(gone) > 50
    # decontamination: no window is left, and texts without one are untouched
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert decontam.search(kept[3], bench).where("contaminated").count() == 0
    clean = {r.doc_id for r in decontam.search(kept[2], bench).where("NOT contaminated").collect()}
    before = {r.doc_id: r.text for r in kept[2].collect() if r.doc_id in clean}
    assert {r.doc_id: r.text for r in kept[3].collect() if r.doc_id in clean} == before
    # mixing: whole rows, once or twice
    assert set(ids[4]) <= set(ids[3]) and max(np.unique(ids[4], return_counts=True)[1]) <= 2
    # token files: every row, in ascending order, without gaps
    rows = sorted(kept[5].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids[4])
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False))


@pytest.mark.parametrize("rows", [MESSY, []])
def test_messy_and_empty_tables(spark, rows):
    docs = table(spark, rows) if rows else empty(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() <= 2 * len(rows)
    assert corpus_pipeline.token_stage(spark, docs, SF).count() == len(rows)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 50
    assert token_files.SEGMENT_IDS > 0 and corpus_pipeline.ORACLE_SQL is None
