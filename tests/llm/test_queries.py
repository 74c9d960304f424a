"""The driver's queries on tables with all that may go wrong, and on empty ones."""

import pytest

from tessera.llm import queries

from .helpers import MESSY, empty, messy, rows_of

COLUMNS = {
    "op1_token_files": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op2_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op3_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op4_simhash": ["doc_id", "fingerprint", "component_id"],
    "op5_mixing": ["doc_id", "size", "source_size", "target", "taken"],
    "op6_quality": ["doc_id", "held_out", "score", "predicted"],
    "op7_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op8_line_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op9_pitman_yor": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op10_shards": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op11_yinyang": ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"],
    "op12_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op13_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
}
VECTORS = [(i % 60, [float((i * j) % 17) / 8 for j in range(64)], 1, "x") for i in range(90)] + [(None, [0.5] * 64, 1, "x"), (1, None, None, None), (2, [], 1, ""), (3, [None] * 64, 1, ""), (4, [float("nan")] * 64, 1, "")]
PAGES = [(m[0], m[1], m[2], 1, "x") for m in MESSY]
#: What the first column has for each row that the operator keeps.
IDS = {"op11_yinyang": [v[0] for v in VECTORS[:91]]}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    out = {}
    for name, docs in (("messy", messy(spark)), ("empty", empty(spark))):
        root = f"file://{tmp_path_factory.mktemp(name)}"
        docs.write.parquet(f"{root}/documents.parquet")
        for table, schema, rows in (("benchmark", "item_id long, text string, doc_id int", [(1, "the cat sat on the mat and then the cat sat", 1), (2, None, 1), (None, "one", 2), (1, "w1 w2 w3", None)]), ("labels", "doc_id long, quality int, toxic int, text string", [(1, 1, 0, "x"), (1, 1, 0, "x"), (2, 0, None, None), (None, 1, 0, ""), (3, None, 1, "")]), ("embeddings", "vec_id long, embedding array<float>, cluster int, `KEY` string", VECTORS), ("pages", "page_id long, html string, url string, `row` int, digest string", PAGES)):
            spark.createDataFrame(rows if name == "messy" else [], schema).write.parquet(f"{root}/{table}.parquet")
        out[name] = root
    return out


def test_all_queries_are_here():
    assert list(queries.QUERIES) == list(COLUMNS)


@pytest.mark.parametrize("name", list(COLUMNS))
def test_messy_and_empty_tables(spark, folders, name):
    out = queries.QUERIES[name](spark, folders["messy"])
    assert out.columns == COLUMNS[name]
    rows = rows_of(out, *COLUMNS[name])
    assert sorted(map(repr, (r[0] for r in rows))) == sorted(map(repr, IDS.get(name, [m[0] for m in MESSY])))
    assert rows_of(queries.QUERIES[name](spark, folders["messy"]), *COLUMNS[name]) == rows
    nothing = queries.QUERIES[name](spark, folders["empty"])
    assert nothing.columns == COLUMNS[name] and nothing.dtypes == out.dtypes and nothing.count() == 0
