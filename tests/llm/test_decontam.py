import hashlib
import random
import tracemalloc
import re

import numpy as np

from tessera.llm import decontam as dc

from .helpers import empty, messy, rows_of, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, window):
    """(n_words, hit positions, item ids) of each text."""
    out = []
    for text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for item, passage in items:
            own = WORD.findall(lower(passage))
            for a in range(max(1, len(own) - window + 1) if own else 0):
                part = own[a : a + window]
                for s in range(len(words) - len(part) + 1):
                    if words[s : s + len(part)] == part:
                        hit.update(range(s, s + len(part)))
                        found.add(item)
        out.append((len(words), hit, found))
    return out


def test_index_equals_brute_force():
    rng = random.Random(1)
    for trial in range(150):
        vocabulary, window = rng.choice([2, 4, 30]), rng.choice([2, 3, 10])
        docs = [" ".join(f"w{rng.randrange(vocabulary + 2)}" for _ in range(rng.choice([0, 1, 5, 40]))) for _ in range(rng.randrange(8))]
        items = [(i, " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(rng.choice([0, 1, 3, 12])))) for i in range(rng.randrange(6))]
        shard = dc.Shard.stored(*dc.Shard.of([dc.words_of(d.encode()) for d in docs]).parts())
        spans, found = dc.find(shard, dc.Phrases(items, window))
        for k, (_, hit, ids) in enumerate(brute(docs, items, window)):
            assert set(found.get(k, [])) == {sorted({i for i, _ in items}, key=str).index(i) for i in ids}, trial
            assert {p for a, z in spans.get(k, []) for p in range(a, z)} == hit


def test_suffixes_are_in_order():
    rng = np.random.default_rng(4)
    for n, symbols in ((1, 2), (7, 2), (200, 3), (3000, 4), (3000, 500)):
        text = rng.integers(0, symbols, n)
        text[-1] = 0
        ends, at = np.flatnonzero(text == 0), 0
        key = []
        for i in range(n):
            at = int(ends[np.searchsorted(ends, i)])
            key.append(([(1, int(v)) for v in text[i:at]] + [(0, at)], i))
        assert dc.suffix_array(text, symbols).tolist() == [i for _, i in sorted(key)]
    copies = np.tile(rng.integers(1, 50, 2000), 4)  # long repeats
    copies[1999::2000] = 0
    sa = dc.suffix_array(copies, 50)
    assert sorted(sa.tolist()) == list(range(8000))
    index = dc.FMIndex.of(copies, 50)
    assert index.locate(np.arange(8000)).tolist() == sa.tolist()


def test_search_of_messy_tables(spark):
    items = [(1, "THE cat, sat on the mat and then; the cat"), (1, "the cat sat on the mat and then the cat sat"), (2, "wörds 中文"), (3, None), (4, ""), (None, "one"), (5, "w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11")]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    docs = messy(spark)
    want = brute([r.text for r in docs.collect()], [(str(i), t) for i, t in items], 10)
    rows = sorted(zip((r.doc_id for r in docs.collect()), want, strict=True), key=repr)
    got = sorted(dc.search(docs, bench).collect(), key=lambda r: repr((r.doc_id, (r.n_words,))))
    made = sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
    assert made == sorted((repr(i), n, len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)) for i, (n, hit, ids) in rows)


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    bench = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k) % 977}" for k in range(12))) for i in range(40)], "item_id long, text string")
    whole = {(r.doc_id, r.n_hit, r.items_sha256) for r in dc.search(messy(spark), bench).collect()}
    monkeypatch.setattr(dc, "BLOCK_BYTES", 300)
    assert {(r.doc_id, r.n_hit, r.items_sha256) for r in dc.search(messy(spark), bench).collect()} == whole


def test_no_documents_and_no_items(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.search(empty(spark), none).count() == 0
    assert dc.search(messy(spark), none).where("n_hit > 0 OR n_items > 0").count() == 0


def test_clean_leaves_no_window(spark):
    passage = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    inner = " ".join(passage.split()[:5] + passage.split() + passage.split()[5:])  # taking the passage out brings it together again
    docs = table(spark, [(1, f"Some words, {passage}! And more."), (2, passage), (3, inner), (4, "clean words here"), (5, None), (6, "")])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = dc.clean(docs, bench)
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("Some words, ! And more.", 23), 4: ("clean words here", 16), 5: (None, None), 6: ("", 0)}
    assert dc.search(out, bench).where("contaminated").count() == 0


def test_query_equals_its_sql(spark):
    import duckdb

    from tessera.llm import queries

    folder, names = "/root/testdata/sf0.001", ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    sql = queries.SQL["op2_decontamination"].replace("FROM documents", f"FROM '{folder}/documents.parquet'").replace("FROM benchmark", f"FROM '{folder}/benchmark.parquet'")
    assert rows_of(queries.op2_decontamination(spark, folder), *names) == sorted(duckdb.sql(sql).fetchall(), key=repr)


def test_windows_of_items_by_definition():
    rng = random.Random(4)
    items = [(rng.choice([None, 1, 2, 3, 11]), rng.choice([None, "", "a", " ".join(rng.choice("abc") for _ in range(rng.randrange(9)))])) for _ in range(60)]
    for window in (1, 3, 5):
        p = dc.Phrases(items, window)
        want = {}
        for i, text in items:
            w = (text or "").split()
            for k in range(max(1, len(w) - window + 1) if w else 0):
                want.setdefault(tuple(w[k : k + window]), set()).add(i)
        got = {tuple(p.words[x].decode() for x in row[: p.lengths[k]]): {p.ids[i] for i in p.items[p.first[k] : p.first[k + 1]]} for k, row in enumerate(p.windows.tolist())}
        assert got == want and len(p.windows) == len(want)
    assert len(dc.Phrases([], 5).windows) == len(dc.Phrases([(1, ""), (None, None)], 5).windows) == 0


def test_memory_of_a_block():
    """A whole block of items costs the driver less than 200 MB."""
    rng = random.Random(1)
    items = [(i, " ".join(f"{rng.choice('abcdefgh')}{rng.randrange(60_000)}" for _ in range(60))) for i in range(dc.BLOCK_BYTES // 375)]
    assert sum(len(t) for _, t in items) > 0.9 * dc.BLOCK_BYTES
    tracemalloc.start()
    dc.Phrases(items, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20
