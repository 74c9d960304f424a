import hashlib
import random

import pytest

from tessera.llm import substrings as ss
from tessera.llm import token_batches as tb

from .helpers import LONG, MESSY, empty, messy, rows_of, table


def brute(docs, least=13):
    ids = [(-(2**63) if i is None else i) for i, _ in docs]
    words = [(t or "").encode().split() for _, t in docs]
    low = {}
    for i, w in zip(ids, words, strict=True):
        for a in range(len(w) - least + 1):
            key = tuple(w[a : a + least])
            low[key] = min(low.get(key, i), i)
    out = []
    for (one, _), i, w in zip(docs, ids, words, strict=True):
        gone = {p for a in range(len(w) - least + 1) if low[tuple(w[a : a + least])] < i for p in range(a, a + least)}
        out.append((one, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return sorted(out, key=repr)


NAMES = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_messy_tables(spark):
    assert rows_of(ss.dedup(messy(spark)), *NAMES) == brute([(r[0], r[1]) for r in MESSY])
    assert ss.dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [0, 20, 200_000])
def test_overlapping_repeats_equal_brute_force(spark, monkeypatch, hot):
    """Also where all anchors, or some, are spread by their windows."""
    monkeypatch.setattr(tb, "BATCH_WORDS", 500)
    monkeypatch.setattr(tb, "parts_for", lambda words, entries=0: 5)
    rng = random.Random(6)
    passages = [[rng.choice("abcdefgh") for _ in range(rng.randrange(8, 40))] for _ in range(12)]
    docs = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(5)):
            own = rng.choice(passages)
            a = rng.randrange(len(own))
            words += own[a:] if rng.random() < 0.7 else [rng.choice("abcdefghxyz") for _ in range(rng.randrange(20))]
        docs.append((rng.choice([i, i, i, None]), " ".join(words)))
    docs += docs[:10] + [(500, LONG), (499, "x " + LONG)]
    out = ss.dedup(table(spark, docs), hot=hot)
    assert rows_of(out, *NAMES) == brute(docs)
    for r in out.collect():
        spans = [(s.start, s.end) for s in r.spans]
        assert sum(e - s for s, e in spans) == r.n_removed and all(e - s >= 13 for s, e in spans) and all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_a_hot_anchor_is_spread_over_parts(spark, monkeypatch):
    """Thousands of surroundings of one anchor: no part gets more than its share of their windows."""
    import numpy as np

    seen = []
    monkeypatch.setattr(tb, "parts_for", lambda words, entries=0: 16)
    answer = tb.answer

    def counted(questions, reply):
        entries = [(r.part, len(tb.unpack(r["columns"][0]))) for r in questions.select("part", "columns").collect()]
        seen.append({p: sum(n for q, n in entries if q == p) for p, _ in entries})
        return answer(questions, reply)

    monkeypatch.setattr(tb, "answer", counted)
    rng = np.random.default_rng(1)
    fixed = " ".join("the quick brown fox jumps over dogs".split())
    docs = [(i, " ".join([*(f"l{v}" for v in rng.integers(0, 3, 8)), fixed, *(f"r{v}" for v in rng.integers(0, 3, 8))])) for i in range(3000)]
    assert rows_of(ss.dedup(table(spark, docs), hot=500), *NAMES) == brute(docs)
    behind = {p: n for p, n in seen[-1].items() if p >= 16}
    assert len(behind) == 16 and max(behind.values()) < 2 * sum(behind.values()) / 16 and sum(behind.values()) > 3000


def test_extension_equals_all_windows():
    """Of a few anchors with random words around them."""
    import numpy as np

    rng = np.random.default_rng(2)
    n, side = 400, 6
    anchors, ids = rng.integers(0, 6, n).astype(np.uint64), rng.integers(0, 60, n)
    words = rng.integers(0, 2, (n, 2 * side))
    for r in range(0, n, 7):  # texts that end
        words[r, rng.integers(0, side) : side] = -1
    got = ss.extend(anchors, ids, words)
    for i in range(n):
        for k in range(side + 1):
            own = [*words[i, side : side + k], *words[i, : side - k]]
            same = [j for j in range(n) if anchors[j] == anchors[i] and [*words[j, side : side + k], *words[j, : side - k]] == own]
            assert bool(got[i] >> k & 1) == (-1 not in own and min(ids[same]) < ids[i])


def test_query_equals_its_sql(spark):
    import duckdb

    from tessera.llm import queries

    folder = "/root/testdata/sf0.001"
    want = duckdb.sql(queries.SQL["op7_substrings"].replace("FROM documents", f"FROM '{folder}/documents.parquet'")).fetchall()
    assert rows_of(queries.op7_substrings(spark, folder), *NAMES) == sorted(want, key=repr)
