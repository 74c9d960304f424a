import math
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest

from tessera.llm import pitman_yor as hpy
from tessera.llm import token_batches as tb

from .helpers import MESSY, empty, messy, table


def held(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def tokens(text):
    return [*(text or "").encode().lower().split(), 0]


def base(docs):
    counts = Counter(t for i, x in docs if not held(i) for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    return [(i, held(i), len(tokens(x)), sum(counts[t] > 0 for t in tokens(x)), n, round(sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens(x)), 6)) for i, x in docs]


def rows(df):
    return sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in df.collect()), key=repr)


def test_base_columns_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tb, "BATCH_WORDS", 300)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert rows(hpy.score(docs)) == sorted(base([(r.doc_id, r.text) for r in docs.collect()]), key=repr)


def test_messy_tables(spark):
    out = hpy.score(messy(spark))
    assert rows(out) == sorted(base([(r[0], r[1]) for r in MESSY]), key=repr)
    assert all(r.score < 0 and math.isfinite(r.score) for r in out.collect())
    assert hpy.score(empty(spark)).count() == 0


def test_nothing_to_learn_from(spark):
    alone = next(i for i in range(100) if held(i))
    r = hpy.score(table(spark, [(alone, "a b")])).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == pytest.approx(0) and r.base_score == pytest.approx(0)


@pytest.mark.parametrize("many", [False, True])
def test_probabilities_of_all_texts_sum_to_one(spark, monkeypatch, many):
    """Texts of up to five words, of two known ones and the unknown one: what is missing is the chance of longer texts."""
    if many:  # several parts, with the frequent contexts spread
        monkeypatch.setattr(tb, "parts_for", lambda words, entries=0: 4)
        monkeypatch.setattr(tb, "BATCH_WORDS", 200)
    train = [(i, " ".join("ab"[(i * 5 + k) % 3 % 2] for k in range(i % 3))) for i in range(3000) if not held(i)]
    texts = [x for n in range(6) for x in product(["a", "b", "zz"], repeat=n)]
    ids = [i for i in range(10_000, 20_000) if held(i)][: len(texts)]
    out = hpy.score(table(spark, train + [(i, " ".join(x)) for i, x in zip(ids, texts, strict=True)])).where("held_out AND doc_id >= 10000").collect()
    assert len(out) == len(texts)
    assert 0.98 < sum(10**r.score for r in out) <= 1 + 1e-6


def conditional(c, log_x, d):
    weight = log_x * np.arange(1, c + 1) + hpy.log_stirling(d, c)[c, 1:]
    weight = np.exp(weight - weight.max())
    return weight / weight.sum()


def test_weights_are_those_of_all_seatings():
    """By recursion over the seatings of a few customers."""
    d, c = 0.5, 6
    weight = np.zeros(c + 1)

    def seat(sizes, w):
        if sum(sizes) == c:
            weight[len(sizes)] += w
            return
        for k in range(len(sizes)):
            seat([n + (k == i) for i, n in enumerate(sizes)], w * (sizes[k] - d))
        seat([*sizes, 1], w)

    seat([], 1.0)
    assert np.exp(hpy.log_stirling(d)[c, 1 : c + 1]) == pytest.approx(weight[1:])


@pytest.mark.parametrize("d", [0.3, 0.6, 0.8])
def test_contour_integrals_equal_the_recursion(d):
    stirling = hpy.log_stirling(d, 700)
    for c in (2, 5, 49, 257, 700):
        got = hpy.log_stirling_of(np.full(c, c), np.arange(1, c + 1), d) + math.lgamma(c + 1)
        assert np.abs(got - stirling[c, 1 : c + 1]).max() < 2e-5


@pytest.mark.parametrize(("c", "log_x"), [(6, -1.0), (40, 0.0), (300, 0.0), (300, 3.0), (700, -2.0), (400, 7.0)])
def test_table_counts_follow_their_conditional(monkeypatch, c, log_x):
    monkeypatch.setattr(hpy, "EXACT", 48)
    n, rng, stirling = 5000, np.random.default_rng(5), hpy.log_stirling(0.8, 48)
    now = np.zeros(n, np.int64)
    for _ in range(6):
        now = hpy.tables(rng, np.full(n, c), np.full(n, log_x), now, 0.8, stirling)
        assert (now >= 1).all() and (now <= c).all()
    want = conditional(c, log_x, 0.8)
    got = np.bincount(now, minlength=c + 1)[1:] / n
    assert np.abs(np.cumsum(got) - np.cumsum(want)).max() < 0.03


def chain(docs, seed, sweeps, burn):
    """Averaged predictive probabilities by seating one customer after another, all in one process."""
    rng = np.random.default_rng(seed)
    d, s, d0, s0 = hpy.DISCOUNT, hpy.STRENGTH, hpy.ROOT_DISCOUNT, hpy.ROOT_STRENGTH
    known = {t for i, x in docs if not held(i) for t in tokens(x)}
    pairs = [p for i, x in docs if not held(i) for p in zip([1, *tokens(x)], tokens(x), strict=False)]
    rest, root = {}, {}  # tables of each dish: lists of customers
    size = lambda x: sum(map(sum, x.values()))
    count = lambda x: sum(map(len, x.values()))
    uniform = 1 / (len(known) + 1)

    def p_root(w):
        t = root.get(w, [])
        return (sum(t) - d0 * len(t) + (s0 + d0 * count(root)) * uniform) / (s0 + size(root))

    def p_of(c, w):
        r = rest.get(c, {})
        t = r.get(w, [])
        return (sum(t) - d * len(t) + (s + d * count(r)) * p_root(w)) / (s + size(r))

    def sit(tables, discount, fresh):
        weight = np.array([n - discount for n in tables] + [fresh])
        k = rng.choice(len(weight), p=weight / weight.sum())
        if k < len(tables):
            tables[k] += 1
            return False
        tables.append(1)
        return True

    def leave(tables):
        k = rng.choice(len(tables), p=np.array(tables) / sum(tables))
        tables[k] -= 1
        if not tables[k]:
            tables.pop(k)
            return True
        return False

    def add(c, w):
        r = rest.setdefault(c, {})
        if sit(r.setdefault(w, []), d, (s + d * count(r)) * p_root(w)):
            sit(root.setdefault(w, []), d0, (s0 + d0 * count(root)) * uniform)

    for c, w in pairs:
        add(c, w)
    total = np.zeros(len(docs))
    probabilities = {}
    for k in range(burn + sweeps):
        for c, w in pairs:
            if leave(rest[c][w]):
                leave(root[w])
            add(c, w)
        if k >= burn:
            for i, x in docs:
                for c, w in zip([1, *tokens(x)], tokens(x), strict=False):
                    probabilities.setdefault((k, c, w), p_of(c, w))
    mean = lambda c, w: sum(probabilities[k, c, w] for k in range(burn, burn + sweeps)) / sweeps
    for n, (_, x) in enumerate(docs):
        total[n] = sum(math.log10(mean(c, w)) for c, w in zip([1, *tokens(x)], tokens(x), strict=False))
    return total


def test_scores_equal_a_sampler_that_moves_one_customer_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(hpy, "SWEEPS", 40)
    monkeypatch.setattr(hpy, "EXACT", 12)
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "d", "e", "f"], p=[0.4, 0.25, 0.15, 0.1, 0.06, 0.04], size=rng.integers(0, 9)))) for i in range(60)] + [(i, "a zz b") for i in range(60, 90)]
    got = {r.doc_id: r.score for r in hpy.score(table(spark, docs)).collect()}
    want = chain(docs, 1, 60, 10)
    assert np.abs(np.array([got[i] for i, _ in docs]) - want).max() < 0.12


def test_reruns_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(hpy.score(docs).collect(), key=repr) == sorted(hpy.score(docs).collect(), key=repr)


def test_held_out_texts_are_likelier_than_by_single_words(spark):
    out = hpy.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    per_token = lambda name: sum(r[name] for r in out) / sum(r.n_tokens for r in out)
    assert per_token("score") > per_token("base_score") + 0.3
