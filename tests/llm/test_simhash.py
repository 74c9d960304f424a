import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import simhash as sh
from tessera.llm.common import Scratch

from .helpers import MESSY, empty, messy, rows_of, table


def roots(n, links):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def test_classes_equal_brute_force(spark):
    fps = [fingerprint(r[1]) for r in MESSY]
    n = len(fps)
    root = roots(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    low = {}
    for r, row in zip(root, MESSY, strict=True):
        if row[0] is not None:
            low[r] = min(low.get(r, row[0]), row[0])
    want = sorted(((row[0], f"{f:016x}", low.get(r)) for row, f, r in zip(MESSY, fps, root, strict=True)), key=repr)
    assert rows_of(sh.classes(messy(spark)), "doc_id", "fingerprint", "component_id") == want
    assert sh.classes(empty(spark)).count() == 0


@pytest.mark.parametrize(("limit", "most"), [(0, 350), (1, 350), (3, 350), (3, 5), (11, 350), (11, 20)])
def test_links_connect_all_that_pairs_connect(spark, monkeypatch, limit, most):
    monkeypatch.setattr(sh, "MOST_IN_BUCKET", most)  # small: buckets are split, again and again
    monkeypatch.setattr(sh, "FEW", 8)
    rng = np.random.default_rng(limit + most)
    fp = rng.integers(0, 2**63, 12).astype(np.uint64)[rng.integers(0, 12, 300)]
    for _ in range(3):
        fp = fp ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    fp = np.unique(fp)
    scratch = Scratch(spark, "test")
    table_ = spark.createDataFrame([(int(v), i) for i, v in enumerate(fp.view(np.int64))], "fp long, node long")
    got = [(r.a, r.b) for r in sh.links(table_, scratch, limit).collect()]
    far = np.bitwise_count(fp[:, None] ^ fp[None, :])
    assert all(far[a, b] <= limit for a, b in got)
    want = roots(len(fp), zip(*[x.tolist() for x in np.nonzero(np.triu(far <= limit, 1))], strict=True))
    assert roots(len(fp), got) == want
    edges = spark.createDataFrame(got, "a long, b long") if got else spark.createDataFrame([], "a long, b long")
    named = {r.node: r.root for r in sh.components(edges, scratch).collect()}
    assert [named.get(i, i) for i in range(len(fp))] == want


def test_a_chain_and_a_star_become_one_component(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, k) for k in range(1001, 1100)]
    got = sh.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test"))
    assert {(r.root, r.n) for r in got.groupBy("root").agg(F.count("*").alias("n")).collect()} == {(1, 60), (1000, 100)}


def test_plans_cover_the_limit():
    sample = np.random.default_rng(1).integers(0, 2**63, 300).astype(np.uint64)
    for limit in (0, 1, 3, 7, 11):
        for n in (300, 10**6):
            chosen = sh.plan(sample, n, limit)
            assert sum(t + 1 for _, t in chosen) == limit + 1
            bits = [b for own, _ in chosen for b in own]
            assert len(bits) == len(set(bits))


def varied(words, changed):
    return " ".join("changed" + w if k in changed else w for k, w in enumerate(words))


def test_distinct_keeps_one_of_each_group(spark):
    rng = np.random.default_rng(4)
    base = [[f"w{v}" for v in rng.integers(0, 5000, 300)] for _ in range(3)]
    docs = [(10 * g + k, varied(base[g], {50 * k + 3}) if k else " ".join(base[g])) for g in range(3) for k in range(4)]
    docs += [(99, " ".join(base[0]).upper()), (100, varied(base[1], set(range(0, 300, 4)))), (101, None), (102, ""), (None, "alone without an id"), (103, "alone"), (103, "alone")]
    out = sh.distinct(table(spark, docs))
    assert out.columns == table(spark, docs).columns
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == sorted(map(repr, [0, 10, 20, 100, 101, 103, None]))
    assert sh.distinct(empty(spark)).count() == 0


def components_by_brute_force(docs):
    """The least id of the component of each document; ids ascend."""
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (text.split() for _, text in docs)]
    near = [(i, j) for i in range(len(docs)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    return near, {docs[i][0]: docs[r][0] for i, r in enumerate(roots(len(docs), near))}


def test_near_copies_of_one_original_are_all_found(spark):
    rng = np.random.default_rng(11)
    base = [f"w{v}" for v in rng.integers(0, 5000, 200)]
    docs = []
    for k in range(300):  # each alike to the original, few to each other
        at = int(rng.integers(0, 170))
        docs.append((k, " ".join([*base[:at], *[f"x{k}y{i}" for i in range(17)], *base[at + 17 :]])))
    docs.append((300, " ".join(base)))
    near, want = components_by_brute_force(docs)
    assert len(near) < 0.5 * 300 * 301 / 2 and set(want.values()) == {0}
    assert {r.doc_id: r.component_id for r in sh.near_duplicates(table(spark, docs)).collect()} == want


@pytest.mark.parametrize("low", [0.80, 0.85])
def test_pairs_near_the_threshold_are_all_found(spark, low):
    rng, docs = np.random.default_rng(12), []
    fresh = lambda n: [f"w{v}" for v in rng.integers(0, 10**6, n)]
    while len(docs) < 800:
        n = int(rng.choice([60, 150, 400]))
        base, share, kind = fresh(n), float(rng.uniform(low, low + 0.05)), len(docs) // 2 % 4
        if kind == 0:  # a passage replaced
            m = round(n * (1 - share) / (1 + share))
            at = int(rng.integers(0, n - m))
            other = base[:at] + fresh(m) + base[at + m :]
        elif kind == 1:  # text added
            other = base + fresh(round(n * (1 / share - 1)))
        elif kind == 2:  # the tail cut
            other = base[: round(n * share)]
        else:  # single words replaced
            other = list(base)
            for at in rng.choice(n, max(1, round(n * (1 - share) / (1 + share) / 5)), replace=False):
                other[at] = fresh(1)[0]
        x, y = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (base, other))
        if low <= len(x & y) / len(x | y) <= low + 0.05:
            docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(other))]
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(table(spark, docs)).collect()}
    assert got == {i: i // 2 * 2 for i in range(len(docs))}


def test_templated_texts_on_near_fingerprints_are_all_found(spark):
    """A long template and unique tails: fingerprints are close for all, texts alike in pairs only."""
    rng, docs = np.random.default_rng(21), []
    template = [f"t{i}" for i in range(60)]
    for k in range(60):
        tail = [f"w{v}" for v in rng.integers(0, 10**6, 60)]
        docs += [(2 * k, " ".join(template + tail)), (2 * k + 1, " ".join(template + tail[:-6] + ["x", "y", str(k)]))]
    near, want = components_by_brute_force(docs)
    assert len(near) == 60
    assert {r.doc_id: r.component_id for r in sh.near_duplicates(table(spark, docs)).collect()} == want


def test_texts_on_one_fingerprint_are_told_apart(spark, monkeypatch):
    """As if all fingerprints were equal, thousands of texts of which few are alike."""
    monkeypatch.setattr(sh, "fingerprint", lambda h: 5)
    rng, docs = np.random.default_rng(22), []
    for k in range(2500):
        words = [f"w{v}" for v in rng.integers(0, 10**6, 30)]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join([*words, "end"]))]
    got = {r.doc_id: r.component_id for r in sh.near_duplicates(table(spark, docs)).collect()}
    assert got == {i: i // 2 * 2 for i in range(5000)}


def test_a_crowded_ball_loses_no_link(spark, monkeypatch):
    """One group of all bits with threshold 2, whose buckets can't be split."""
    monkeypatch.setattr(sh, "plan", lambda sample, n, limit: [(list(range(64)), 2)])
    monkeypatch.setattr(sh, "MOST_IN_BUCKET", 2)
    fp = np.array([0] + [1 << a for a in range(40)] + [1 << a | 1 << b for a in range(20) for b in range(a)], np.uint64)
    fps = spark.createDataFrame([(int(v), i) for i, v in enumerate(fp.view(np.int64))], "fp long, node long")
    got = [(r.a, r.b) for r in sh.links(fps, Scratch(spark, "test"), 2).collect()]
    assert roots(len(fp), got) == [0] * len(fp)


def test_near_duplicates_of_messy_and_empty_tables(spark):
    got = rows_of(sh.near_duplicates(messy(spark)), "doc_id", "component_id")
    assert len(got) == len(MESSY) and {c for i, c in got if i in (1, 2)} == {1} and {c for i, c in got if i in (3, 4, 5)} == {3}
    assert sh.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("block", [5, 4096])
def test_hot_shingles_and_small_parts_lose_nothing(spark, monkeypatch, block):
    """Templates that most texts share, several parts and batches, groups of near copies of each other, and crowded buckets in blocks."""
    monkeypatch.setattr(sh, "BLOCK_NODES", block)
    monkeypatch.setattr(sh, "BATCH_ENTRIES", 500)
    monkeypatch.setattr(sh, "PART_ENTRIES", 300)
    rng, docs = np.random.default_rng(23), []
    template = [f"t{i}" for i in range(50)]
    for k in range(300):
        own = list(template)
        for at in rng.choice(50, int(rng.integers(1, 4)), replace=False):
            own[at] = f"w{rng.integers(0, 40)}"
        docs.append((k, " ".join(own if k % 3 else own + [f"x{k}y{i}" for i in range(30)])))
    docs += [(300 + k, docs[5][1]) for k in range(200)]
    near, want = components_by_brute_force(docs)
    assert 5 < len(set(want.values())) < 400
    assert {r.doc_id: r.component_id for r in sh.near_duplicates(table(spark, docs)).collect()} == want


def test_crowded_buckets_meet_in_bounded_groups(spark, monkeypatch):
    """Every pair of similar sizes meets once at least, and no group has more than two blocks."""
    monkeypatch.setattr(sh, "BLOCK_NODES", 60)
    rng = np.random.default_rng(31)
    rows = [(b, 1000 * b + i, int(rng.integers(1, 200)), 0, i) for b, n in ((1, 900), (2, 50), (3, 61)) for i in range(n)]
    left = spark.createDataFrame(rows, "bucket long, node long, size int, place int, label long")
    groups = {}
    for r in sh._grouped(left, 0.8).collect():
        groups.setdefault(r.group, []).append(r)
    assert max(map(len, groups.values())) <= 2 * 60 * 1.6
    met = {(min(x.node, y.node), max(x.node, y.node)) for g in groups.values() for k, x in enumerate(g) for y in g[:k] if (x.side < 0 or x.side != y.side) and not (x.guest and y.guest)}
    want = {(min(x[1], y[1]), max(x[1], y[1])) for k, x in enumerate(rows) for y in rows[:k] if x[0] == y[0] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2])}
    assert want <= met


def test_twenty_thousand_templated_texts_in_one_bucket(spark):
    """Pairs of a large bucket that sizes, places and sketches let through, in tasks of two blocks, against all of them."""
    rng = np.random.default_rng(32)
    template = rng.integers(0, 2**63, 81).astype(np.uint64)
    sets = [np.unique(np.concatenate([template, rng.integers(0, 2**63, 19).astype(np.uint64)])) for _ in range(5000)]
    sets[777] = np.unique(np.concatenate([sets[10][:-2], rng.integers(0, 2**63, 2).astype(np.uint64)]))
    rows = [(1, i, len(s), 10, i, bytearray(sh.sketch(s))) for i, s in enumerate(sets)]
    rows += [(1, i, 300 + i % 400, 299, i, bytearray(sh.sketch(sets[0]))) for i in range(5000, 20_000)]  # places leave these nothing in common
    left = spark.createDataFrame(rows, "bucket long, node long, size int, place int, label long, sketch binary")
    grouped = sh._grouped(left.drop("sketch"), 0.8).join(left.select("node", "sketch"), "node").select("group", "node", "size", "place", "label", "side", "guest", "sketch").repartition(32, "group").sortWithinPartitions("group", "size", "node")
    assert grouped.groupBy("group").count().agg({"count": "max"}).first()[0] <= 2 * sh.BLOCK_NODES * 1.2
    got = {(r.a, r.b) for r in grouped.mapInArrow(sh._all_pairs(0.8), "a long, b long").collect()}
    assert (10, 777) in got and all(b < 5000 for _, b in got)
    sketches, n = sh.Sketches([sh.sketch(s) for s in sets]), np.arange(5000)
    for a in range(0, 5000, 500):
        b = n[n > a]
        close = b[sketches.differ(np.full(len(b), a), b) <= (len(sets[a]) + np.array([len(sets[k]) for k in b])) / 9 + 1e-6]
        assert {(a, int(k)) for k in close} == {p for p in got if p[0] == a}


def test_sketches_differ_in_no_more_bits_than_sets():
    rng = np.random.default_rng(24)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (0, 1, 5, 100, 130, 900, 1500, 20_000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 4 // 5], rng.integers(0, 2**63, len(s) // 3).astype(np.uint64)])) for s in sets]
    sketches = sh.Sketches([sh.sketch(s) for s in sets])
    a, b = np.indices((len(sets), len(sets))).reshape(2, -1)
    for x, y, n in zip(a.tolist(), b.tolist(), sketches.differ(a, b).tolist(), strict=True):
        apart = len(np.setxor1d(sets[x], sets[y]))
        assert n <= apart and (apart > 0) >= (n > 0)
        if len(sets[x]) > 90 and 0.8 < len(sets[x]) / max(1, len(sets[y])) < 1.25:
            assert n >= 0.3 * apart  # tells much of the difference
